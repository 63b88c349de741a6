"""Physical layout and file sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarry.functions.expr import col_of
from quarry.functions.rank import global_rank


def clustered_write(df: DataFrame, path: str, key_cols, n: int, fmt: str = "parquet") -> None:
    """Store rows in key order, like a clustered index.

    A range exchange on the key gives ``n`` files whose key ranges do not
    overlap, each sorted inside; parquet row-group min/max then let a scan
    filtered on the leading key skip whole files and row groups.  There is
    one such order per table, as the reference notes.
    """
    keys = [col_of(k) for k in key_cols]
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode(
        "overwrite").format(fmt).save(path)


def file_sort(spark: SparkSession, path: str, fmt: str, schema: StructType, order_cols,
              rank_col: str = "rank", options: dict | None = None) -> DataFrame:
    """Read a file with an explicit schema (no inference pass) and sort
    it: ascending, NULLs first, with the rank after sorting attached."""
    reader = spark.read.schema(schema).options(**(options or {}))
    df = reader.format(fmt).load(path)
    return global_rank(df, order_cols, rank_col)
