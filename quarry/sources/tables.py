"""Reading the given tables (A2 table_scan, A3 fetch_one, A4 fetch_all)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.expr import col_of

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as a DataFrame (lazy; pruning and filters
    reach the parquet scan)."""
    return spark.read.parquet(table_path(sf_dir, name))


def table_scan(spark: SparkSession, path_or_name: str) -> DataFrame:
    """A2: ``SELECT *`` over a catalog table or a parquet path."""
    if "/" in path_or_name or path_or_name.endswith(".parquet"):
        return spark.read.parquet(path_or_name)
    return spark.table(path_or_name)


def fetch_one(df: DataFrame, order_cols) -> DataFrame:
    """A3: the first row under a total order, or no row.

    ``orderBy(...).limit(1)`` plans as a per-task top-1 and a merge of one
    row per task, never a full sort.  ``result.isEmpty()`` answers the
    reference's "is it None" test.
    """
    return df.orderBy(*[col_of(c) for c in order_cols]).limit(1)


def fetch_all(df: DataFrame) -> DataFrame:
    """A4: all rows of a result.

    Returned as a DataFrame; a client that really wants tuples iterates with
    ``toLocalIterator()`` (one partition at a time), never ``collect()``.
    """
    return df
