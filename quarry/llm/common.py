"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import shuffle_files_dropped, small_batches, work_path  # noqa: F401


def ship(module_name: str) -> None:
    """Send a module's functions to the executors by value, so that workers
    need no copy of the package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column="text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tidy(run):
    """A mapInArrow function that gives its task's memory back to the machine
    at the end: workers live on, beside an executor with work of its own."""
    def tidied(batches):
        import ctypes
        import gc

        import pyarrow
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass
    return tidied


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can meet their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def row_key(row: str = "_row") -> Column:
    """128 bits of hash over a struct column."""
    return F.struct(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), F.col(row)).alias("b"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: cuts the lineage, and a
    lost executor loses nothing of it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffle_files_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows as text take at most
    ``most_bytes``, otherwise as it is.  ``df`` should be a written table."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_slices(batches, rows: int = 1000):
    """The batches in parts of at most ``rows`` rows: what a function makes of
    a part stays small, however large Spark's batches are."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


ship(__name__)
