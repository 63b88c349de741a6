"""Join helpers: a broadcast only behind a check of its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import materialize_small
from quarry.session import folder_bytes

# Bytes of parquet that a side may have and still be shipped to every executor.
DEFAULT_BROADCAST_BYTES = 8 << 20


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``df``, written once in the shared folder (unless ``materialize_small``
    has), and marked for broadcast if its files take at most ``max_bytes``.

    Meant for aggregated sides (classes, groups, carries).  The size is that
    of the files, nothing is taken to the driver, and the side's plan runs
    once.  Beyond the bound the join stays a shuffle join, which AQE may
    still turn into a broadcast or split for skew at run time.
    """
    spark = df.sparkSession
    side = df if hasattr(df, "_quarry_path") else materialize_small(df)
    path = side._quarry_path
    return F.broadcast(side) if folder_bytes(spark, path) <= max_bytes else side


def join_on_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on same-named key columns where NULL matches NULL.

    The right side's keys are renamed and dropped after the join, so the
    result has one copy of each key (the left one).
    """
    keys = list(keys)
    r = right.select([F.col(k).alias(f"_q_rk_{k}") for k in keys]
                     + [c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_q_rk_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_q_rk_{k}" for k in keys])
