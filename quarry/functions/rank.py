"""Global ranks without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row to
one task.  Here the sort is a range exchange (many tasks, spill-capable); each
sorted partition counts its rows, the per-partition counts (one row per
partition, not per data row) give running offsets, and a row's rank is its
partition's offset plus its position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.expr import col_of
from quarry.functions.joins import bounded_broadcast
from quarry.session import work_path


def global_rank(df: DataFrame, order_cols, rank_col: str = "rank") -> DataFrame:
    """Attach a 1-based rank in the total order given by ``order_cols``.

    ``order_cols`` should be a total order (ties only between identical rows)
    for the rank to be reproducible.  The sorted, tagged rows are written as
    compressed parquet in the shared folder, so the counts (which read two
    narrow columns) and the ranks come from one and the same sort, even if
    an executor is lost.
    """
    spark = df.sparkSession
    path = work_path(spark, "sorted")
    sorted_rows = (df.orderBy(*[col_of(c) for c in order_cols])
                   .withColumn("_q_pid", F.spark_partition_id())
                   .withColumn("_q_mid", F.monotonically_increasing_id()))
    sorted_rows.write.parquet(path)
    tagged = spark.read.schema(sorted_rows.schema).parquet(path)
    counts = tagged.groupBy("_q_pid").agg(
        F.count(F.lit(1)).alias("_q_n"), F.min("_q_mid").alias("_q_m0"))
    # One row per sorted partition: a window without PARTITION BY is bounded
    # by the partition count here, never by the data.
    before = Window.orderBy("_q_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_q_pid", "_q_m0", F.coalesce(F.sum("_q_n").over(before), F.lit(0)).alias("_q_off"))
    # one row per sorted partition: bounded by the partition count
    out = tagged.join(F.broadcast(offsets), "_q_pid")
    rank = F.col("_q_off") + F.col("_q_mid") - F.col("_q_m0") + F.lit(1)
    return out.withColumn(rank_col, rank.cast("long")).drop("_q_pid", "_q_mid", "_q_m0", "_q_off")


def rank_within(df: DataFrame, group_cols, order_cols, rank_col: str = "rank") -> DataFrame:
    """1-based rank inside each group, safe when one group is huge.

    A single global sort on (group, order) spreads a hot group over many
    range partitions; the group's first global rank (one row per group) is
    subtracted afterwards.  The table of group starts (one row per group)
    is broadcast when it is proven small (classes, anchors), so the ranked
    rows are not shuffled again; with unbounded groups it is a shuffle join.
    """
    group_cols = list(group_cols)
    ranked = global_rank(df, group_cols + list(order_cols), "_q_grank")
    starts = ranked.groupBy(*group_cols).agg(F.min("_q_grank").alias("_q_gstart"))
    # written once (one row per group), so the size check and the join do
    # not aggregate the ranked rows twice
    starts = starts.select([F.col(c).alias(f"_q_g{i}") for i, c in enumerate(group_cols)]
                           + ["_q_gstart"])
    starts = bounded_broadcast(starts)
    # NULL group keys form a group of their own, so match them null-safely.
    cond = [ranked[c].eqNullSafe(starts[f"_q_g{i}"]) for i, c in enumerate(group_cols)]
    out = ranked.join(starts, cond, "inner")
    return (out.withColumn(rank_col, F.col("_q_grank") - F.col("_q_gstart") + F.lit(1))
            .drop("_q_grank", "_q_gstart", *[f"_q_g{i}" for i in range(len(group_cols))]))


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in ``order_cols`` order, ranked.

    For small ``n`` this is ``row_number() <= n`` over a window: Spark puts a
    partial group limit before the shuffle (``WindowGroupLimit``), so every
    task ships at most ``n`` rows per group and a hot group costs no more
    than a cold one.  Beyond Spark's limit threshold it falls back to
    ``rank_within`` (one global sort).
    """
    spark = df.sparkSession
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        return rank_within(df, group_cols, order_cols, rank_col).filter(F.col(rank_col) <= n)
    w = Window.partitionBy(*group_cols).orderBy(*[col_of(c) for c in order_cols])
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).filter(F.col(rank_col) <= n)
