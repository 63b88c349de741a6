"""Running (cumulative) sums that survive one group holding a third of the data.

``sum(v) OVER (PARTITION BY g ORDER BY t)`` sends each group to one task.
Here the rows get a global rank in (g, t) order (range sort, see
``functions.rank``) and are cut into fixed-size blocks of consecutive ranks.
Sums run inside (block, group) windows, whose size is bounded by the block
size; a group that spans several blocks gets the totals of its earlier
blocks added as a carry.  Only groups crossing a block boundary need a
carry, and there are at most about as many of those as there are blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.joins import bounded_broadcast, join_on_keys
from quarry.functions.rank import global_rank

DEFAULT_BLOCK_ROWS = 1 << 20


def running_sum(df: DataFrame, group_cols, order_cols, value_cols, prefix: str = "cum_",
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Add ``prefix + v``: the sum of ``v`` over the group's rows up to and
    including this one in ``order_cols`` order (``order_cols`` should make
    the order total)."""
    group_cols, value_cols = list(group_cols), list(value_cols)
    ranked = global_rank(df, group_cols + list(order_cols), "_q_r")
    ranked = ranked.withColumn("_q_b", F.floor((F.col("_q_r") - 1) / F.lit(block_rows)))
    inside = (Window.partitionBy("_q_b", *group_cols).orderBy("_q_r")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranked.withColumns({f"_q_l_{v}": F.sum(v).over(inside) for v in value_cols})

    # one total for each (group, block); what a block carries are the totals of
    # the group's earlier blocks, so a group inside one block has no carry
    totals = ranked.groupBy(*group_cols, "_q_b").agg(*[F.sum(v).alias(f"_q_t_{v}") for v in value_cols])
    earlier = (Window.partitionBy(*group_cols).orderBy("_q_b")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*group_cols, "_q_b", F.count(F.lit(1)).over(earlier).alias("_q_before"),
                          *[F.sum(f"_q_t_{v}").over(earlier).alias(f"_q_c_{v}") for v in value_cols])
    carry = bounded_broadcast(carry.filter(F.col("_q_before") > 0).drop("_q_before"))
    out = join_on_keys(local, carry, group_cols + ["_q_b"], "left")
    out = out.withColumns({f"{prefix}{v}": F.col(f"_q_l_{v}") + F.coalesce(F.col(f"_q_c_{v}"), F.lit(0.0))
                           for v in value_cols})
    drop = ["_q_r", "_q_b"] + [f"_q_l_{v}" for v in value_cols] + [f"_q_c_{v}" for v in value_cols]
    return out.drop(*drop)


def running_array_sum(df: DataFrame, group_cols, order_cols, value: str, out_col: str, block_rows: int = 1 << 14, wide: int = 64) -> DataFrame:
    """Add ``out_col``: the elementwise sum of the array column ``value`` over the
    group's rows up to and including this one, ties in some order.

    All elements are summed at once over blocks of consecutive ranks, as in
    ``running_sum``: the array is spread over as many columns as it has elements
    (the same in every row), so each sum is an ordinary window sum.  Arrays of
    more than ``wide`` elements are spread over rows instead, since a plan of so
    many columns is slow to make.
    """
    group_cols = list(group_cols)
    width = df.agg(F.max(F.size(value))).first()[0] or 0
    names = [f"_q_v{i}" for i in range(width)]
    ranked = global_rank(df, group_cols + list(order_cols), "_q_r").withColumn("_q_b", F.floor((F.col("_q_r") - 1) / F.lit(block_rows)))
    if width > wide:
        return _running_by_element(ranked, group_cols, value, out_col)
    inside = (Window.partitionBy("_q_b", *group_cols).orderBy("_q_r").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranked.withColumns({name: F.sum(F.col(value)[i]).over(inside) for i, name in enumerate(names)})
    totals = ranked.groupBy(*group_cols, "_q_b").agg(*[F.sum(F.col(value)[i]).alias(name) for i, name in enumerate(names)], F.count(F.lit(1)).alias("_q_n"))
    earlier = Window.partitionBy(*group_cols).orderBy("_q_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*group_cols, "_q_b", F.count(F.lit(1)).over(earlier).alias("_q_before"),
                          F.array(*[F.sum(name).over(earlier) for name in names]).cast("array<double>").alias("_q_c"))
    carry = bounded_broadcast(carry.filter(F.col("_q_before") > 0).drop("_q_before"))
    out = join_on_keys(local, carry, group_cols + ["_q_b"], "left")
    sums = F.array(*[F.col(name) + F.coalesce(F.col("_q_c")[i], F.lit(0.0)) for i, name in enumerate(names)]).cast("array<double>")
    return out.withColumn(out_col, sums).drop("_q_r", "_q_b", "_q_c", *names)


def _running_by_element(ranked: DataFrame, group_cols: list, value: str, out_col: str) -> DataFrame:
    """The sums of ``running_array_sum`` with a row for each element."""
    each = ranked.select(*group_cols, "_q_r", "_q_b", F.posexplode(value).alias("_q_i", "_q_x"))
    inside = Window.partitionBy("_q_b", *group_cols, "_q_i").orderBy("_q_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group_cols, "_q_i").orderBy("_q_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = each.groupBy(*group_cols, "_q_b", "_q_i").agg(F.sum("_q_x").alias("_q_t"))
    carry = totals.withColumn("_q_c", F.sum("_q_t").over(earlier)).filter(F.col("_q_c").isNotNull()).drop("_q_t")
    local = each.withColumn("_q_l", F.sum("_q_x").over(inside)).drop("_q_x")
    out = join_on_keys(local, bounded_broadcast(carry), [*group_cols, "_q_b", "_q_i"], "left")
    pair = F.struct("_q_i", (F.col("_q_l") + F.coalesce("_q_c", F.lit(0.0))).alias("s"))
    sums = out.groupBy("_q_r").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["s"]).alias(out_col))
    return ranked.join(sums, "_q_r").drop("_q_r", "_q_b")
