"""Business analytics.

The reference only asks these questions; the computations chosen here are
stated in each docstring.  Every job pre-aggregates before it joins or
shuffles, so joins move one row per key rather than one per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.expr import materialize_small, stable_hash
from quarry.functions.joins import bounded_broadcast

from quarry.functions.pvalues import chi2_p_value, t_quantile
from quarry.functions.rank import global_rank, top_n_per_group
from quarry.session import work_path


def record_coverage(users: DataFrame, records: DataFrame, user_key: str, record_key: str,
                    group: str) -> DataFrame:
    """Per group, how many users have at least one record.

    Records are first reduced to their distinct keys (partial aggregation, so
    a user with billions of records costs one row), then left-joined to the
    users.  Returns (group, users, covered, ratio).
    """
    keys = records.select(F.col(record_key).alias("_q_k")).distinct()
    flagged = users.join(keys, F.col(user_key) == F.col("_q_k"), "left")
    return flagged.groupBy(group).agg(
        F.count(F.lit(1)).alias("users"),
        F.count("_q_k").alias("covered")).withColumn("ratio", F.col("covered") / F.col("users"))


def _in_period(ts: Column, period) -> Column:
    lo, hi = period
    return (ts >= F.lit(lo).cast("timestamp_ntz")) & (ts < F.lit(hi).cast("timestamp_ntz"))


def gmv_change(df: DataFrame, category: str, value: Column, ts: str, period_a, period_b) -> DataFrame:
    """GMV per category in two periods, the change, and each category's
    share of the total change (NULL if nothing changed in total).

    Periods are half-open ``(start, end)`` text pairs.  One pass with
    conditional sums; the share divides by a sum over the (small) category
    table.  Returns (category, gmv_a, gmv_b, delta, share).
    """
    t = F.col(ts)
    in_a, in_b = _in_period(t, period_a), _in_period(t, period_b)
    g = df.filter(in_a | in_b).groupBy(category).agg(
        F.sum(F.when(in_a, value).otherwise(F.lit(0.0))).alias("gmv_a"),
        F.sum(F.when(in_b, value).otherwise(F.lit(0.0))).alias("gmv_b"))
    g = g.withColumn("delta", F.col("gmv_b") - F.col("gmv_a"))
    g = materialize_small(g)  # one row per category, read twice
    return g.withColumn("share", F.try_divide(F.col("delta"), g.agg(F.sum("delta")).scalar()))


def gmv_drivers(orders: DataFrame, buyer: str, value: str, ts: str, period_a, period_b) -> DataFrame:
    """GMV = buyers x orders per buyer x value per order, per period.

    ``log_effect`` = ln(b / a) of each factor; the three factor effects add
    up to the GMV row's.  A period without orders has no ratios: those
    values and effects are NULL.  Returns (driver, value_a, value_b, log_effect).
    """
    t = F.col(ts)
    in_a, in_b = _in_period(t, period_a), _in_period(t, period_b)
    s = orders.filter(in_a | in_b).agg(
        F.count_distinct(F.when(in_a, F.col(buyer))).alias("buyers_a"),
        F.count_distinct(F.when(in_b, F.col(buyer))).alias("buyers_b"),
        F.count(F.when(in_a, F.lit(1))).alias("orders_a"),
        F.count(F.when(in_b, F.lit(1))).alias("orders_b"),
        F.sum(F.when(in_a, F.col(value))).alias("gmv_a"),
        F.sum(F.when(in_b, F.col(value))).alias("gmv_b"))
    drivers = [
        ("buyers", F.col("buyers_a").cast("double"), F.col("buyers_b").cast("double")),
        ("orders_per_buyer", F.try_divide("orders_a", "buyers_a"), F.try_divide("orders_b", "buyers_b")),
        ("value_per_order", F.try_divide("gmv_a", "orders_a"), F.try_divide("gmv_b", "orders_b")),
        ("gmv", F.col("gmv_a"), F.col("gmv_b")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("driver"), a.alias("value_a"), b.alias("value_b"))
                     for n, a, b in drivers])
    out = s.select(F.explode(rows).alias("_q_d")).select("_q_d.*")
    return out.withColumn("log_effect", F.log(F.try_divide("value_b", "value_a")))


def active_time_trend(events: DataFrame, user: str, duration: str, ts: str, grain: str = "day",
                      groups: DataFrame | None = None, group_key: str | None = None,
                      group: str | None = None) -> DataFrame:
    """I4: mean active time per user, per period, and why it moved.

    A user's active time in a period is the sum of ``duration``.  Per period:
    users, total, mean = total / users, and delta = change from the previous
    period that has events.  With ``groups`` (one row per user: ``group_key`` -> ``group``;
    users missing from it form group 'UNKNOWN') the change splits exactly
    into ``mix`` = sum_g (s_g,t - s_g,t-1) m_g,t-1 and ``within`` =
    sum_g s_g,t (m_g,t - m_g,t-1), where s is a group's share of users and m
    its mean; a group absent from a period has s = m = 0.
    Returns (period, users, total, mean, delta, mix, within).
    """
    if grain not in ("day", "week"):
        raise ValueError(grain)
    period = F.date_trunc(grain, F.col(ts))
    per_user = events.groupBy(F.col(user).alias("_q_u"), period.alias("period")).agg(
        F.sum(duration).alias("_q_t"))
    if groups is not None:
        g = groups.select(F.col(group_key).alias("_q_u"), F.col(group).alias("_q_g"))
        per_user = per_user.join(g, "_q_u", "left")
        per_user = per_user.withColumn("_q_g", F.coalesce(F.col("_q_g").cast("string"), F.lit("UNKNOWN")))
    else:
        per_user = per_user.withColumn("_q_g", F.lit("ALL"))
    cells = materialize_small(per_user.groupBy("period", "_q_g").agg(
        F.count(F.lit(1)).alias("_q_users"), F.sum("_q_t").alias("_q_total")))
    # every table from here on has one row per (period, group): small
    periods = cells.groupBy("period").agg(F.sum("_q_users").alias("users"),
                                          F.sum("_q_total").alias("total"))
    periods = periods.withColumn("mean", F.col("total") / F.col("users"))
    order = Window.orderBy("period")
    periods = periods.withColumn("delta", F.col("mean") - F.lag("mean").over(order))
    share = cells.join(periods.select("period", F.col("users").alias("_q_pu")), "period").select(
        "period", "_q_g", (F.col("_q_users") / F.col("_q_pu")).alias("s"),
        (F.col("_q_total") / F.col("_q_users")).alias("m"))
    # a period is compared with the one present before it, also after a gap
    after = periods.select(F.col("period").alias("_q_p0"), F.lead("period").over(order).alias("_q_p1")).filter(F.col("_q_p1").isNotNull())
    prev = share.join(after, F.col("period") == F.col("_q_p0")).select(
        F.col("_q_p1").alias("period"), "_q_g", F.col("s").alias("s0"), F.col("m").alias("m0"))
    both = share.join(prev, ["period", "_q_g"], "full").fillna(0.0, ["s", "m", "s0", "m0"])
    parts = both.groupBy("period").agg(
        F.sum((F.col("s") - F.col("s0")) * F.col("m0")).alias("mix"),
        F.sum(F.col("s") * (F.col("m") - F.col("m0"))).alias("within"))
    out = periods.join(parts, "period", "left")
    first = F.col("delta").isNull()
    return out.select("period", "users", "total", "mean", "delta",
                      F.when(first, F.lit(None)).otherwise(F.col("mix")).alias("mix"),
                      F.when(first, F.lit(None)).otherwise(F.col("within")).alias("within"))


def group_gap(df: DataFrame, group: str, value: str, a, b, moments: DataFrame | None = None) -> DataFrame:
    """How far group a's mean exceeds group b's: n, mean, variance of
    each, gap = mean_a - mean_b, Welch t and its degrees of freedom.

    With ``moments`` (group, n, mean, var) - e.g. per-user partial moments
    joined to the user's group and combined (``stats.combine_moments``) - the
    rows themselves are never joined; ``df`` and ``value`` are then unused.
    """
    from quarry.operators.stats import hypothesis_test, welch_from_moments
    out = (welch_from_moments(moments, group, a, b) if moments is not None
           else hypothesis_test(df, group, value, a, b))
    return out.select(F.lit(str(a)).alias("group_a"), F.lit(str(b)).alias("group_b"), "n_a", "n_b",
                      "mean_a", "mean_b", "var_a", "var_b",
                      (F.col("mean_a") - F.col("mean_b")).alias("gap"), "t", "dof", "p")


AB_BUCKETS = 10000


def ab_bucket(id_col, salt: str) -> Column:
    """Stable bucket 0..9999 from md5(salt || id): the same id always lands
    in the same bucket, in Spark and in DuckDB alike."""
    return stable_hash(salt, id_col) % F.lit(AB_BUCKETS)


def ab_arm(id_col, salt: str, ratios: dict) -> Column:
    """Arm of an id: arms take consecutive bucket ranges sized by ``ratios``
    (in the order given).  A NULL id has no arm."""
    total = float(sum(ratios.values()))
    bucket = ab_bucket(id_col, salt)
    expr, edge = None, 0.0
    for arm, r in ratios.items():
        edge += r / total
        cond = bucket < F.lit(int(round(edge * AB_BUCKETS)))
        expr = F.when(cond, F.lit(arm)) if expr is None else expr.when(cond, F.lit(arm))
    return F.when(bucket.isNotNull(), expr.otherwise(F.lit(list(ratios)[-1])))


def ab_assign(users: DataFrame, id_col: str, salt: str, ratios: dict) -> DataFrame:
    """Stable hash split of users into arms by ratio; adds (bucket, arm).

    A pure function of the id: no shuffle, and any later table keyed by the
    same id can recompute the arm instead of joining to the assignment.
    """
    return users.withColumns({"bucket": ab_bucket(F.col(id_col), salt),
                              "arm": ab_arm(F.col(id_col), salt, ratios)})


def srm_check(assigned: DataFrame, ratios: dict, strata: str | None = None) -> DataFrame:
    """Per stratum and arm, observed and expected counts, and the sample
    ratio mismatch chi-square over the stratum's arms with its p.

    Every arm of ``ratios`` counts, also one that got no rows.  Returns
    (strata, arm, n, expected, chi2, dof, p).
    """
    total = float(sum(ratios.values()))
    keys = [strata] if strata else []
    # one row per stratum, with a count for each arm
    wide = assigned.groupBy(*keys).agg(*[F.count(F.when(F.col("arm") == a, 1)).alias(f"_q_a{i}") for i, a in enumerate(ratios)])
    n = sum((F.col(f"_q_a{i}") for i in range(len(ratios))), F.lit(0))
    cells = [F.struct(F.lit(a).alias("arm"), F.col(f"_q_a{i}").alias("n"), (n * F.lit(r / total)).alias("expected"))
             for i, (a, r) in enumerate(ratios.items())]
    chi2 = sum((F.try_divide((c["n"] - c["expected"]) ** 2, c["expected"]) for c in cells), F.lit(0.0))
    out = wide.select(*keys, F.explode(F.array(*cells)).alias("_q_c"), chi2.alias("chi2"), F.lit(len(ratios) - 1).alias("dof"))
    return out.select(*keys, "_q_c.arm", "_q_c.n", "_q_c.expected", "chi2", "dof", chi2_p_value(F.col("chi2"), F.col("dof")).alias("p"))


def ab_test(df: DataFrame, arm: str, metric: str, control, treatment) -> DataFrame:
    """Difference of means between arms with a Welch t statistic, a 95%
    interval (of the same t distribution) and a two-sided p.

    Returns (n_a, n_b, mean_a, mean_b, var_a, var_b, diff, stat, dof, low,
    high, p) with a = treatment, b = control.
    """
    from quarry.operators.stats import hypothesis_test
    out = hypothesis_test(df, arm, metric, treatment, control)
    se = F.sqrt(F.try_divide("var_a", "n_a") + F.try_divide("var_b", "n_b"))
    diff = F.col("mean_a") - F.col("mean_b")
    reach = t_quantile(F.lit(0.975), F.col("dof")) * se
    return out.select("n_a", "n_b", "mean_a", "mean_b", "var_a", "var_b", diff.alias("diff"),
                      F.col("t").alias("stat"), "dof", (diff - reach).alias("low"),
                      (diff + reach).alias("high"), "p")


def diff_in_diff(df: DataFrame, treated: Column, after: Column, value: str) -> DataFrame:
    """I8: (treated after - before) - (control after - before) of mean(value),
    with the four cell means; one aggregate."""
    v = F.col(value)
    cells = {"treated_before": treated & ~after, "treated_after": treated & after,
             "control_before": ~treated & ~after, "control_after": ~treated & after}
    s = df.agg(*[F.avg(F.when(c, v)).alias(n) for n, c in cells.items()])
    effect = ((F.col("treated_after") - F.col("treated_before"))
              - (F.col("control_after") - F.col("control_before")))
    return s.withColumn("effect", effect)


def user_sequence(events: DataFrame, user: str, order_cols, kind: str, positions: bool = True,
                  transitions: bool = True, block_rows: int = 1 << 18):
    """Each user's events in time order, and next-event counts.

    Returns (positions, transitions).  ``positions`` is (user, pos, ...):
    one row per event, never one array per user, so a user with a third of
    all events does not become one giant row.  Ranks come from one global
    sort on (user, order); the next event of rank r is rank r + 1 when it
    belongs to the same user, found inside blocks of consecutive ranks - no
    per-user window.  A NULL user is a user like any other.  ``transitions`` is (from_kind, to_kind, n).
    """
    ranked = global_rank(events.select(user, *order_cols, kind), [user] + list(order_cols), "_q_r")
    pos_df = trans_df = None
    if positions:
        # one row per user; rows without a user are one user's
        starts = bounded_broadcast(ranked.groupBy(F.col(user).alias("_q_u0")).agg(F.min("_q_r").alias("_q_r0")))
        pos_df = ranked.join(starts, F.col(user).eqNullSafe(F.col("_q_u0"))).withColumn(
            "pos", F.col("_q_r") - F.col("_q_r0") + 1).drop("_q_r0", "_q_r", "_q_u0")
    if transitions:
        # the next event inside blocks of consecutive ranks; a block's last row gets the next block's first
        narrow = ranked.select(F.col(user).alias("_q_u"), F.col(kind).alias("from_kind"), "_q_r",
                               F.floor((F.col("_q_r") - 1) / F.lit(block_rows)).alias("_q_b"))
        after = Window.partitionBy("_q_b").orderBy("_q_r")
        heads = narrow.filter((F.col("_q_r") - 1) % block_rows == 0).select(
            (F.col("_q_b") - 1).alias("_q_b"), F.struct("_q_u", F.col("from_kind").alias("k")).alias("_q_head"))
        inside = narrow.withColumn("_q_in", F.lead(F.struct("_q_u", F.col("from_kind").alias("k"))).over(after))
        both = inside.join(bounded_broadcast(heads), "_q_b", "left").withColumn("_q_next", F.coalesce("_q_in", "_q_head"))
        trans_df = both.filter(F.col("_q_next").isNotNull() & F.col("_q_next._q_u").eqNullSafe(F.col("_q_u"))).groupBy("from_kind", F.col("_q_next.k").alias("to_kind")).agg(
            F.count(F.lit(1)).alias("n"))
    return pos_df, trans_df


def item_cooccurrence(lines: DataFrame, basket: str, item: str, min_support: float, top_n: int, block: int = 64) -> DataFrame:
    """For each item, the ``top_n`` items most often bought with it.

    Items count if at least ``min_support`` of all baskets hold them (the
    defining bound of frequent items).  A basket's items are dealt into blocks of about ``block``; its
    pairs are made for each two of its blocks, so one giant basket is many
    small pieces of work.  Partners are ranked by common baskets (ties by
    id), with support = n / baskets and lift = n * baskets / (n_item *
    n_other).  Returns (item, other, n, support, lift, rank).
    """
    spark = lines.sparkSession
    path = work_path(spark, "baskets")
    lines.select(F.col(basket).alias("_q_b"), F.col(item).alias("_q_i")).filter(
        F.col("_q_b").isNotNull() & F.col("_q_i").isNotNull()).distinct().write.parquet(path)
    bi = spark.read.parquet(path)  # written once for the branches below
    baskets = bi.groupBy("_q_b").agg(F.count(F.lit(1)).alias("_q_size"))
    n_baskets = baskets.agg(F.count(F.lit(1))).first()[0]
    freq = materialize_small(bi.groupBy("_q_i").agg(F.count(F.lit(1)).alias("_q_n")).filter(
        F.col("_q_n") >= F.lit(min_support * n_baskets)))
    kept = bi.join(freq.select("_q_i"), "_q_i", "left_semi").join(baskets, "_q_b")
    blocks = F.ceil(F.col("_q_size") / F.lit(block)).cast("int")
    dealt = (kept.withColumn("_q_k", blocks).withColumn("_q_m", F.pmod(F.xxhash64("_q_i"), F.col("_q_k").cast("long")).cast("int"))
             .withColumn("_q_o", F.explode(F.sequence(F.lit(0), F.col("_q_k") - 1))))
    left = dealt.select("_q_b", F.col("_q_m").alias("_q_x"), F.col("_q_o").alias("_q_y"), F.col("_q_i").alias("item"))
    right = dealt.select("_q_b", F.col("_q_o").alias("_q_x"), F.col("_q_m").alias("_q_y"), F.col("_q_i").alias("other"))
    pairs = left.join(right, ["_q_b", "_q_x", "_q_y"]).filter(F.col("item") < F.col("other"))
    counts = pairs.groupBy("item", "other").agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(counts.select(F.col("other").alias("item"), F.col("item").alias("other"), "n"))
    sizes = [freq.select(F.col("_q_i").alias(c), F.col("_q_n").alias(f"_q_{c}")) for c in ("item", "other")]
    scored = both.join(sizes[0], "item").join(sizes[1], "other").select(
        "item", "other", "n", (F.col("n") / F.lit(n_baskets)).alias("support"),
        (F.col("n") * F.lit(n_baskets) / (F.col("_q_item") * F.col("_q_other"))).alias("lift"))
    # partial top-n per task before the shuffle: a hot item ships top_n rows per task
    return top_n_per_group(scored, ["item"], [F.col("n").desc(), F.col("other")], top_n)


def dense_index(df: DataFrame, column: str, out_col: str) -> DataFrame:
    """Distinct values of ``column`` numbered 0..n-1 in value order, as a
    (column, out_col) table - a distributed replacement for a label indexer
    that would collect every label to the driver."""
    vals = df.select(column).distinct()
    return global_rank(vals, [column], "_q_r").select(
        column, (F.col("_q_r") - 1).cast("int").alias(out_col))




def gmv_rollup(level: DataFrame, level_key: str, mapping: DataFrame, key: str, parent: str) -> DataFrame:
    """I2 second level: roll per-``key`` GMV (from ``gmv_change``) up to a
    coarser ``parent`` category through a (key -> parent) dimension.

    Pre-aggregating by the fine key first means the join to the dimension
    moves one row per key, not one per sale.
    """
    dim = mapping.select(F.col(key).alias("_q_k"), F.col(parent).alias("category"))
    j = level.join(dim, F.col(level_key) == F.col("_q_k"))
    g = j.groupBy("category").agg(F.sum("gmv_a").alias("gmv_a"), F.sum("gmv_b").alias("gmv_b"))
    g = g.withColumn("delta", F.col("gmv_b") - F.col("gmv_a"))
    g = materialize_small(g)
    return g.withColumn("share", F.try_divide(F.col("delta"), g.agg(F.sum("delta")).scalar()))
