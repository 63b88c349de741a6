"""Probability and statistics.

Counts, means and variances are Spark aggregates (partial per task, one
shuffle on small keys); p-values are computed from the one result row.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.expr import materialize_small
from quarry.functions.joins import bounded_broadcast, join_on_keys
from quarry.functions.pvalues import chi2_p_value, t_p_value
from quarry.functions.rank import global_rank
from quarry.functions.scan import running_array_sum

def bayes_posterior(df: DataFrame, a: str, b: str) -> DataFrame:
    """H1: prior P(a), likelihood P(b|a), evidence P(b), posterior P(a|b)
    for every observed (a, b).

    Returns (a, b, n, prior, likelihood, evidence, posterior); posterior =
    prior * likelihood / evidence = n(a,b) / n(b).
    """
    # one row per observed (a, b): small, and read by three branches below
    pairs = materialize_small(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))
    total = pairs.agg(F.sum("n")).scalar()
    per_a = pairs.groupBy(a).agg(F.sum("n").alias("_q_na"))
    per_b = pairs.groupBy(b).agg(F.sum("n").alias("_q_nb"))
    # NULL is a value of a or b like any other: null-safe joins keep it
    out = join_on_keys(join_on_keys(pairs, per_a, [a]), per_b, [b])
    return out.select(
        a, b, "n",
        (F.col("_q_na") / total).alias("prior"),
        (F.col("n") / F.col("_q_na")).alias("likelihood"),
        (F.col("_q_nb") / total).alias("evidence"),
        (F.col("n") / F.col("_q_nb")).alias("posterior"))


def bayes_update(evidence: DataFrame, entity: str, order_cols, observation: str,
                 priors: DataFrame, likelihoods: DataFrame, hypothesis: str = "hypothesis",
                 id_cols=()) -> DataFrame:
    """H2: posterior of each hypothesis after each piece of evidence, in order.

    ``priors`` is (hypothesis, prior); ``likelihoods`` is (hypothesis,
    observation, likelihood).  Evidence rows of one entity are taken as
    independent given the hypothesis, so the log posterior is
    ln prior + running sum of ln likelihood, normalised over hypotheses.  A
    hypothesis that has met evidence of likelihood 0 (or has prior 0) stays
    at 0; if all have, the posterior is NULL.  An observation that
    ``likelihoods`` does not know at all changes nothing; one that it knows
    for other hypotheses only has likelihood 0.  Rows alike in all columns are
    pieces of evidence of their own, one after the other.

    The hypotheses' log likelihoods are one array a row, and the running sums
    add arrays up (``functions.scan.running_array_sum``, skew-safe), so the rows are sorted once and
    hypotheses only become rows at the end.  Returns (id_cols..., entity,
    hypothesis, posterior), one row per evidence row and hypothesis.
    """
    known = likelihoods.filter(F.col("likelihood").isNotNull()).groupBy(observation).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(hypothesis), F.col("likelihood")))).alias("_q_l"))
    # one row per hypothesis: the array of all of them
    all_h = priors.agg(F.sort_array(F.collect_list(F.struct(F.col(hypothesis).alias("h"), F.col("prior").cast("double").alias("p"))))).scalar()
    carried = list(dict.fromkeys([*id_cols, entity]))
    rows = evidence.select(F.struct(*carried).alias("_q_row"), F.col(entity).alias("_q_e"), F.struct(*order_cols, observation).alias("_q_o"), F.col(observation))
    rows = rows.join(known, observation, "left").select("_q_row", "_q_e", "_q_o", "_q_l", all_h.alias("_q_h"))
    given = F.transform("_q_h", lambda h: F.when(F.col("_q_l").isNull(), F.lit(1.0)).otherwise(
        F.coalesce(F.element_at("_q_l", h["h"]).cast("double"), F.lit(0.0))))
    steps = rows.select("_q_row", "_q_e", "_q_o", "_q_h", given.alias("_q_g"))
    # ln of what is possible, then how many pieces of evidence were impossible
    logs = F.concat(F.transform("_q_g", lambda g: F.when(g > 0, F.log(g)).otherwise(F.lit(0.0))),
                    F.transform("_q_g", lambda g: F.when(g > 0, F.lit(0.0)).otherwise(F.lit(1.0))))
    cum = running_array_sum(steps.select("_q_row", "_q_e", "_q_o", "_q_h", logs.alias("_q_v")), ["_q_e"], ["_q_o", "_q_row"], "_q_v", "_q_cum")
    n = F.size("_q_h")
    logpost = F.transform(F.arrays_zip(F.col("_q_h").alias("h"), F.slice("_q_cum", 1, n).alias("s"), F.slice("_q_cum", n + 1, n).alias("z")), lambda x: F.when(
        (x["z"] == 0) & (x["h"]["p"] > 0), F.log(x["h"]["p"]) + x["s"]))
    top = F.array_max("_q_lp")
    weights = F.transform("_q_lp", lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
    cum = cum.withColumn("_q_lp", logpost).withColumn("_q_w", weights)
    cum = cum.withColumn("_q_sum", F.aggregate("_q_w", F.lit(0.0), lambda x, y: x + y))
    each = cum.select("_q_row", "_q_sum", F.explode(F.arrays_zip(F.col("_q_h.h").alias("h"), F.col("_q_w").alias("w"))).alias("_q_x"))
    return each.select(*[F.col(f"_q_row.{c}").alias(c) for c in id_cols], F.col("_q_row").getField(entity).alias(entity),
                       F.col("_q_x.h").alias(hypothesis), F.try_divide("_q_x.w", "_q_sum").alias("posterior"))


def total_probability(df: DataFrame, part: str, event: Column) -> DataFrame:
    """H3: P(C) = sum_i P(L_i) P(C | L_i) over the partition given by
    ``part``; returns (p_total, p_direct) - equal by the law."""
    flag = F.coalesce(event.cast("int"), F.lit(0))
    cells = materialize_small(df.groupBy(part).agg(F.count(F.lit(1)).alias("_q_n"), F.sum(flag).alias("_q_c")))
    total = cells.agg(F.sum("_q_n")).scalar()
    terms = cells.select(((F.col("_q_n") / total) * (F.col("_q_c") / F.col("_q_n"))).alias("_q_t"),
                         F.col("_q_c"))
    return terms.agg(F.sum("_q_t").alias("p_total"), (F.sum("_q_c") / total).alias("p_direct"))


def _welch(prefix_a: str, prefix_b: str):
    na, nb = F.col(f"n_{prefix_a}"), F.col(f"n_{prefix_b}")
    va, vb = F.col(f"var_{prefix_a}"), F.col(f"var_{prefix_b}")
    # a side of one row, or no spread at all, has no t: NULL
    ra, rb = F.try_divide(va, na), F.try_divide(vb, nb)
    se2 = ra + rb
    t = F.try_divide(F.col(f"mean_{prefix_a}") - F.col(f"mean_{prefix_b}"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.try_divide(ra * ra, na - 1) + F.try_divide(rb * rb, nb - 1))
    return t, dof


def hypothesis_test(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """H4: Welch two-sample t test of mean(value) between groups a and b.

    One aggregate gives n, mean and sample variance of each group; returns
    (n_a, n_b, mean_a, mean_b, var_a, var_b, t, dof, p).
    """
    g, v = F.col(group), F.col(value)
    in_a, in_b = (g == F.lit(a)), (g == F.lit(b))
    stats = df.filter(in_a | in_b).agg(
        F.count(F.when(in_a, v)).alias("n_a"), F.count(F.when(in_b, v)).alias("n_b"),
        F.avg(F.when(in_a, v)).alias("mean_a"), F.avg(F.when(in_b, v)).alias("mean_b"),
        F.var_samp(F.when(in_a, v)).alias("var_a"), F.var_samp(F.when(in_b, v)).alias("var_b"))
    t, dof = _welch("a", "b")
    stats = stats.withColumns({"t": t, "dof": dof})
    return stats.withColumn("p", t_p_value(F.col("t"), F.col("dof")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """H5: Pearson chi-square test of independence of two category columns.

    Empty cells count too, without building the full grid: their expected
    counts add up to N minus the expected counts of the non-empty cells, and
    each contributes exactly its expected count.  Returns (stat, dof, p).
    """
    clean = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # the observed cells (bounded by the category pairs) feed every branch
    cells = materialize_small(clean.groupBy(a, b).agg(F.count(F.lit(1)).alias("o")))
    ra = cells.groupBy(a).agg(F.sum("o").alias("_q_ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("_q_cb"))
    n = F.col("_q_N")
    joined = cells.join(ra, a).join(cb, b).withColumn("_q_N", cells.agg(F.sum("o")).scalar())
    e = F.col("_q_ra") * F.col("_q_cb") / n
    per = joined.select(((F.col("o") - e) * (F.col("o") - e) / e).alias("_q_x"), e.alias("_q_e"),
                        n.alias("_q_N"))
    stat = per.agg((F.sum("_q_x") + F.max("_q_N") - F.sum("_q_e")).alias("stat"))
    dof = (ra.agg(F.count(F.lit(1))).scalar() - 1) * (cb.agg(F.count(F.lit(1))).scalar() - 1)
    out = stat.withColumn("dof", dof.cast("long"))
    return out.withColumn("p", chi2_p_value(F.col("stat"), F.col("dof")))


def pearson_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    """H6: Pearson correlation r."""
    return df.agg(F.corr(x, y).alias("r"))


def linear_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """H7: least-squares line y = slope * x + intercept, with r2."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"))


def multiple_regression(df: DataFrame, xs, y: str) -> DataFrame:
    """H7 with several regressors: ordinary least squares by the normal
    equations (one distributed pass; only d x d numbers reach the driver).
    Rows with a NULL are left out.  Returns (term, coefficient, r2), one row
    per regressor and one for the intercept."""
    xs = list(xs)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in [*xs, y]]).dropna().select(
        array_to_vector(F.array(*xs)).alias("_q_v"), F.col(y).alias("_q_y"))
    model = LinearRegression(featuresCol="_q_v", labelCol="_q_y", solver="normal").fit(data)
    rows = [*zip(xs, map(float, model.coefficients)), ("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame([(t, c, float(model.summary.r2)) for t, c in rows], "term string, coefficient double, r2 double")


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The ceil(q n)-th smallest value, exactly.

    ``percentile_approx`` brackets it; only the rows inside the bracket (a
    few in ten thousand) are ranked.  NULLs do not count; None without rows.
    """
    values = df.select(F.col(column).alias("_q_x")).filter(F.col("_q_x").isNotNull())
    n, low, high = values.agg(F.count(F.lit(1)), F.percentile_approx("_q_x", max(0.0, q - 3e-4), 10000),
                              F.percentile_approx("_q_x", min(1.0, q + 3e-4), 10000)).first()
    if not n:
        return None
    k = max(1, math.ceil(q * n - 1e-9))
    below = values.filter(F.col("_q_x") < low).count()
    ranked = global_rank(values.filter(F.col("_q_x").between(low, high)), ["_q_x"], "_q_r")
    hit = ranked.filter(F.col("_q_r") == k - below).select("_q_x").collect()
    return hit[0][0] if hit else values.agg(F.max("_q_x")).first()[0]


def partial_moments(df: DataFrame, keys, value: str) -> DataFrame:
    """Per-key count, mean and M2 (sum of squared deviations) of ``value``:
    the state to pre-aggregate before a join, combined exactly later by
    ``combine_moments``.  Returns (keys..., n, mean, m2)."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def combine_moments(parts: DataFrame, group: str) -> DataFrame:
    """Exact group moments from partial ones (Chan et al.'s parallel
    formula): N = sum n, mean = sum n mean / N,
    M2 = sum m2 + sum n (mean_i - mean)^2.  Returns (group, n, mean, var)
    with the sample variance M2 / (N - 1), NULL for a single row."""
    # partial moments (one row per pre-aggregation key) are read twice below
    parts = materialize_small(parts)
    first = parts.groupBy(group).agg(F.sum("n").alias("_q_N"),
                                     (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_q_mean"))
    j = join_on_keys(parts, bounded_broadcast(first), [group])
    return j.groupBy(group).agg(
        F.first("_q_N").alias("n"), F.first("_q_mean").alias("mean"),
        (F.sum("m2") + F.sum(F.col("n") * (F.col("mean") - F.col("_q_mean")) ** 2)).alias("_q_m2")).select(
        group, "n", "mean", F.try_divide("_q_m2", F.col("n") - 1).alias("var"))


def welch_from_moments(moments: DataFrame, group: str, a, b) -> DataFrame:
    """H4 on pre-combined moments (group, n, mean, var): one row
    (n_a, n_b, mean_a, mean_b, var_a, var_b, t, dof, p)."""
    g = F.col(group)
    pick = {}
    for side, val in (("a", a), ("b", b)):
        hit = g == F.lit(val)
        for c in ("n", "mean", "var"):
            pick[f"{c}_{side}"] = F.max(F.when(hit, F.col(c)))
    stats = moments.filter(g.isin(a, b)).agg(*[e.alias(n) for n, e in pick.items()])
    stats = stats.select("n_a", "n_b", "mean_a", "mean_b", "var_a", "var_b")
    t, dof = _welch("a", "b")
    stats = stats.withColumns({"t": t, "dof": dof})
    return stats.withColumn("p", t_p_value(F.col("t"), F.col("dof")))
