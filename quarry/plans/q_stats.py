"""Registered queries for SURVEY §2.9 (H1-H7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import stats as H
from quarry.plans.oracle import chi2_p_sql, t_p_sql
from quarry.plans.registry import register
from quarry.sources.tables import load


@register("bayes_posterior", "R", section="H1", sql="""
WITH pairs AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
     na AS (SELECT o_orderpriority, sum(n) AS na FROM pairs GROUP BY 1),
     nb AS (SELECT o_orderstatus, sum(n) AS nb FROM pairs GROUP BY 1),
     t AS (SELECT count(*) AS total FROM orders)
SELECT p.o_orderpriority, p.o_orderstatus, p.n,
       round(na / total, 10) AS prior, round(p.n / na, 10) AS likelihood,
       round(nb / total, 10) AS evidence, round(p.n / nb, 10) AS posterior
FROM pairs p JOIN na USING (o_orderpriority) JOIN nb USING (o_orderstatus), t
""")
def q_bayes_posterior(spark, sf):
    out = H.bayes_posterior(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return out.select("o_orderpriority", "o_orderstatus", "n",
                      *[F.round(c, 10).alias(c) for c in ("prior", "likelihood", "evidence", "posterior")])


def segment_model(spark, sf):
    """Priors and smoothed likelihoods for H2: hypothesis = a user's market
    segment, observation = event type.  P(h) is the segment's share of
    customers; P(e | h) = (n(h, e) + 1) / (n(h) + |E|)."""
    cust = load(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("hypothesis"))
    events = load(spark, sf, "events")
    n_cust = cust.agg(F.count(F.lit(1))).scalar()
    priors = cust.groupBy("hypothesis").agg((F.count(F.lit(1)) / n_cust).alias("prior"))
    # per-user counts first, so the join with customers moves one row per
    # (user, type) instead of one per event
    per_user = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    nhe = (per_user.join(cust, per_user.user_id == cust.c_custkey)
           .groupBy("hypothesis", "event_type").agg(F.sum("n").alias("n")))
    types = events.select("event_type").distinct()
    n_types = types.agg(F.count(F.lit(1))).scalar()
    n_h = nhe.groupBy("hypothesis").agg(F.sum("n").alias("n_h"))
    every = F.explode(types.agg(F.collect_list("event_type")).scalar())  # the vocabulary, for each hypothesis
    lik = (priors.select("hypothesis", every.alias("event_type")).join(nhe, ["hypothesis", "event_type"], "left").join(n_h, "hypothesis", "left")
           .na.fill(0, ["n", "n_h"]).select("hypothesis", "event_type", ((F.col("n") + 1) / (F.col("n_h") + n_types)).alias("likelihood")))
    return priors, lik


@register("bayes_update", "R", section="H2", sql="""
WITH cust AS (SELECT c_custkey, c_mktsegment AS h FROM customer),
     prior AS (SELECT h, count(*) / (SELECT count(*) FROM customer) AS prior FROM cust GROUP BY h),
     types AS (SELECT DISTINCT event_type FROM events),
     nhe AS (SELECT c.h, e.event_type, count(*) AS n FROM events e JOIN cust c ON e.user_id = c.c_custkey GROUP BY 1, 2),
     nh AS (SELECT h, sum(n) AS n FROM nhe GROUP BY h),
     lik AS (SELECT p.h, t.event_type,
                    ln((coalesce(x.n, 0) + 1) / (coalesce(nh.n, 0) + (SELECT count(*) FROM types))) AS lp
             FROM prior p CROSS JOIN types t
             LEFT JOIN nhe x ON x.h = p.h AND x.event_type = t.event_type
             LEFT JOIN nh ON nh.h = p.h),
     steps AS (SELECT e.event_id, e.user_id, l.h,
                      ln(p.prior) + sum(l.lp) OVER (PARTITION BY e.user_id, l.h ORDER BY e.ts, e.event_id
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lpost
               FROM events e JOIN lik l ON l.event_type = e.event_type JOIN prior p ON p.h = l.h),
     m AS (SELECT *, lpost - max(lpost) OVER (PARTITION BY event_id) AS d FROM steps)
SELECT event_id, user_id, h AS hypothesis,
       round(exp(d) / sum(exp(d)) OVER (PARTITION BY event_id), 8) AS posterior
FROM m
""")
def q_bayes_update(spark, sf):
    priors, lik = segment_model(spark, sf)
    ev = load(spark, sf, "events")
    out = H.bayes_update(ev, "user_id", ["ts", "event_id"], "event_type", priors, lik,
                         id_cols=["event_id"])
    return out.withColumn("posterior", F.round("posterior", 8))


@register("total_probability", "R", section="H3", sql="""
WITH c AS (SELECT o_orderpriority, count(*) AS n,
                  sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS c FROM orders GROUP BY 1),
     t AS (SELECT count(*) AS total FROM orders)
SELECT round(sum((n / total) * (c / n)), 10) AS p_total, round(sum(c) / max(total), 10) AS p_direct
FROM c, t
""")
def q_total_probability(spark, sf):
    out = H.total_probability(load(spark, sf, "orders"), "o_orderpriority",
                              F.col("o_orderstatus") == "F")
    return out.select(F.round("p_total", 10).alias("p_total"), F.round("p_direct", 10).alias("p_direct"))


def _round_test(df):
    return df.select("n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                     F.round("var_a", 1).alias("var_a"), F.round("var_b", 1).alias("var_b"),
                     F.round("t", 8).alias("t"), F.round("dof", 6).alias("dof"), F.round("p", 6).alias("p"))


_WELCH_SQL = f"SELECT w.*, {t_p_sql('w.t', 'w.dof')} AS p FROM (" + """
SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(var_a, 1) AS var_a, round(var_b, 1) AS var_b,
       round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 8) AS t,
       round(power(var_a / n_a + var_b / n_b, 2)
             / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)), 6) AS dof
FROM ({inner}) s) w
"""


@register("hypothesis_test", "R", section="H4", sql=_WELCH_SQL.format(inner="""
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_a, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_b,
       avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS mean_a,
       avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS mean_b,
       var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS var_a,
       var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS var_b
FROM orders"""))
def q_hypothesis_test(spark, sf):
    return _round_test(H.hypothesis_test(load(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "F", "O"))


@register("chi_square", "R", section="H5", sql=f"SELECT x.*, {chi2_p_sql('x.stat', 'x.dof')} AS p FROM (" + """
WITH cells AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS o FROM customer GROUP BY 1, 2),
     ra AS (SELECT a, sum(o) AS ra FROM cells GROUP BY a),
     cb AS (SELECT b, sum(o) AS cb FROM cells GROUP BY b),
     n AS (SELECT sum(o) AS n FROM cells),
     grid AS (SELECT ra.a, cb.b, ra.ra * cb.cb / n.n AS e FROM ra CROSS JOIN cb CROSS JOIN n)
SELECT round(sum(power(coalesce(c.o, 0) - g.e, 2) / g.e), 8) AS stat,
       CAST(((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS BIGINT) AS dof
FROM grid g LEFT JOIN cells c ON c.a = g.a AND c.b = g.b) x
""")
def q_chi_square(spark, sf):
    out = H.chi_square(load(spark, sf, "customer"), "c_nationkey", "c_mktsegment")
    return out.select(F.round("stat", 8).alias("stat"), "dof", F.round("p", 6).alias("p"))


@register("pearson_corr", "R", section="H6",
          sql="SELECT round(corr(p_size, p_retailprice), 10) AS r FROM part")
def q_pearson_corr(spark, sf):
    return H.pearson_corr(load(spark, sf, "part"), "p_size", "p_retailprice").select(
        F.round("r", 10).alias("r"))


@register("linear_regression", "R", section="H7", sql="""
SELECT round(regr_slope(p_retailprice, p_size), 10) AS slope,
       round(regr_intercept(p_retailprice, p_size), 8) AS intercept,
       round(regr_r2(p_retailprice, p_size), 10) AS r2
FROM part
""")
def q_linear_regression(spark, sf):
    out = H.linear_regression(load(spark, sf, "part"), "p_size", "p_retailprice")
    return out.select(F.round("slope", 10).alias("slope"), F.round("intercept", 8).alias("intercept"),
                      F.round("r2", 10).alias("r2"))
