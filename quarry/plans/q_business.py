"""Registered queries for SURVEY §2.10 (I1-I10; I11 lives with the models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.time import ts
from quarry.operators import business as B
from quarry.plans.oracle import t_p_sql
from quarry.plans.registry import register
from quarry.sources.tables import load

P1996 = ("1996-01-01", "1997-01-01")
P1997 = ("1997-01-01", "1998-01-01")
SALT = "exp1"
RATIOS = {"A": 0.5, "B": 0.5}


def _in(col, p):
    return f"({col} >= TIMESTAMP '{p[0]}' AND {col} < TIMESTAMP '{p[1]}')"


@register("record_coverage", "R", section="I1", sql="""
SELECT c_mktsegment, count(*) AS users, count(k.user_id) AS covered,
       round(count(k.user_id) / count(*), 10) AS ratio
FROM customer c LEFT JOIN (SELECT DISTINCT user_id FROM events) k ON c.c_custkey = k.user_id
GROUP BY c_mktsegment
""")
def q_record_coverage(spark, sf):
    out = B.record_coverage(load(spark, sf, "customer"), load(spark, sf, "events"),
                            "c_custkey", "user_id", "c_mktsegment")
    return out.withColumn("ratio", F.round("ratio", 10))


_REV = "l_extendedprice * (1 - l_discount)"


@register("gmv_change", "R", section="I2", sql=f"""
WITH g AS (
  SELECT p.p_type AS category,
         sum(CASE WHEN {_in('l_shipdate', P1996)} THEN {_REV} ELSE 0 END) AS gmv_a,
         sum(CASE WHEN {_in('l_shipdate', P1997)} THEN {_REV} ELSE 0 END) AS gmv_b
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE {_in('l_shipdate', P1996)} OR {_in('l_shipdate', P1997)}
  GROUP BY p.p_type)
SELECT category, round(gmv_a, 2) AS gmv_a, round(gmv_b, 2) AS gmv_b, round(gmv_b - gmv_a, 2) AS delta,
       round((gmv_b - gmv_a) / sum(gmv_b - gmv_a) OVER (), 8) AS share
FROM g
""")
def q_gmv_change(spark, sf):
    li = load(spark, sf, "lineitem")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_part = B.gmv_change(li, "l_partkey", value, "l_shipdate", P1996, P1997)
    out = B.gmv_rollup(per_part, "l_partkey", load(spark, sf, "part"), "p_partkey", "p_type")
    return out.select("category", *[F.round(c, 2).alias(c) for c in ("gmv_a", "gmv_b", "delta")],
                      F.round("share", 8).alias("share"))


@register("gmv_drivers", "R", section="I3", sql=f"""
WITH s AS (
  SELECT count(DISTINCT CASE WHEN {_in('o_orderdate', P1996)} THEN o_custkey END) AS buyers_a,
         count(DISTINCT CASE WHEN {_in('o_orderdate', P1997)} THEN o_custkey END) AS buyers_b,
         count(CASE WHEN {_in('o_orderdate', P1996)} THEN 1 END) AS orders_a,
         count(CASE WHEN {_in('o_orderdate', P1997)} THEN 1 END) AS orders_b,
         sum(CASE WHEN {_in('o_orderdate', P1996)} THEN o_totalprice END) AS gmv_a,
         sum(CASE WHEN {_in('o_orderdate', P1997)} THEN o_totalprice END) AS gmv_b
  FROM orders WHERE {_in('o_orderdate', P1996)} OR {_in('o_orderdate', P1997)}),
d AS (
  SELECT 'buyers' AS driver, CAST(buyers_a AS DOUBLE) AS value_a, CAST(buyers_b AS DOUBLE) AS value_b FROM s
  UNION ALL SELECT 'orders_per_buyer', orders_a / buyers_a, orders_b / buyers_b FROM s
  UNION ALL SELECT 'value_per_order', gmv_a / orders_a, gmv_b / orders_b FROM s
  UNION ALL SELECT 'gmv', gmv_a, gmv_b FROM s)
SELECT driver, round(value_a, 4) AS value_a, round(value_b, 4) AS value_b,
       round(ln(value_b / value_a), 10) AS log_effect
FROM d
""")
def q_gmv_drivers(spark, sf):
    out = B.gmv_drivers(load(spark, sf, "orders"), "o_custkey", "o_totalprice", "o_orderdate", P1996, P1997)
    return out.select("driver", F.round("value_a", 4).alias("value_a"), F.round("value_b", 4).alias("value_b"),
                      F.round("log_effect", 10).alias("log_effect"))


@register("active_time_trend", "R", section="I4", sql="""
WITH pu AS (SELECT user_id AS u, date_trunc('day', ts) AS period, sum(value) AS t FROM events GROUP BY 1, 2),
     pg AS (SELECT pu.*, coalesce(c.c_mktsegment, 'UNKNOWN') AS g FROM pu LEFT JOIN customer c ON pu.u = c.c_custkey),
     cells AS (SELECT period, g, count(*) AS users, sum(t) AS total FROM pg GROUP BY 1, 2),
     periods AS (SELECT period, sum(users) AS users, sum(total) AS total FROM cells GROUP BY 1),
     pm AS (SELECT *, total / users AS mean, total / users - lag(total / users) OVER (ORDER BY period) AS delta
            FROM periods),
     share AS (SELECT c.period, c.g, c.users / p.users AS s, c.total / c.users AS m
               FROM cells c JOIN periods p USING (period)),
     nxt AS (SELECT period, min(period) OVER (ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after FROM periods),
     prev AS (SELECT n.after AS period, s.g, s.s AS s0, s.m AS m0 FROM share s JOIN nxt n ON n.period = s.period WHERE n.after IS NOT NULL),
     both_ AS (SELECT coalesce(a.period, b.period) AS period, coalesce(a.s, 0) AS s, coalesce(a.m, 0) AS m,
                      coalesce(b.s0, 0) AS s0, coalesce(b.m0, 0) AS m0
               FROM share a FULL JOIN prev b ON a.period = b.period AND a.g = b.g),
     parts AS (SELECT period, sum((s - s0) * m0) AS mix, sum(s * (m - m0)) AS within FROM both_ GROUP BY period)
SELECT pm.period, CAST(pm.users AS BIGINT) AS users, round(pm.total, 6) AS total, round(pm.mean, 8) AS mean,
       round(pm.delta, 8) AS delta,
       round(CASE WHEN pm.delta IS NULL THEN NULL ELSE parts.mix END, 8) AS mix,
       round(CASE WHEN pm.delta IS NULL THEN NULL ELSE parts.within END, 8) AS within
FROM pm LEFT JOIN parts USING (period)
""")
def q_active_time_trend(spark, sf):
    out = B.active_time_trend(load(spark, sf, "events"), "user_id", "value", "ts", "day",
                              load(spark, sf, "customer"), "c_custkey", "c_mktsegment")
    return out.select(F.col("period").cast("timestamp_ntz").alias("period"), F.col("users").cast("long"),
                      F.round("total", 6).alias("total"),
                      *[F.round(c, 8).alias(c) for c in ("mean", "delta", "mix", "within")])


def _welch_sql(inner):
    return f"""
SELECT {{head}} n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(var_a, 1) AS var_a, round(var_b, 1) AS var_b,
       {{extra}}
       round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 8) AS {{tname}},
       round(power(var_a / n_a + var_b / n_b, 2)
             / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)), 6) AS dof
FROM ({inner}) s
"""


_SEG_STATS = """
SELECT count(*) FILTER (WHERE g = 'BUILDING') AS n_a, count(*) FILTER (WHERE g = 'AUTOMOBILE') AS n_b,
       avg(v) FILTER (WHERE g = 'BUILDING') AS mean_a, avg(v) FILTER (WHERE g = 'AUTOMOBILE') AS mean_b,
       var_samp(v) FILTER (WHERE g = 'BUILDING') AS var_a, var_samp(v) FILTER (WHERE g = 'AUTOMOBILE') AS var_b
FROM (SELECT c.c_mktsegment AS g, e.value AS v FROM events e JOIN customer c ON e.user_id = c.c_custkey) x
WHERE g IN ('BUILDING', 'AUTOMOBILE')"""


@register("group_gap", "R", section="I5", sql=f"SELECT w.*, {t_p_sql('w.t', 'w.dof')} AS p FROM (" + _welch_sql(_SEG_STATS).format(
    head="'BUILDING' AS group_a, 'AUTOMOBILE' AS group_b,",
    extra="round(mean_a - mean_b, 6) AS gap,", tname="t") + ") w")
def q_group_gap(spark, sf):
    from quarry.operators import stats as H
    # per-user moments first: the join to customers moves one row per user
    parts = H.partial_moments(load(spark, sf, "events"), ["user_id"], "value")
    cust = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    parts = parts.join(cust, parts.user_id == cust.c_custkey).drop("user_id", "c_custkey")
    moments = H.combine_moments(parts, "c_mktsegment")
    out = B.group_gap(None, "c_mktsegment", None, "BUILDING", "AUTOMOBILE", moments=moments)
    return out.select("group_a", "group_b", "n_a", "n_b", F.round("mean_a", 6).alias("mean_a"),
                      F.round("mean_b", 6).alias("mean_b"), F.round("var_a", 1).alias("var_a"),
                      F.round("var_b", 1).alias("var_b"), F.round("gap", 6).alias("gap"),
                      F.round("t", 8).alias("t"), F.round("dof", 6).alias("dof"), F.round("p", 6).alias("p"))


_BUCKET_SQL = "(('0x' || substr(md5('{salt}' || CAST({col} AS VARCHAR)), 1, 8))::BIGINT % 10000)"


def _arm_sql(col):
    return f"CASE WHEN {_BUCKET_SQL.format(salt=SALT, col=col)} < 5000 THEN 'A' ELSE 'B' END"


@register("ab_assign", "O", section="I6", sql=f"""
SELECT c_custkey, c_mktsegment, {_BUCKET_SQL.format(salt=SALT, col='c_custkey')} AS bucket,
       {_arm_sql('c_custkey')} AS arm
FROM customer
""")
def q_ab_assign(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return B.ab_assign(c, "c_custkey", SALT, RATIOS)


@register("sample_ratio", "R", section="I6", sql=f"""
WITH c AS (SELECT c_mktsegment, {_arm_sql('c_custkey')} AS arm FROM customer),
     g AS (SELECT c_mktsegment, count(*) AS total FROM c GROUP BY 1),
     cells AS (SELECT g.c_mktsegment, a.arm, count(c.arm) AS n, g.total * a.share AS expected
               FROM g JOIN (VALUES ('A', 0.5::DOUBLE), ('B', 0.4::DOUBLE), ('C', 0.1::DOUBLE)) a(arm, share) ON true
               LEFT JOIN c ON c.c_mktsegment = g.c_mktsegment AND c.arm = a.arm GROUP BY g.c_mktsegment, a.arm, g.total, a.share),
     x AS (SELECT *, sum(power(n - expected, 2) / expected) OVER (PARTITION BY c_mktsegment) AS chi2 FROM cells)
SELECT c_mktsegment, arm, n, round(expected, 8) AS expected, round(chi2, 8) AS chi2, 2::INT AS dof, round(exp(-chi2 / 2), 6) AS p FROM x
""")
def q_sample_ratio(spark, sf):
    # held against the ratios of a test with a third arm, which gets no customers
    c = B.ab_assign(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", SALT, RATIOS)
    out = B.srm_check(c, {"A": 0.5, "B": 0.4, "C": 0.1}, "c_mktsegment")
    return out.select("c_mktsegment", "arm", "n", F.round("expected", 8).alias("expected"), F.round("chi2", 8).alias("chi2"), "dof",
                      F.round("p", 6).alias("p"))


_ARM_STATS = f"""
SELECT count(*) FILTER (WHERE arm = 'B') AS n_a, count(*) FILTER (WHERE arm = 'A') AS n_b,
       avg(o_totalprice) FILTER (WHERE arm = 'B') AS mean_a, avg(o_totalprice) FILTER (WHERE arm = 'A') AS mean_b,
       var_samp(o_totalprice) FILTER (WHERE arm = 'B') AS var_a, var_samp(o_totalprice) FILTER (WHERE arm = 'A') AS var_b
FROM (SELECT o_totalprice, {_arm_sql('o_custkey')} AS arm FROM orders) x"""


# the 97.5% point of Student's t for many degrees of freedom, as a series about the normal one
_Z = "1.959963984540054"
_T_975 = (f"({_Z} + (power({_Z}, 3) + {_Z}) / (4 * dof) + (5 * power({_Z}, 5) + 16 * power({_Z}, 3) + 3 * {_Z}) / (96 * power(dof, 2))"
          f" + (3 * power({_Z}, 7) + 19 * power({_Z}, 5) + 17 * power({_Z}, 3) - 15 * {_Z}) / (384 * power(dof, 3)))")


@register("ab_test", "R", section="I7", sql=f"""
SELECT n_a, n_b, mean_a, mean_b, var_a, var_b, diff, stat, dof,
       round(diff_raw - q * se, 6) AS low, round(diff_raw + q * se, 6) AS high, {t_p_sql('z.stat', 'z.dof')} AS p
FROM (
  SELECT *, {_T_975} AS q, round(mean_a_raw - mean_b_raw, 6) AS diff, mean_a_raw - mean_b_raw AS diff_raw,
         sqrt(var_a_raw / n_a + var_b_raw / n_b) AS se
  FROM ({_welch_sql(_ARM_STATS).format(
      head="", extra="mean_a AS mean_a_raw, mean_b AS mean_b_raw, var_a AS var_a_raw, var_b AS var_b_raw,",
      tname="stat")}) w) z
""")
def q_ab_test(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_totalprice")
    o = o.withColumn("arm", B.ab_arm(F.col("o_custkey"), SALT, RATIOS))
    out = B.ab_test(o, "arm", "o_totalprice", "A", "B")
    return out.select("n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                      F.round("var_a", 1).alias("var_a"), F.round("var_b", 1).alias("var_b"),
                      F.round("diff", 6).alias("diff"), F.round("stat", 8).alias("stat"),
                      F.round("dof", 6).alias("dof"), F.round("low", 6).alias("low"),
                      F.round("high", 6).alias("high"), F.round("p", 6).alias("p"))


@register("diff_in_diff", "R", section="I8", sql=f"""
WITH x AS (SELECT o_totalprice AS v, {_arm_sql('o_custkey')} = 'B' AS treated,
                  o_orderdate >= TIMESTAMP '1998-01-01' AS after FROM orders),
     s AS (SELECT avg(v) FILTER (WHERE treated AND NOT after) AS treated_before,
                  avg(v) FILTER (WHERE treated AND after) AS treated_after,
                  avg(v) FILTER (WHERE NOT treated AND NOT after) AS control_before,
                  avg(v) FILTER (WHERE NOT treated AND after) AS control_after FROM x)
SELECT round(treated_before, 6) AS treated_before, round(treated_after, 6) AS treated_after,
       round(control_before, 6) AS control_before, round(control_after, 6) AS control_after,
       round((treated_after - treated_before) - (control_after - control_before), 6) AS effect
FROM s
""")
def q_diff_in_diff(spark, sf):
    o = load(spark, sf, "orders")
    out = B.diff_in_diff(o, B.ab_arm(F.col("o_custkey"), SALT, RATIOS) == "B",
                         F.col("o_orderdate") >= ts("1998-01-01"), "o_totalprice")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("user_sequence", "O", section="I9", sql="""
WITH s AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt
           FROM events)
SELECT event_type AS from_kind, nxt AS to_kind, count(*) AS n FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2
""")
def q_user_sequence(spark, sf):
    _, transitions = B.user_sequence(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type",
                                     positions=False)
    return transitions


@register("user_sequence_positions", "O", section="I9", sql="""
SELECT user_id, ts, event_id, event_type,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
FROM events
""")
def q_user_sequence_positions(spark, sf):
    positions, _ = B.user_sequence(load(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type",
                                   transitions=False)
    return positions


@register("item_cooccurrence", "R", section="I10", sql="""
WITH bi AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem),
     nb AS (SELECT count(DISTINCT b) AS nb FROM bi),
     freq AS (SELECT i, count(*) AS n FROM bi GROUP BY i HAVING count(*) >= 0.0001::DOUBLE * (SELECT nb FROM nb)),
     pairs AS (SELECT x.i AS item, y.i AS other, count(*) AS n FROM bi x JOIN bi y ON x.b = y.b AND x.i <> y.i
               WHERE x.i IN (SELECT i FROM freq) AND y.i IN (SELECT i FROM freq) GROUP BY 1, 2),
     scored AS (SELECT p.item, p.other, p.n, p.n / (SELECT nb FROM nb) AS support,
                       p.n * (SELECT nb FROM nb) / (f.n * g.n) AS lift,
                       row_number() OVER (PARTITION BY p.item ORDER BY p.n DESC, p.other) AS rank
                FROM pairs p JOIN freq f ON f.i = p.item JOIN freq g ON g.i = p.other)
SELECT item, other, n, round(support, 10) AS support, round(lift, 8) AS lift, rank FROM scored WHERE rank <= 5
""")
def q_item_cooccurrence(spark, sf):
    out = B.item_cooccurrence(load(spark, sf, "lineitem"), "l_orderkey", "l_partkey", min_support=0.0001, top_n=5)
    return out.select("item", "other", "n", F.round("support", 10).alias("support"),
                      F.round("lift", 8).alias("lift"), "rank")
