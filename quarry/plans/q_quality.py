"""Registered queries for SURVEY §2.7 (K1-K8)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from quarry.functions.time import ts
from quarry.operators import quality as Q
from quarry.plans.registry import register
from quarry.sources.tables import load


@register("pk_check", "O", section="K1", sql="""
SELECT l_orderkey, count(*) AS n FROM lineitem
GROUP BY l_orderkey HAVING count(*) > 1 OR l_orderkey IS NULL
""")
def q_pk_check(spark, sf):
    return Q.pk_check(load(spark, sf, "lineitem"), ["l_orderkey"])


@register("composite_pk_check", "O", section="K2", sql="""
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber
HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL
""")
def q_composite_pk_check(spark, sf):
    return Q.composite_pk_check(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("fk_check", "O", section="K3", sql="""
SELECT * FROM lineitem l
WHERE l.l_orderkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM orders o
                  WHERE o.o_orderkey = l.l_orderkey AND o.o_orderdate < TIMESTAMP '2000-01-01')
""")
def q_fk_check(spark, sf):
    parent = load(spark, sf, "orders").filter(F.col("o_orderdate") < ts("2000-01-01"))
    return Q.fk_check(load(spark, sf, "lineitem"), parent, ["l_orderkey"], ["o_orderkey"])


_NULLED_ORDERS = """(SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey,
        nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderdate,
        nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)"""


def _nulled_orders(spark, sf):
    o = load(spark, sf, "orders")
    return o.withColumns({
        "o_custkey": F.nullif(F.col("o_custkey"), F.lit(7).cast("long")),
        "o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("P")),
        "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))})


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]


@register("not_null_check", "O", section="K4", sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM {_NULLED_ORDERS} t"
    for c in _ORDER_COLS))
def q_not_null_check(spark, sf):
    return Q.not_null_check(_nulled_orders(spark, sf), _ORDER_COLS)


_LENGTH_SPEC = {"p_name": "varchar(10)", "p_brand": "char(8)", "p_type": "char(5)",
                "p_size": "tinyint", "p_retailprice": "tinyint"}


@register("length_type_check", "O", section="K5", sql="""
SELECT 'p_name' AS column_name, count(*) FILTER (WHERE length(p_name) > 10) AS violations FROM part
UNION ALL SELECT 'p_brand', count(*) FILTER (WHERE length(p_brand) > 8) FROM part
UNION ALL SELECT 'p_type', count(*) FILTER (WHERE length(p_type) > 5) FROM part
UNION ALL SELECT 'p_size', count(*) FILTER (WHERE p_size IS NOT NULL AND TRY_CAST(p_size AS TINYINT) IS NULL) FROM part
UNION ALL SELECT 'p_retailprice', count(*) FILTER (WHERE p_retailprice IS NOT NULL AND TRY_CAST(p_retailprice AS TINYINT) IS NULL) FROM part
""")
def q_length_type_check(spark, sf):
    return Q.length_type_check(load(spark, sf, "part"), _LENGTH_SPEC)


@register("auto_increment", "O", section="K6", sql="""
SELECT *, (SELECT max(c_custkey) FROM customer)
          + row_number() OVER (ORDER BY c_name, c_custkey) AS id
FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_auto_increment(spark, sf):
    c = load(spark, sf, "customer")
    batch = c.filter(F.col("c_mktsegment") == "BUILDING")
    start = c.select(F.max("c_custkey")).scalar()
    return Q.auto_increment(batch, start, ["c_name", "c_custkey"], "id")


_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _profile_sql():
    parts = []
    for w in (1, 2):
        for g in itertools.combinations(_CUST_COLS, w):
            key = g[0] if w == 1 else "row(" + ", ".join(g) + ")"
            nulls = " OR ".join(f"{c} IS NULL" for c in g)
            parts.append(
                f"SELECT '{','.join(g)}' AS columns, count(*) AS rows, "
                f"count(DISTINCT {key}) AS distinct_rows, "
                f"count(*) FILTER (WHERE {nulls}) AS null_rows, "
                f"(count(DISTINCT {key}) = count(*) AND count(*) FILTER (WHERE {nulls}) = 0) AS is_key "
                f"FROM customer")
    return "\nUNION ALL\n".join(parts)


@register("candidate_key_profile", "O", section="K7", sql=_profile_sql())
def q_candidate_key_profile(spark, sf):
    return Q.candidate_key_profile(load(spark, sf, "customer"), 2, _CUST_COLS)


@register("candidate_fk_profile", "O", section="K8", sql="""
WITH v AS (
  SELECT DISTINCT 'user_id' AS column_name, CAST(user_id AS BIGINT) AS value FROM events WHERE user_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'event_id' AS column_name, CAST(event_id AS BIGINT) AS value FROM events WHERE event_id IS NOT NULL
)
SELECT column_name, count(*) AS distinct_values, count(k.c_custkey) AS found,
       round(count(k.c_custkey) / count(*), 6) AS ratio
FROM v LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) k ON v.value = k.c_custkey
GROUP BY column_name
""")
def q_candidate_fk_profile(spark, sf):
    return Q.candidate_fk_profile(load(spark, sf, "events"), ["user_id", "event_id"],
                                  load(spark, sf, "customer"), "c_custkey")


_LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def _minimal_keys_sql(width: int):
    groups = [g for w in range(1, width + 1) for g in itertools.combinations(_LINE_COLS, w)]
    counts = "\nUNION ALL\n".join(
        f"SELECT {list(g)!r} AS cols, count(*) = (SELECT count(*) FROM lineitem) AS whole FROM (SELECT DISTINCT {', '.join(g)} FROM lineitem WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in g) + ")" for g in groups)
    return f"""WITH k AS ({counts}), w AS (SELECT cols FROM k WHERE whole)
SELECT array_to_string(cols, ',') AS columns, CAST(len(cols) AS INTEGER) AS width FROM w
WHERE NOT EXISTS (SELECT 1 FROM w s WHERE len(s.cols) < len(w.cols) AND list_has_all(w.cols, s.cols))"""


@register("minimal_keys", "O", section="K7", sql=_minimal_keys_sql(2))
def q_minimal_keys(spark, sf):
    return Q.minimal_keys(load(spark, sf, "lineitem"), 2, _LINE_COLS)


_STAR = {
    "region": {"r_regionkey": "i", "r_name": "s"},
    "nation": {"n_nationkey": "i", "n_name": "s", "n_regionkey": "i"},
    "customer": {"c_custkey": "i", "c_name": "s", "c_nationkey": "i", "c_mktsegment": "s"},
    "supplier": {"s_suppkey": "i", "s_name": "s", "s_nationkey": "i"},
    "part": {"p_partkey": "i", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i"},
    "orders": {"o_orderkey": "i", "o_custkey": "i", "o_orderstatus": "s", "o_orderdate": "t", "o_orderpriority": "s"},
    "lineitem": {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "i", "l_returnflag": "s",
                 "l_linestatus": "s", "l_shipdate": "t"},
    "events": {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "props": "s"},
}


def _inclusion_sql():
    # every column with its class (whole number, text, timestamp); doubles take no part
    parts = "\nUNION ALL\n".join(f"SELECT '{t}' AS t, '{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v FROM {t}"
                                  for t, cols in _STAR.items() for c, k in cols.items())
    return f"""WITH a AS ({parts}),
u AS (SELECT t, c, k, v, count(*) AS n FROM a GROUP BY ALL),
d AS (SELECT t, c, k, v FROM u WHERE v IS NOT NULL),
s AS (SELECT t, c, count(*) AS distinct_values FROM d GROUP BY ALL),
p AS (SELECT t, c FROM u GROUP BY ALL HAVING max(n) = 1 AND count(*) = count(v)),
m AS (SELECT d.t, d.c, q.t AS pt, q.c AS pc, count(*) AS hits
      FROM d JOIN (SELECT d.* FROM d SEMI JOIN p ON d.t = p.t AND d.c = p.c) q ON d.k = q.k AND d.v = q.v
      WHERE d.t <> q.t OR d.c <> q.c GROUP BY ALL)
SELECT m.t AS child_table, m.c AS child_column, m.pt AS parent_table, m.pc AS parent_column, s.distinct_values
FROM m JOIN s ON m.t = s.t AND m.c = s.c WHERE m.hits = s.distinct_values"""


@register("inclusion_profile", "O", section="K8", sql=_inclusion_sql())
def q_inclusion_profile(spark, sf):
    return Q.inclusion_profile({t: load(spark, sf, t) for t in _STAR})
