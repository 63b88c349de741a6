"""Registered queries for SURVEY §2.2-2.6 (B, C, D, E, F) and the flagship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.time import ts
from quarry.operators import relational as R
from quarry.plans.registry import register
from quarry.sources.tables import load

YEAR_1996 = "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'"


def _orders_1996(spark, sf):
    o = load(spark, sf, "orders")
    return o.filter((F.col("o_orderdate") >= ts("1996-01-01")) & (F.col("o_orderdate") < ts("1997-01-01")))


# ------------------------------------------------------------------ E1 (flagship)

@register("derived_table_filter", "R", section="E1", sql="""
SELECT S.c_nationkey, n.n_name, S.avg_acctbal
FROM (SELECT c_nationkey, round(avg(c_acctbal), 6) AS avg_acctbal
      FROM customer GROUP BY c_nationkey) AS S
JOIN nation n ON n.n_nationkey = S.c_nationkey
WHERE S.avg_acctbal > 4500
""")
def q_derived_table_filter(spark, sf):
    cust = load(spark, sf, "customer")
    s = R.derived_table_filter(cust, ["c_nationkey"], "c_acctbal", 4500.0, "avg_acctbal")
    nation = load(spark, sf, "nation")
    out = s.join(nation.select("n_nationkey", "n_name"),
                 F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select("c_nationkey", "n_name", F.round("avg_acctbal", 6).alias("avg_acctbal"))


# ------------------------------------------------------------------ B


@register("project_alias", "R", section="B1", sql="""
SELECT c_custkey AS id, c_name AS name, round(c_acctbal * 12, 2) AS yearly_balance
FROM customer
""")
def q_project_alias(spark, sf):
    return R.project_alias(load(spark, sf, "customer"), {
        "id": "c_custkey", "name": "c_name",
        "yearly_balance": F.round(F.col("c_acctbal") * 12, 2)})


@register("filter_eq_string", "O", section="B2",
          sql="SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_filter_eq_string(spark, sf):
    return R.filter_eq_string(load(spark, sf, "customer"), "c_mktsegment", "BUILDING")


@register("filter_eq_int", "O", section="B3", sql="SELECT * FROM part WHERE p_size = 18")
def q_filter_eq_int(spark, sf):
    return R.filter_eq_int(load(spark, sf, "part"), "p_size", 18)


@register("filter_gt", "O", section="B4", sql="SELECT * FROM customer WHERE c_acctbal > 5000")
def q_filter_gt(spark, sf):
    return R.filter_gt(load(spark, sf, "customer"), "c_acctbal", 5000)


@register("filter_fractional_bound", "O", section="B3-B5, B12", sql="""
SELECT p_partkey, p_size, 'gt' AS test FROM part WHERE p_size > 18.5
UNION ALL SELECT p_partkey, p_size, 'quoted' FROM part WHERE p_size > CAST('20.5' AS DECIMAL(4, 1))
UNION ALL SELECT p_partkey, p_size, 'eq' FROM part WHERE p_size = 18.5
UNION ALL SELECT p_partkey, p_size, 'neq' FROM part WHERE nullif(p_size, 7) <> 18.5
UNION ALL SELECT p_partkey, p_size, 'wide' FROM part WHERE p_size > -3000000000
""")
def q_filter_fractional_bound(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_size")
    some = p.withColumn("p_size", F.nullif(F.col("p_size"), F.lit(7)))
    tests = {"gt": R.filter_gt(p, "p_size", 18.5), "quoted": R.filter_gt_quoted(p, "p_size", "20.5"), "eq": R.filter_eq_int(p, "p_size", 18.5),
             "neq": R.filter_neq(some, "p_size", 18.5), "wide": R.filter_gt(p, "p_size", -3000000000)}
    return reduce(DataFrame.unionByName, [d.withColumn("test", F.lit(n)) for n, d in tests.items()])


@register("filter_gt_quoted", "O", section="B5",
          sql="SELECT * FROM customer WHERE c_acctbal > CAST('1000' AS DOUBLE)")
def q_filter_gt_quoted(spark, sf):
    return R.filter_gt_quoted(load(spark, sf, "customer"), "c_acctbal", "1000")


@register("filter_type_mismatch", "O", section="B6", sql="""
SELECT * FROM customer WHERE TRY_CAST(substr(c_name, 10) AS BIGINT) = 1234
""")
def q_filter_type_mismatch(spark, sf):
    return R.filter_type_mismatch(load(spark, sf, "customer"), F.substr("c_name", F.lit(10)), 1234)


@register("like_prefix", "O", section="B7", sql="SELECT * FROM part WHERE p_name LIKE 'red%'")
def q_like_prefix(spark, sf):
    return R.like_prefix(load(spark, sf, "part"), "p_name", "red")


@register("like_suffix", "O", section="B8", sql="SELECT * FROM part WHERE p_name LIKE '%gear'")
def q_like_suffix(spark, sf):
    return R.like_suffix(load(spark, sf, "part"), "p_name", "gear")


@register("like_single_char", "O", section="B9", sql="SELECT * FROM region WHERE r_name LIKE '_SIA'")
def q_like_single_char(spark, sf):
    return R.like_single_char(load(spark, sf, "region"), "r_name", "_SIA")


@register("filter_or", "O", section="B10",
          sql="SELECT * FROM part WHERE p_size = 1 OR p_brand = 'Brand#13'")
def q_filter_or(spark, sf):
    return R.filter_or(load(spark, sf, "part"),
                       [F.col("p_size") == 1, F.col("p_brand") == "Brand#13"])


@register("filter_and_prefix", "O", section="B11", sql="""
SELECT * FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 30
""")
def q_filter_and_prefix(spark, sf):
    return R.filter_and_prefix(load(spark, sf, "lineitem"), [
        F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_quantity") > 30])


@register("filter_neq", "O", section="B12", sql="SELECT * FROM orders WHERE o_orderstatus <> 'F'")
def q_filter_neq(spark, sf):
    return R.filter_neq(load(spark, sf, "orders"), "o_orderstatus", "F")


@register("arith_increment", "O", section="B13", sql="""
SELECT p_partkey, p_name, p_brand, p_type, p_size + 1 AS p_size, p_retailprice FROM part
""")
def q_arith_increment(spark, sf):
    return R.arith_increment(load(spark, sf, "part"), "p_size", 1)


@register("bound_params", "O", section="B14",
          sql="SELECT * FROM part WHERE p_brand = 'Brand#13' AND p_size > 20")
def q_bound_params(spark, sf):
    return R.bound_params(spark, "SELECT * FROM {part} WHERE p_brand = :brand AND p_size > :size",
                          {"brand": "Brand#13", "size": 20}, part=load(spark, sf, "part"))


@register("format_row", "O", section="B15", sql="""
SELECT *, printf('name=%s,segment=%s,nation=%d,balance=%d',
                 c_name, c_mktsegment, c_nationkey, CAST(trunc(c_acctbal) AS BIGINT)) AS line
FROM customer
""")
def q_format_row(spark, sf):
    return R.format_row(load(spark, sf, "customer"),
                        "name=%s,segment=%s,nation=%d,balance=%d",
                        ["c_name", "c_mktsegment", "c_nationkey",
                         F.col("c_acctbal").cast("bigint")])


# ------------------------------------------------------------------ C


@register("inner_join", "O", section="C1", sql="""
SELECT c.c_custkey, c.c_name, n.n_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def q_inner_join(spark, sf):
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    return R.inner_join(c, n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "n_name")


@register("left_join", "O", section="C2", sql=f"""
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice
FROM customer c LEFT JOIN (SELECT * FROM orders WHERE {YEAR_1996}) o ON c.c_custkey = o.o_custkey
""")
def q_left_join(spark, sf):
    c, o = load(spark, sf, "customer"), _orders_1996(spark, sf)
    return R.left_join(c, o, c.c_custkey == o.o_custkey).select(
        "c_custkey", "c_name", "o_orderkey", "o_totalprice")


_SIDES = f"""
(SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 10) c
{{how}} JOIN (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {YEAR_1996}) o
ON c.c_custkey = o.o_custkey
"""


def _filtered_sides(spark, sf):
    c = load(spark, sf, "customer").filter(F.col("c_nationkey") < 10).select("c_custkey", "c_name")
    o = _orders_1996(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    return c, o


@register("right_join", "O", section="C3",
          sql="SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice FROM "
              + _SIDES.format(how="RIGHT"))
def q_right_join(spark, sf):
    c, o = _filtered_sides(spark, sf)
    return R.right_join(c, o, c.c_custkey == o.o_custkey)


@register("full_join", "O", section="C4",
          sql="SELECT c_custkey, c_name, o_orderkey, o_custkey, o_totalprice FROM "
              + _SIDES.format(how="FULL"))
def q_full_join(spark, sf):
    c, o = _filtered_sides(spark, sf)
    return R.full_join(c, o, c.c_custkey == o.o_custkey)


@register("fk_lookup_join", "O", section="C5", sql="""
SELECT s.s_suppkey, s.s_name, s.s_nationkey, n.n_name, r.r_name
FROM supplier s
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def q_fk_lookup_join(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    sn = R.fk_lookup_join(s, n, "s_nationkey", "n_nationkey", ["n_name", "n_regionkey"])
    snr = R.fk_lookup_join(sn, r, "n_regionkey", "r_regionkey", ["r_name"])
    return snr.select("s_suppkey", "s_name", "s_nationkey", "n_name", "r_name")


# ------------------------------------------------------------------ D


@register("agg_count", "O", section="D1", sql="SELECT count(*) AS n FROM lineitem")
def q_agg_count(spark, sf):
    return R.agg_count(load(spark, sf, "lineitem"))


@register("agg_sum", "R", section="D2",
          sql="SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem")
def q_agg_sum(spark, sf):
    return R.agg_sum(load(spark, sf, "lineitem"), "l_extendedprice").select(
        F.round("value", 2).alias("value"))


@register("agg_avg", "R", section="D3",
          sql="SELECT round(avg(l_quantity), 8) AS value FROM lineitem")
def q_agg_avg(spark, sf):
    return R.agg_avg(load(spark, sf, "lineitem"), "l_quantity").select(
        F.round("value", 8).alias("value"))


@register("agg_max", "O", section="D4", sql="SELECT max(l_extendedprice) AS value FROM lineitem")
def q_agg_max(spark, sf):
    return R.agg_max(load(spark, sf, "lineitem"), "l_extendedprice")


@register("agg_min", "O", section="D5", sql="SELECT min(l_extendedprice) AS value FROM lineitem")
def q_agg_min(spark, sf):
    return R.agg_min(load(spark, sf, "lineitem"), "l_extendedprice")


@register("group_by_avg", "R", section="D6", sql="""
SELECT c_nationkey, round(avg(c_acctbal), 6) AS avg_acctbal FROM customer GROUP BY c_nationkey
""")
def q_group_by_avg(spark, sf):
    g = R.group_by_avg(load(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "avg_acctbal")
    return g.select("c_nationkey", F.round("avg_acctbal", 6).alias("avg_acctbal"))


@register("having_filter", "R", section="D7", sql="""
SELECT c_nationkey, round(avg(c_acctbal), 6) AS avg_acctbal, count(*) AS n
FROM customer GROUP BY c_nationkey HAVING avg(c_acctbal) > 4500
""")
def q_having_filter(spark, sf):
    g = R.having_filter(load(spark, sf, "customer"), ["c_nationkey"],
                        {"avg_acctbal": F.avg("c_acctbal"), "n": F.count(F.lit(1))},
                        F.col("avg_acctbal") > 4500)
    return g.select("c_nationkey", F.round("avg_acctbal", 6).alias("avg_acctbal"), "n")


@register("where_then_having", "R", section="D8", sql="""
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus = 'F'
GROUP BY o_orderpriority HAVING count(*) > 1000
""")
def q_where_then_having(spark, sf):
    g = R.where_then_having(load(spark, sf, "orders"), F.col("o_orderstatus") == "F",
                            ["o_orderpriority"],
                            {"n": F.count(F.lit(1)), "total": F.sum("o_totalprice")},
                            F.col("n") > 1000)
    return g.select("o_orderpriority", "n", F.round("total", 2).alias("total"))


# ------------------------------------------------------------------ E


@register("in_subquery", "O", section="E2", sql=f"""
SELECT c_custkey, c_name, 'in' AS membership FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {YEAR_1996} AND o_orderpriority = '1-URGENT')
UNION ALL
SELECT c_custkey, c_name, 'not_in' AS membership FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {YEAR_1996} AND o_orderpriority = '1-URGENT')
""")
def q_in_subquery(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    sub = _orders_1996(spark, sf).filter(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    yes = R.in_subquery(c, "c_custkey", sub).withColumn("membership", F.lit("in"))
    no = R.in_subquery(c, "c_custkey", sub, negate=True).withColumn("membership", F.lit("not_in"))
    return yes.unionByName(no)


@register("compare_all_any", "O", section="E3", sql="""
SELECT p_partkey, p_retailprice, 'all' AS quantifier FROM part
WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size = 50)
UNION ALL
SELECT p_partkey, p_retailprice, 'any' AS quantifier FROM part
WHERE p_retailprice < ANY (SELECT p_retailprice FROM part WHERE p_size = 50 AND p_brand = 'Brand#1')
""")
def q_compare_all_any(spark, sf):
    p = load(spark, sf, "part")
    s1 = p.filter(F.col("p_size") == 50).select("p_retailprice")
    s2 = p.filter((F.col("p_size") == 50) & (F.col("p_brand") == "Brand#1")).select("p_retailprice")
    a = R.compare_all_any(p.select("p_partkey", "p_retailprice"), "p_retailprice", ">", s1, "all")
    b = R.compare_all_any(p.select("p_partkey", "p_retailprice"),
                          "p_retailprice", "<", s2, "any")
    return (a.withColumn("quantifier", F.lit("all"))
            .unionByName(b.withColumn("quantifier", F.lit("any"))))


@register("exists_cardinality", "O", section="E4", sql=f"""
SELECT c_custkey, c_name, 'at_least_3' AS test FROM customer c
WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND {YEAR_1996}) >= 3
UNION ALL
SELECT c_custkey, c_name, 'not_exists' AS test FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND {YEAR_1996})
""")
def q_exists_cardinality(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    o = _orders_1996(spark, sf)
    many = R.exists_cardinality(c, {"c_custkey": "o_custkey"}, o, at_least=3)
    none = R.exists_cardinality(c, {"c_custkey": "o_custkey"}, o, negate=True)
    return (many.withColumn("test", F.lit("at_least_3"))
            .unionByName(none.withColumn("test", F.lit("not_exists"))))


@register("scalar_subquery", "R", section="E5", sql="""
SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM customer), 6) AS vs_mean
FROM customer
""")
def q_scalar_subquery(spark, sf):
    c = load(spark, sf, "customer")
    out = R.scalar_subquery(c, "mean_bal", c.agg(F.avg("c_acctbal")))
    return out.select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean_bal"), 6).alias("vs_mean"))


# ------------------------------------------------------------------ F

_LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                   "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                   "l_shipdate"]


@register("global_sort", "O", section="F1", sql=f"""
SELECT *, row_number() OVER (ORDER BY {", ".join(c + " NULLS FIRST" for c in _LINEITEM_ORDER)}) AS rank
FROM lineitem
""")
def q_global_sort(spark, sf):
    return R.global_sort(load(spark, sf, "lineitem"), [F.col(c).asc_nulls_first() for c in _LINEITEM_ORDER])
