"""Randomized checks (hypothesis) of the subtle semantics against references."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.rank import rank_within
from quarry.functions.scan import running_sum
from quarry.operators import relational as R

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
small_int = st.one_of(st.none(), st.integers(-3, 3))


def _values_sql(name, col, xs):
    if not xs:
        return f"(SELECT CAST(NULL AS INTEGER) AS {col} WHERE false) {name}"
    rows = ",".join(f"({'NULL' if x is None else x}::INTEGER)" for x in xs)
    return f"(VALUES {rows}) {name}({col})"


@SETTINGS
@given(st.lists(small_int, max_size=8), st.lists(small_int, max_size=5),
       st.sampled_from([">", ">=", "<", "<="]), st.sampled_from(["all", "any"]))
def test_quantified_and_not_in(spark, xs, subs, op, q):
    outer = spark.createDataFrame([(x,) for x in xs], "x int")
    inner = spark.createDataFrame([(s,) for s in subs], "s int")
    o, s = _values_sql("o", "x", xs), _values_sql("t", "s", subs)
    got = sorted([r.x for r in R.compare_all_any(outer, "x", op, inner, q).collect()], key=repr)
    want = sorted([r[0] for r in duckdb.sql(f"SELECT x FROM {o} WHERE x {op} {q.upper()} (SELECT s FROM {s})").fetchall()], key=repr)
    assert got == want
    got = sorted([r.x for r in R.in_subquery(outer, "x", inner, negate=True).collect()], key=repr)
    want = sorted([r[0] for r in duckdb.sql(f"SELECT x FROM {o} WHERE x NOT IN (SELECT s FROM {s})").fetchall()], key=repr)
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(-5, 5)), min_size=1, max_size=60),
       st.integers(1, 9))
def test_running_sum_and_rank(spark, rows, block):
    rows = [(g, i, float(v)) for i, (g, _, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g int, t int, v double").repartition(3)
    w = Window.partitionBy("g").orderBy("t")
    ref = {(r.g, r.t): (r.c, r.n) for r in df.select(
        "g", "t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
        F.row_number().over(w).alias("n")).collect()}
    got = {(r.g, r.t): r.cum_v for r in running_sum(df, ["g"], ["t"], ["v"], block_rows=block).collect()}
    assert got == {k: v[0] for k, v in ref.items()}
    got = {(r.g, r.t): r.rank for r in rank_within(df, ["g"], ["t"]).collect()}
    assert got == {k: v[1] for k, v in ref.items()}
