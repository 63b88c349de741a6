"""Odd inputs: fractional bounds, zero likelihoods, NULL keys, gaps, lost races."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import business as B
from quarry.operators import imbalance as G
from quarry.operators import models as J
from quarry.operators import quality as Q
from quarry.operators import relational as R
from quarry.operators import stats as H
from quarry.session import work_path
from quarry.sources import changes as C

VALUES = [None, -2147483648, -21, -20, 0, 18, 19, 20, 21, 2147483647]


@pytest.mark.parametrize("value", [18, "18", 18.5, -20.5, "20.5", 3000000000, -3000000000, "1e3", 2147483647, -2147483648, float("inf")])
def test_whole_number_columns_meet_any_number(spark, value):
    df = spark.createDataFrame([(v,) for v in VALUES], "x int")
    number = float(value)
    have = [v for v in VALUES if v is not None]
    for run, want in ((R.filter_gt, [v for v in have if v > number]), (R.filter_gt_quoted, [v for v in have if v > number]),
                      (R.filter_eq_int, [v for v in have if v == number]), (R.filter_neq, [v for v in have if v != number])):
        assert sorted(r.x for r in run(df, "x", value).collect()) == sorted(want)


def test_text_that_is_no_number_and_floats(spark):
    df = spark.createDataFrame([(0.1, 0.1, "a")], "f float, d double, s string")
    assert R.filter_gt(df, "f", 0.1).count() == 1  # the float next to 0.1 is above it
    assert R.filter_eq_int(df, "f", 0.1).count() == 0 and R.filter_neq(df, "f", 0.1).count() == 1
    assert R.filter_gt(df, "d", 0.1).count() == 0 and R.filter_gt_quoted(df, "d", "0.05").count() == 1
    assert R.filter_gt_quoted(df, "d", "abc").count() == 0 and R.filter_neq(df, "s", "b").count() == 1
    ints = spark.createDataFrame([(1,)], "x int")
    assert R.filter_gt_quoted(ints, "x", "abc").count() == 0


def test_bound_is_pushed(spark):
    path = work_path(spark, "ints")
    spark.range(100).selectExpr("cast(id as int) as x").write.parquet(path)
    plan = R.filter_gt(spark.read.parquet(path), "x", 18.5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,18)" in plan


def test_format_row_truncates_floats(spark):
    df = spark.createDataFrame([(2000.9, "a", -1.5, 3)], "f double, s string, g float, i int")
    assert R.format_row(df, "%d|%s|%2$s|%d|%05d|100%%", ["f", "s", "g", "i"]).first().line == "2000|a|a|-1|00003|100%"


def test_bayes_update_with_zero_and_unseen_evidence(spark):
    ev = spark.createDataFrame([(1, 7, "x"), (2, 7, "y"), (3, 7, "z"), (4, 8, "z"), (5, 8, "y"), (6, 9, "both")], "t int, u int, o string")
    priors = spark.createDataFrame([("h1", 0.5), ("h2", 0.5), ("h3", 0.0)], "hypothesis string, prior double")
    lik = spark.createDataFrame([("h1", "x", 0.0), ("h2", "x", 0.3), ("h1", "y", 0.8), ("h2", "y", 0.2), ("h3", "y", 1.0), ("h3", "both", 0.5)],
                                "hypothesis string, o string, likelihood double")
    out = {(r.t, r.hypothesis): r.posterior for r in H.bayes_update(ev, "u", ["t"], "o", priors, lik, id_cols=["t"]).collect()}
    assert len(out) == 18
    for t in (1, 2, 3):  # x rules h1 out for good; z is unknown to all
        assert out[t, "h1"] == 0.0 and out[t, "h2"] == 1.0 and out[t, "h3"] == 0.0
    assert out[4, "h1"] == 0.5 and abs(out[5, "h1"] - 0.8) < 1e-12
    assert all(out[6, h] is None for h in ("h1", "h2", "h3"))  # only h3 knows it, and h3 has prior 0


def test_bayes_update_with_many_hypotheses(spark):
    ev = spark.createDataFrame([(1, 1, "a")], "t int, u int, o string")
    priors = spark.range(1500).selectExpr("cast(id as string) as hypothesis", "1 / 1500 as prior")
    lik = spark.range(1500).selectExpr("cast(id as string) as hypothesis", "'a' as o", "(id + 1) / 2000 as likelihood")
    out = H.bayes_update(ev, "u", ["t"], "o", priors, lik, id_cols=["t"])
    assert out.count() == 1500 and abs(out.agg(F.sum("posterior")).first()[0] - 1) < 1e-9


def test_undersample_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (3, 1)] + [(i, 0) for i in range(50)], "k int, y int")
    out = G.undersample(df, "y", "k", "s")
    assert out.filter("y = 1").count() == 3 and out.filter("y = 0").count() == 3


def test_active_time_after_a_gap(spark):
    ev = spark.createDataFrame([(1, 2.0, "2024-01-01"), (2, 4.0, "2024-01-01"), (1, 6.0, "2024-01-05"), (2, 6.0, "2024-01-05")],
                               "u int, d double, day string").withColumn("ts", F.col("day").cast("timestamp"))
    groups = spark.createDataFrame([(1, "a"), (2, "b")], "u2 int, g string")
    last = B.active_time_trend(ev, "u", "d", "ts", "day", groups, "u2", "g").orderBy("period").collect()[-1]
    assert last.delta == 3.0 and last.mix + last.within == 3.0


def test_sample_ratio_counts_an_empty_arm(spark):
    df = spark.createDataFrame([(i, "A") for i in range(100)] + [(None, None)], "id int, arm string")
    rows = {r.arm: r for r in B.srm_check(df, {"A": 0.5, "B": 0.5}).collect()}
    assert rows["B"].n == 0 and rows["A"].chi2 == 100.0 and rows["A"].p < 1e-20
    ids = spark.createDataFrame([(None,), (1,)], "id int")
    assert {r.id: r.arm for r in B.ab_assign(ids, "id", "s", {"A": 1.0}).collect()} == {None: None, 1: "A"}


def test_no_spread_and_no_change_give_null(spark):
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, v double")
    t = H.hypothesis_test(flat, "g", "v", "a", "b").first()
    assert t.t is None and t.dof is None and (t.p is None or math.isnan(t.p))
    assert B.ab_test(flat, "g", "v", "a", "b").first().diff == 0.0
    moments = H.combine_moments(H.partial_moments(flat, ["g"], "v"), "g")
    assert {r.g: r["var"] for r in moments.collect()} == {"a": 0.0, "b": None}
    assert J.standardise(flat, ["v"]).filter("v_z is not null").count() == 0
    assert J.standardise(flat, ["v"], "minmax").filter("v_mm is not null").count() == 0
    sales = spark.createDataFrame([("a", 1.0, "2024-01-01"), ("a", 1.0, "2024-02-01")], "c string, v double, d string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    a, b, none = ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-28"), ("2020-01-01", "2020-02-01")
    assert B.gmv_change(sales, "c", F.col("v"), "ts", a, b).first().share is None
    drivers = {r.driver: r.log_effect for r in B.gmv_drivers(sales, "c", "v", "ts", a, none).collect()}
    assert drivers["orders_per_buyer"] is None


def test_cooccurrence_of_a_giant_basket(spark):
    rows = [(1, i) for i in range(300)] + [(b, i) for b in (2, 3) for i in (1, 2)] + [(None, 1), (2, None), (2, 2)]
    df = spark.createDataFrame(rows, "b int, i int")
    for block in (8, 1000):
        out = B.item_cooccurrence(df, "b", "i", 0.0, 400, block=block)
        assert out.count() == 300 * 299
        best = out.filter("item = 1 and rank = 1").first()
        assert (best.other, best.n, best.support) == (2, 3, 1.0)
    assert B.item_cooccurrence(df, "b", "i", 0.9, 5).count() == 2


def test_candidate_fk_of_text(spark):
    child = spark.createDataFrame([(1, "1", "x"), (2, "7", "y"), (None, None, "1")], "a int, b string, c string")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    got = {r.column_name: (r.distinct_values, r.found) for r in Q.candidate_fk_profile(child, ["a", "b", "c"], parent, "id").collect()}
    assert got == {"a": (2, 2), "b": (2, 1), "c": (3, 1)}


SCHEMA = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("age", T.IntegerType(), True)])


def _table(spark, name, **rules):
    path = work_path(spark, name)
    C.create_table(spark, path, SCHEMA, **rules)
    return path


def _rows(spark, path):
    return sorted((r.k, r.age) for r in C.read_table(spark, path).collect())


def _batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_writer_that_comes_second_checks_again(spark, monkeypatch):
    path = _table(spark, "race", key=["k"])
    real, raced = C._commit, []

    def late(sp, table, version, state):
        if not raced:
            raced.append(1)
            assert all(r.committed for r in C.atomic_batch(sp, path, _batch(sp, [(1, 10)])).collect())
        real(sp, table, version, state)
    monkeypatch.setattr(C, "_commit", late)
    ok = C.atomic_batch(spark, path, _batch(spark, [(2, 20)])).collect()
    assert all(r.committed for r in ok) and _rows(spark, path) == [(1, 10), (2, 20)]
    raced.clear()

    def late_same_key(sp, table, version, state):
        if not raced:
            raced.append(1)
            C.atomic_batch(sp, path, _batch(sp, [(3, 1)]))
        real(sp, table, version, state)
    monkeypatch.setattr(C, "_commit", late_same_key)
    refused = C.atomic_batch(spark, path, _batch(spark, [(3, 2)])).collect()
    assert not any(r.committed for r in refused) and _rows(spark, path) == [(1, 10), (2, 20), (3, 1)]


def test_numbered_batches_belong_to_their_writer(spark):
    path = _table(spark, "numbers")
    C.atomic_batch(spark, path, _batch(spark, [(1, 1)]))
    C.atomic_batch(spark, path, _batch(spark, [(2, 2)]), writer="w", batch_number=0)
    C.atomic_batch(spark, path, _batch(spark, [(2, 2)]), writer="w", batch_number=0)
    C.atomic_batch(spark, path, _batch(spark, [(3, 3)]), writer="v", batch_number=0)
    assert _rows(spark, path) == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(ValueError):
        C.atomic_batch(spark, path, _batch(spark, [(4, 4)]), batch_number=1)


def test_unknown_columns_bad_types_and_no_rules(spark):
    path = _table(spark, "odd", key=["k"])
    with pytest.raises(ValueError):
        C.atomic_batch(spark, path, spark.createDataFrame([(1, 2)], "k long, agee int"))
    with pytest.raises(ValueError):
        C.insert_batch(_batch(spark, [(1, 1)]), spark.createDataFrame([(2, 2)], "k long, agee int"))
    got = {r.rule: (r.violations, r.committed) for r in C.atomic_batch(spark, path, spark.createDataFrame([("1", "abc"), ("2", "5")], "k string, age string")).collect()}
    assert got["type"] == (1, False) and _rows(spark, path) == []
    assert all(r.committed for r in C.atomic_batch(spark, path, spark.createDataFrame([("2", "5")], "k string, age string")).collect())
    free = work_path(spark, "free")
    C.create_table(spark, free, T.StructType([T.StructField("a", T.IntegerType(), True)]))
    assert all(r.committed for r in C.atomic_batch(spark, free, spark.createDataFrame([(1,)], "a int")).collect())
    assert C.read_table(spark, free).count() == 1


def test_declared_keys_and_foreign_keys(spark):
    parent = _table(spark, "parent", key=["k"])
    C.atomic_batch(spark, parent, _batch(spark, [(1, 1), (2, 2)]))
    child = _table(spark, "child", key=["k"], foreign=[(["age"], parent, ["k"])])
    good = {r.rule: r.violations for r in C.atomic_batch(spark, child, _batch(spark, [(10, 1), (11, None)])).collect()}
    assert good == {"primary_key": 0, "foreign_key": 0, "not_null": 0}
    bad = {r.rule: r.violations for r in C.atomic_batch(spark, child, _batch(spark, [(10, 2), (12, 9)])).collect()}
    assert bad["primary_key"] == 1 and bad["foreign_key"] == 1 and len(_rows(spark, child)) == 2


def test_update_and_delete_commit_or_refuse(spark):
    path = _table(spark, "change", key=["k"])
    C.atomic_batch(spark, path, _batch(spark, [(1, 10), (2, None), (3, 30)]))
    done = C.change_table(spark, path, lambda t: C.update_where(t, F.col("age") > 5, {"age": F.col("age") + 1}))
    assert done.filter("committed").count() and _rows(spark, path) == [(1, 11), (2, None), (3, 31)]
    refused = C.change_table(spark, path, lambda t: C.update_where(t, F.col("k") < 3, {"k": F.lit(1)}))
    assert not refused.filter("committed").count() and _rows(spark, path) == [(1, 11), (2, None), (3, 31)]
    C.change_table(spark, path, lambda t: C.delete_where(t, F.col("age") > 20))
    assert _rows(spark, path) == [(1, 11), (2, None)]


def test_create_table_spares_other_folders(spark):
    path = work_path(spark, "foreign")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError):
        C.create_table(spark, path, SCHEMA)
    assert spark.read.parquet(path).count() == 3


def test_divide_and_conquer_regression_is_the_mean_of_its_models(spark):
    rows = [(i, [float(i % 10), float(i % 7)], int(i % 9 == 0), 2.0 * (i % 10) - (i % 7) + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y int, v double")
    out = G.divide_conquer_ensemble(df, "x", "y", 1, n_models=3, value="v").collect()
    assert len(out) == 200
    for r in out:
        assert abs(r.prediction - r.votes / 3) < 1e-9 and abs(r.prediction - r.v) < 0.5


def test_gaussian_mixture_scores_and_outliers(spark):
    import numpy as np

    from quarry.operators.mixture import Mixture
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(20, 2, (150, 2))])
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "id int, x array<double>, y int")
    means, covs, weights = [[0.0, 0.0], [20.0, 20.0]], [np.array([[1.0, 0.3], [0.3, 2.0]]), np.eye(2) * 4], [0.4, 0.6]
    model = Mixture(np.array(weights), np.array(means), np.array(covs))
    got = {r.id: r.s for r in df.select("id", (-model.log_density("x")).alias("s")).collect()}
    for i, v in enumerate(x):
        density = sum(w * np.exp(-0.5 * (v - m) @ np.linalg.inv(c) @ (v - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in zip(weights, means, covs))
        assert abs(got[i] + np.log(density)) < 1e-6 * (1 + abs(got[i]))
    out = G.anomaly_then_classify(df, "x", "y", 1, share=0.1, k=2, method="mixture")
    assert out.filter("outlier").count() == 30
    low, high = out.agg(F.min(F.when(F.col("outlier"), F.col("score"))), F.max(F.when(~F.col("outlier"), F.col("score")))).first()
    assert low > high


def test_smote_of_a_single_row_and_exact_quantile(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1)] + [(i, [float(i), 0.0], 0) for i in range(2, 12)], "id int, x array<double>, y int")
    assert [tuple(r.x) for r in G.smote(df, "id", "x", "y", 1, k=3, per_row=2).collect()] == [(1.0, 2.0)] * 2
    values = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 4, 2, None, 9, 9] if v is not None] + [(None,)], "v double")
    ordered = [1, 1, 2, 4, 5, 9, 9]
    for q in (0.0, 0.1, 0.3, 0.5, 0.9, 1.0):
        assert H.exact_quantile(values, "v", q) == ordered[max(1, math.ceil(q * 7 - 1e-9)) - 1]
    assert H.exact_quantile(values.limit(0), "v", 0.5) is None
