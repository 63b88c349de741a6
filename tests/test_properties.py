"""Property tests for the rows SQL cannot check, and the laws SURVEY §5 names."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import business as B
from quarry.operators import imbalance as G
from quarry.operators import models as J
from quarry.operators import quality as Q
from quarry.operators import relational as R
from quarry.operators import stats as H
from quarry.plans.registry import load_all
from quarry.session import work_path
from quarry.sources import changes as C
from quarry.sources import layout as L
from quarry.sources.tables import load
from tests.conftest import SF001

# ------------------------------------------------------------------ fixtures from FIXTURES.md

EMPLOYEE = T.StructType([
    T.StructField("FIRST_NAME", T.StringType(), False),
    T.StructField("LAST_NAME", T.StringType(), True),
    T.StructField("AGE", T.IntegerType(), True),
    T.StructField("SEX", T.StringType(), True),
    T.StructField("INCOME", T.FloatType(), True),
])
EMPLOYEE_LENGTHS = {"FIRST_NAME": "char(20)", "LAST_NAME": "char(20)", "SEX": "char(1)"}


@pytest.fixture()
def employees(spark):
    rows = [("Mac", "Mohan", 20, "M", 2000.0), ("Ann", None, 35, "F", 5200.5),
            ("Bo", "Li", None, "M", 900.0), ("Cy", "Ng", 41, None, None),
            ("Di", "Wu", 18, "F", 1000.0), ("Ed", "Ho", 52, "M", 15000.0)]
    return spark.createDataFrame(rows, EMPLOYEE)


def test_employee_table_and_refused_batch(spark, employees):
    path = work_path(spark, "employee")
    C.create_table(spark, path, EMPLOYEE)
    v = C.atomic_batch(spark, path, employees, key=["FIRST_NAME"], lengths=EMPLOYEE_LENGTHS).collect()
    assert all(r.committed and r.violations == 0 for r in v)
    before = sorted(C.read_table(spark, path).collect())
    # the reference's batch: SEX values overflow CHAR(1) -> the whole batch is refused
    bad = spark.createDataFrame([("xiaoming", 31, "boy"), ("hong", 22, "girl"), ("wang", 90, "man")],
                                "FIRST_NAME string, AGE int, SEX string")
    v = {r.rule: r for r in C.atomic_batch(spark, path, bad, key=["FIRST_NAME"],
                                           lengths=EMPLOYEE_LENGTHS).collect()}
    assert v["length_type"].violations == 3 and not v["length_type"].committed
    assert sorted(C.read_table(spark, path).collect()) == before
    # NOT NULL and key repeats are refused too
    dup = spark.createDataFrame([("Mac", 1), (None, 2)], "FIRST_NAME string, AGE int")
    v = {r.rule: r.violations for r in C.atomic_batch(spark, path, dup, key=["FIRST_NAME"]).collect()}
    assert v["primary_key"] == 2 and v["not_null"] == 1
    assert sorted(C.read_table(spark, path).collect()) == before
    # a good batch lands whole, missing columns become NULL
    good = spark.createDataFrame([("Fay", 29, "F")], "FIRST_NAME string, AGE int, SEX string")
    assert all(r.committed for r in C.atomic_batch(spark, path, good, key=["FIRST_NAME"],
                                                   lengths=EMPLOYEE_LENGTHS).collect())
    after = C.read_table(spark, path)
    assert after.count() == len(before) + 1
    assert after.filter("FIRST_NAME = 'Fay'").first().INCOME is None


def test_reference_queries_on_employee(spark, employees):
    # INCOME > '1000' is numeric; UPDATE ... AGE + 1 WHERE SEX = 'M'; DELETE WHERE AGE > '20'
    rich = R.filter_gt_quoted(employees, "INCOME", "1000")
    assert {r.FIRST_NAME for r in rich.collect()} == {"Mac", "Ann", "Ed"}
    upd = C.update_where(employees, F.col("SEX") == "M", {"AGE": F.col("AGE") + 1})
    ages = {r.FIRST_NAME: r.AGE for r in upd.collect()}
    assert ages == {"Mac": 21, "Ann": 35, "Bo": None, "Cy": 41, "Di": 18, "Ed": 53}
    kept = C.delete_where(employees, F.col("AGE") > F.lit("20").cast("int"))
    # the NULL-age row stays: its predicate is NULL, not TRUE
    assert {r.FIRST_NAME for r in kept.collect()} == {"Mac", "Bo", "Di"}
    line = R.format_row(employees.filter("FIRST_NAME = 'Mac'"), "fname=%s,lname=%s,age=%d,sex=%s,income=%d",
                        ["FIRST_NAME", "LAST_NAME", "AGE", "SEX", F.col("INCOME").cast("bigint")]).first().line
    assert line == "fname=Mac,lname=Mohan,age=20,sex=M,income=2000"
    one = R.filter_eq_string(employees, "FIRST_NAME", "xiaoming")
    assert one.isEmpty()


def test_insert_partial_fills_null(spark, employees):
    out = C.insert_partial(employees, [("xiaoming", 31, "b")], ["FIRST_NAME", "AGE", "SEX"])
    row = out.filter("FIRST_NAME = 'xiaoming'").first()
    assert row.LAST_NAME is None and row.INCOME is None and out.schema == employees.schema


def test_bound_params_do_not_splice(spark, employees):
    out = R.bound_params(spark, "SELECT * FROM {t} WHERE FIRST_NAME = :n", {"n": "x' OR '1'='1"}, t=employees)
    assert out.count() == 0


# ------------------------------------------------------------------ subquery laws


def test_aggregate_in_where_is_refused(spark):
    from pyspark.errors import AnalysisException
    c = load(spark, SF001, "customer")
    with pytest.raises(AnalysisException):
        R.where_then_having(c, F.avg("c_acctbal") > 1, ["c_nationkey"], {"n": F.count(F.lit(1))},
                            F.col("n") > 0).collect()


def test_active_time_trend_week_and_split(spark):
    ev = load(spark, SF001, "events")
    out = B.active_time_trend(ev, "user_id", "value", "ts", "week", load(spark, SF001, "customer"),
                              "c_custkey", "c_mktsegment").orderBy("period").collect()
    assert len(out) >= 4 and out[0].delta is None
    for r in out[1:]:
        assert abs(r.delta - (r.mix + r.within)) < 1e-9 * max(1.0, abs(r.delta))


def test_derived_table_equals_having(spark):
    c = load(spark, SF001, "customer")
    a = R.derived_table_filter(c, ["c_nationkey"], "c_acctbal", 4500.0, "m")
    b = R.having_filter(c, ["c_nationkey"], {"m": F.avg("c_acctbal")}, F.col("m") > 4500)
    assert sorted(a.collect()) == sorted(b.collect())


def _duck_rows(sql):
    import duckdb
    return sorted(duckdb.sql(sql).fetchall(), key=repr)


@pytest.mark.parametrize("sub", [[1, 2], [1, None], [], [None]])
def test_not_in_and_quantifiers_match_duckdb(spark, sub):
    xs = [0, 1, 2, 3, None]
    outer = spark.createDataFrame([(x,) for x in xs], "x int")
    inner = spark.createDataFrame([(s,) for s in sub], "s int")
    vals = "(VALUES " + ",".join(f"({'NULL' if x is None else x})" for x in xs) + ") o(x)"
    sub_sql = ("SELECT s FROM (VALUES " + ",".join(f"({'NULL' if s is None else s}::INTEGER)" for s in sub)
               + ") t(s)") if sub else "SELECT s FROM (SELECT 1::INTEGER AS s) t WHERE false"
    cases = {
        "not_in": (R.in_subquery(outer, "x", inner, negate=True), f"SELECT x FROM {vals} WHERE x NOT IN ({sub_sql})"),
        "in": (R.in_subquery(outer, "x", inner), f"SELECT x FROM {vals} WHERE x IN ({sub_sql})"),
        "gt_all": (R.compare_all_any(outer, "x", ">", inner, "all"), f"SELECT x FROM {vals} WHERE x > ALL ({sub_sql})"),
        "gt_any": (R.compare_all_any(outer, "x", ">", inner, "any"), f"SELECT x FROM {vals} WHERE x > ANY ({sub_sql})"),
        "le_all": (R.compare_all_any(outer, "x", "<=", inner, "all"), f"SELECT x FROM {vals} WHERE x <= ALL ({sub_sql})"),
        "lt_any": (R.compare_all_any(outer, "x", "<", inner, "any"), f"SELECT x FROM {vals} WHERE x < ANY ({sub_sql})"),
    }
    for name, (df, sql) in cases.items():
        assert sorted([tuple(r) for r in df.collect()], key=repr) == _duck_rows(sql), name


# ------------------------------------------------------------------ layout, keys


def test_clustered_write_ranges_do_not_overlap(spark):
    path = work_path(spark, "clustered")
    L.clustered_write(load(spark, SF001, "orders"), path, ["o_orderdate", "o_orderkey"], 6)
    df = spark.read.parquet(path).withColumn("f", F.input_file_name())
    ranges = sorted(tuple(r)[1:] for r in df.groupBy("f").agg(
        F.min(F.struct("o_orderdate", "o_orderkey")).alias("lo"),
        F.max(F.struct("o_orderdate", "o_orderkey")).alias("hi")).collect())
    for (lo1, hi1), (lo2, hi2) in zip(ranges, ranges[1:]):
        assert tuple(hi1) < tuple(lo2)


def test_file_sort_parquet_nulls_first(spark):
    df = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a")], "k int, v string")
    path = work_path(spark, "fs")
    df.write.parquet(path)
    out = L.file_sort(spark, path, "parquet", df.schema, [F.col("k").asc_nulls_first(), "v"])
    assert [(r.k, r["rank"]) for r in out.orderBy("rank").collect()] == [(None, 1), (1, 2), (3, 3)]


def test_length_policy(spark):
    df = spark.createDataFrame([("abcdef", 1), ("ab", 300)], "s string, n int")
    with pytest.raises(ValueError):
        Q.apply_length_policy(df, {"s": "char(3)"}, "reject")
    cut = Q.apply_length_policy(df, {"s": "char(3)"}, "truncate")
    assert {r.s for r in cut.collect()} == {"abc", "ab"}
    with pytest.raises(ValueError):
        Q.apply_length_policy(df, {"n": "tinyint"}, "truncate")


def test_auto_increment_contiguous(spark):
    batch = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "k")
    out = Q.auto_increment(batch, 500, ["k"], "id").orderBy("k").collect()
    assert [r.id for r in out] == list(range(501, 1501))


def test_fk_check_null_passes(spark):
    child = spark.createDataFrame([(1,), (None,), (9,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in Q.fk_check(child, parent, ["k"], ["k"]).collect()] == [9]


# ------------------------------------------------------------------ statistics laws


def test_total_probability_law(spark):
    r = H.total_probability(load(spark, SF001, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F").first()
    assert abs(r.p_total - r.p_direct) < 1e-12


def test_chi_square_matches_spark_ml(spark):
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    c = load(spark, SF001, "customer")
    ours = H.chi_square(c, "c_nationkey", "c_mktsegment").first()
    idx = StringIndexer(inputCol="c_mktsegment", outputCol="seg").fit(c).transform(c)
    vec = VectorAssembler(inputCols=["c_nationkey"], outputCol="f").transform(idx)
    ml = ChiSquareTest.test(vec, "f", "seg").first()
    assert abs(ours.stat - ml.statistics[0]) < 1e-6 and ours.dof == ml.degreesOfFreedom[0]
    assert abs(ours.p - ml.pValues[0]) < 1e-6


def test_welch_p_value(spark):
    out = H.hypothesis_test(load(spark, SF001, "orders"), "o_orderstatus", "o_totalprice", "F", "O").first()
    assert 0.0 <= out.p <= 1.0 and out.dof > 0


def test_srm_check(spark):
    a = B.ab_assign(load(spark, SF001, "customer"), "c_custkey", "exp1", {"A": 0.5, "B": 0.5})
    rows = B.srm_check(a, {"A": 0.5, "B": 0.5}).collect()
    assert sum(r.n for r in rows) == 1500 and all(abs(r.expected - 750) < 1e-9 for r in rows)


# ------------------------------------------------------------------ imbalance and models


def _emb(spark):
    return load(spark, SF001, "embeddings").withColumn(
        "is_minority", (F.col("label") == 3).cast("int"))


def test_oversample_equals_weight(spark):
    from pyspark.ml.classification import LogisticRegression
    from quarry.functions.vectors import as_vector
    e = _emb(spark).withColumn("v", as_vector("embedding"))
    over = G.oversample_copies(e, "is_minority", 1, 3)
    w = e.withColumn("w", F.when(F.col("is_minority") == 1, 3.0).otherwise(1.0))
    lr = dict(featuresCol="v", labelCol="y", regParam=0.05, maxIter=200, tol=1e-10, standardization=False)
    m1 = LogisticRegression(**lr).fit(over.withColumn("y", F.col("is_minority").cast("double")))
    m2 = LogisticRegression(weightCol="w", **lr).fit(w.withColumn("y", F.col("is_minority").cast("double")))
    assert np.allclose(m1.coefficients.toArray(), m2.coefficients.toArray(), atol=1e-4)


def test_smote_properties(spark):
    e = _emb(spark)
    syn = G.smote(e, "vec_id", "embedding", "is_minority", 1, k=5, per_row=2)
    mino = e.filter("is_minority = 1")
    assert syn.count() == mino.count() * 2
    x = np.array([r.embedding for r in mino.collect()], dtype=float)
    s = np.array([r.embedding for r in syn.collect()], dtype=float)
    assert (s >= x.min(0) - 1e-9).all() and (s <= x.max(0) + 1e-9).all()
    originals = {tuple(np.round(v, 9)) for v in x}
    assert not any(tuple(np.round(v, 9)) in originals for v in s)
    again = G.smote(e, "vec_id", "embedding", "is_minority", 1, k=5, per_row=2)
    assert sorted(map(tuple, again.select("vec_id", "copy").collect())) == sorted(
        map(tuple, syn.select("vec_id", "copy").collect()))


def test_near_neighbours_against_brute_force(spark):
    e = load(spark, SF001, "embeddings").filter("label = 3")
    pdf = e.toPandas()
    x = np.stack(pdf.embedding.to_numpy()).astype(float)
    ids = pdf.vec_id.to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    truth = {ids[i]: set(ids[np.argsort(d[i])[:5]]) for i in range(len(ids))}
    got = {}
    rows = G.near_neighbours(e, "vec_id", "embedding", 5).collect()
    for r in rows:
        got.setdefault(r.vec_id, set()).add(r.nb_key)
        assert r.nb_key != r.vec_id
    assert all(len(v) == 5 for v in got.values()) and set(got) == set(truth)
    recall = np.mean([len(truth[k] & got[k]) / 5 for k in truth])
    assert recall == 1.0, recall
    # distances reported are exact
    pos = {v: i for i, v in enumerate(ids)}
    for r in rows[:50]:
        assert abs(r.dist2 - d[pos[r.vec_id], pos[r.nb_key]]) < 1e-6


def test_cluster_undersample(spark):
    e = _emb(spark)
    out = G.cluster_undersample(e, "vec_id", "embedding", "is_minority")
    n_min = e.filter("is_minority = 1").count()
    centres = out.filter("kind = 'centre'")
    assert centres.count() == n_min and centres.select("is_minority").distinct().collect()[0][0] == 0
    orig = out.filter("kind = 'original'").select("vec_id").collect()
    assert sorted(r.vec_id for r in orig) == sorted(r.vec_id for r in e.filter("is_minority = 1").collect())


def test_cluster_undersample_classes_duplicates_and_sizes(spark):
    """Exactly N centres of the right classes, for one, equal and many points."""
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, x array<double>, y int")
        return [(r.y, tuple(r.x)) for r in G.cluster_undersample(df, "vec_id", "x", "y").filter("kind = 'centre'").collect()]
    same = [(i, [1.0, 1.0], 0) for i in range(20)] + [(100 + i, [0.0, 0.0], 1) for i in range(6)]
    assert run(same) == [(0, (1.0, 1.0))] * 6
    one = [(i, [float(i), 0.0], i % 2) for i in range(10)] + [(50, [9.0, 9.0], 2)]
    assert len(run(one)) == 1
    three = [(i, [float(i % 7), 5.0 * (i % 2)], i % 2) for i in range(60)] + [(100 + i, [50.0, 50.0], None) for i in range(30)] + [(200 + i, [9.0, 9.0], 2) for i in range(10)]
    got = run(three)
    assert len(got) == 10 and {y for y, _ in got} == {0, 1, None}
    assert all(x == (50.0, 50.0) for y, x in got if y is None) and all(0 <= x[0] <= 6 for y, x in got if y is not None)


def _recall(df):
    pos = df.filter("target = 1")
    return pos.filter("prediction = 1").count() / pos.count()


def test_penalised_svm_recall(spark):
    e = _emb(spark)
    weighted = G.penalised_svm(e, "embedding", "label", 3, weighted=True)
    plain = G.penalised_svm(e, "embedding", "label", 3, weighted=False)
    assert _recall(weighted) >= _recall(plain)


def test_penalised_lda_closed_form(spark):
    e = _emb(spark)
    pdf = e.toPandas()
    x = np.stack(pdf["embedding"].to_numpy()).astype(float)
    y = (pdf["label"] == 3).to_numpy()
    m0, m1 = x[~y].mean(0), x[y].mean(0)
    s = ((x[~y] - m0).T @ (x[~y] - m0) + (x[y] - m1).T @ (x[y] - m1)) / (len(x) - 2)
    w = np.linalg.solve(s, m1 - m0)
    score = x @ w - w @ (m0 + m1) / 2
    ours = G.penalised_lda(e, "embedding", "label", 3).toPandas().set_index("vec_id").loc[pdf["vec_id"]]
    assert np.allclose(ours["score"].to_numpy(), score, rtol=1e-5, atol=1e-6)


def test_divide_conquer_vote(spark):
    out = G.divide_conquer_ensemble(_emb(spark), "embedding", "label", 3, n_models=3)
    assert out.filter((F.col("votes") >= 2) != (F.col("prediction") == 1)).count() == 0


def test_layered_vote_rules():
    import itertools
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = list(itertools.product([0.0, 1.0], repeat=3))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select(G.vote_rule(F.col("a"), F.col("b"), F.col("c"), "majority").alias("m"),
                    G.vote_rule(F.col("a"), F.col("b"), F.col("c"), "l2_or_l3").alias("o"), "a", "b", "c").collect()
    for r in got:
        assert r.m == float(r.a + r.b + r.c >= 2)
        assert r.o == float(r.b + r.c >= 1)


def test_anomaly_share_and_reproducible(spark):
    e = _emb(spark)
    a = G.anomaly_then_classify(e, "embedding", "label", 3, share=0.1)
    share = a.filter("outlier").count() / a.count()
    assert 0.05 <= share <= 0.15
    b = G.anomaly_then_classify(e, "embedding", "label", 3, share=0.1)
    assert sorted(a.select("vec_id", "score").collect()) == sorted(b.select("vec_id", "score").collect())


def test_elastic_net_l1_sparsity(spark):
    e = _emb(spark)
    zeros = []
    for lam in (0.001, 0.05):
        _, m = J.elastic_net(e, "embedding", "label", 3, alpha=1.0, lam=lam)
        zeros.append(int((np.abs(m.coefficients.toArray()) < 1e-12).sum()))
    assert zeros[1] >= zeros[0]


def test_feature_subset_seeded(spark):
    assert J.feature_subset_indices(64, 0.25, "a") == J.feature_subset_indices(64, 0.25, "a")
    assert J.feature_subset_indices(64, 0.25, "a") != J.feature_subset_indices(64, 0.25, "b")
    out, idx = J.feature_subset(_emb(spark), "embedding", 0.25, "a", "f")
    r = out.first()
    assert r.f == [r.embedding[i] for i in idx] and len(idx) == 16


def test_shallow_tree_depth(spark):
    _, m = J.shallow_tree(_emb(spark), "embedding", "label", 3, max_depth=2)
    assert m.depth <= 2


def test_bagging_vote(spark):
    out = J.bagging_mixed(_emb(spark), "embedding", "label", 3, "vec_id")
    assert out.filter((F.col("votes") >= 2) != (F.col("prediction") == 1)).count() == 0


def test_bootstrap_weights_mean_one(spark):
    w = spark.range(200000).select(J.bootstrap_weight("1", F.col("id")).alias("w"))
    r = w.agg(F.avg("w").alias("m"), F.variance("w").alias("v")).first()
    assert abs(r.m - 1) < 0.02 and abs(r.v - 1) < 0.03


def test_early_stopping_trees(spark):
    from quarry.functions.expr import unit_hash
    out, m = J.early_stopping(_emb(spark), "embedding", "label", 3,
                              unit_hash("val", F.col("vec_id")) < 0.2, max_iter=10)
    assert m.getNumTrees <= 10 and out.first().n_trees == m.getNumTrees


def test_pca_orthonormal(spark):
    _, m = J.pca(_emb(spark), "embedding", 4)
    pc = m.pc
    assert np.allclose(pc.T @ pc, np.eye(4), atol=1e-8)
    ev = m.explainedVariance
    assert all(ev[i] >= ev[i + 1] for i in range(3))
    x = np.array([r[0] for r in _emb(spark).select("embedding").collect()])
    assert np.allclose(m.covariance, np.cov(x.T), atol=1e-9)


def test_als_topn(spark):
    out = load_all()["als_recommend"].build(spark, SF001)
    per = out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("mx"))
    assert per.filter("n > 5 OR mx > 5").count() == 0
    from pyspark.sql import Window
    w = Window.partitionBy("o_custkey").orderBy("rank")
    bad = out.withColumn("prev", F.lag("score").over(w)).filter(F.col("prev") < F.col("score"))
    assert bad.count() == 0


def test_als_blocks_grow_in_number_not_in_size(spark, monkeypatch):
    """No block holds more than some ``BLOCK_RATINGS`` ratings, and every user still gets the best items of the model."""
    rng = np.random.default_rng(4)
    rows = [(u * 2, int(i) * 2, float(1 + (u * i) % 5)) for u in range(150) for i in rng.choice(60, 8, replace=False)]
    df = spark.createDataFrame(rows, "u long, i long, r double")
    models = []

    class Kept(J.ALS):
        def fit(self, data):
            models.append((super().fit(data), data.count()))
            return models[-1][0]

    monkeypatch.setattr(J, "ALS", Kept)
    for most, blocks in ((4_000_000, 10), (50, 29)):
        monkeypatch.setattr(J, "BLOCK_RATINGS", most, raising=False)
        got = J.als_recommend(df, "u", "i", "r", top_n=3).toPandas()
        model, n = models[-1]
        assert n == len(rows)
        sizes = [len(part) for part in model.userFactors.rdd.glom().collect()]
        assert len(sizes) == blocks and sum(sizes) == 150 and max(sizes) <= 2 * 150 / blocks * (2 if blocks == 10 else 1)
        user = {r["id"]: np.array(r["features"], float) for r in model.userFactors.collect()}
        item = {r["id"]: np.array(r["features"], float) for r in model.itemFactors.collect()}
        best = {u: sorted((-float(x @ y) for y in item.values()))[:3] for u, x in user.items()}
        assert len(got) == 3 * 150
        for u, g in got.groupby("u"):
            assert np.allclose(-g.sort_values("rank")["score"].to_numpy(), best[u], atol=1e-5)


@pytest.mark.parametrize("pilot", [2, 40, 1000])
def test_top_items_exact_against_brute_force(spark, pilot):
    rng = np.random.default_rng(3)
    U = rng.normal(size=(150, 6))
    V = rng.normal(size=(400, 6))
    users = spark.createDataFrame([(i, U[i].tolist()) for i in range(len(U))], "id int, features array<double>")
    items = spark.createDataFrame([(i, V[i].tolist()) for i in range(len(V))], "id int, features array<double>")
    out = J.top_items(users, items, 4, stretch=32, block=16, pilot=pilot).toPandas()
    S = U @ V.T
    for uid, g in out.groupby("user"):
        want = list(np.lexsort((np.arange(len(V)), -S[uid]))[:4])
        assert list(g.sort_values("rank")["item"]) == want
    assert out["user"].nunique() == len(U)


def test_top_items_deals_the_longest_items(spark, monkeypatch):
    """All user blocks meet the longest items; no task gets all of them."""
    rng = np.random.default_rng(8)
    users = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(640)], "id int, features array<double>")
    items = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "id int, features array<double>")
    seen = []
    monkeypatch.setattr(J, "top_n_per_group", lambda df, *a: seen.append(df) or df)
    monkeypatch.setattr(J, "FEW_PAIRS", 4)
    J.top_items(users, items, 2, stretch=64, block=16, pilot=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [r["n"] for r in seen[0].groupBy(F.spark_partition_id()).agg(F.countDistinct("user").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(tasks) == 640 and max(tasks) <= 320


def test_top_items_scorer_holds_few_scores_at_once():
    """A pair of full size, where every score counts as a hit, is worked through in parts."""
    import tracemalloc
    import pyarrow as pa
    rng = np.random.default_rng(7)
    U, V = rng.normal(size=(2048, 8)), rng.normal(size=(8192, 8))
    V = V[np.argsort(-np.linalg.norm(V, axis=1))]
    ids, i_ids = np.arange(len(U)), np.arange(len(V))
    row = {"part": 0, "stretch": 0, "ids": ids.tobytes(), "vecs": U.tobytes(), "least": np.full(len(U), -np.inf).tobytes(), "i_ids": i_ids.tobytes(), "i_vecs": V.tobytes()}
    tracemalloc.start()
    got = pa.Table.from_batches(J._block_scorer(3, "<f8", "<f8")(iter([pa.RecordBatch.from_pylist([row])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    want = np.sort(U[:50] @ V.T, axis=1)[:, :-4:-1]
    assert got.num_rows == 3 * len(U) and np.allclose(got.column("score").to_numpy()[:150].reshape(50, 3), want)


@pytest.mark.parametrize("margin", [6.0, -3.0])
def test_undersample_matches_brute_force(spark, margin):
    import hashlib
    import pandas as pd
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame({"id": np.arange(n), "y": rng.choice([0, 1, 2], n, p=[0.7, 0.25, 0.05]),
                        "b": rng.integers(0, 3, n)})
    df = spark.createDataFrame(pdf)
    out = G.undersample(df, "y", "id", "s9", batch="b", margin_sd=margin)
    pdf["h"] = [int(hashlib.md5(f"s9{i}".encode()).hexdigest()[:8], 16) for i in pdf["id"]]
    want = []
    for b, g in pdf.groupby("b"):
        keep = g.groupby("y").size().min()
        for yv, gg in g.groupby("y"):
            want += list(gg.sort_values(["h", "id"])["id"][:keep])
    assert sorted(r.id for r in out.collect()) == sorted(want)


def test_srm_check_by_stratum(spark):
    a = B.ab_assign(load(spark, SF001, "customer"), "c_custkey", "exp1", {"A": 0.5, "B": 0.5})
    rows = B.srm_check(a, {"A": 0.5, "B": 0.5}, strata="c_mktsegment").collect()
    by_seg = {}
    for r in rows:
        by_seg.setdefault(r.c_mktsegment, []).append(r)
    assert len(by_seg) == 5
    for seg_rows in by_seg.values():
        total = sum(r.n for r in seg_rows)
        assert all(abs(r.expected - total / 2) < 1e-9 for r in seg_rows)
        chi = sum((r.n - r.expected) ** 2 / r.expected for r in seg_rows)
        assert all(abs(r.chi2 - chi) < 1e-9 for r in seg_rows)
    # the split is stable: the same ids land in the same arms again
    again = B.ab_assign(load(spark, SF001, "customer"), "c_custkey", "exp1", {"A": 0.5, "B": 0.5})
    assert a.select("c_custkey", "arm").exceptAll(again.select("c_custkey", "arm")).isEmpty()


def test_business_and_bayes_laws(spark):
    orders = load(spark, SF001, "orders")
    d = {r.driver: r for r in B.gmv_drivers(orders, "o_custkey", "o_totalprice", "o_orderdate",
                                            ("1996-01-01", "1997-01-01"), ("1997-01-01", "1998-01-01")).collect()}
    parts = d["buyers"].log_effect + d["orders_per_buyer"].log_effect + d["value_per_order"].log_effect
    assert abs(parts - d["gmv"].log_effect) < 1e-9
    li = load(spark, SF001, "lineitem")
    g = B.gmv_change(li, "l_returnflag", F.col("l_extendedprice"), "l_shipdate",
                     ("1996-01-01", "1997-01-01"), ("1997-01-01", "1998-01-01")).collect()
    assert abs(sum(r.share for r in g) - 1.0) < 1e-9
    post = H.bayes_posterior(orders, "o_orderpriority", "o_orderstatus").collect()
    for r in post:
        assert abs(r.posterior - r.prior * r.likelihood / r.evidence) < 1e-12


def test_penalised_lda_one_row_class(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.5, 2.5], 0), (2, [0.5, 1.0], 0), (3, [3.0, 3.0], 1)],
                               "vec_id int, embedding array<double>, label int")
    out = [r.prediction for r in G.penalised_lda(df, "embedding", "label", 1).orderBy("vec_id").collect()]
    assert out == [0.0, 0.0, 0.0, 1.0]


def test_pca_and_lda_over_all_components_against_sql_covariances(spark):
    """Covariances and means of all components from SQL give the axes, the projections and the scores."""
    import duckdb
    table = f"(SELECT vec_id, label = 3 AS pos, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM '{SF001}/embeddings.parquet')"
    dim = len(_emb(spark).first()["embedding"])

    def moments(where):
        """Rows, means and covariances."""
        n, mean, cov = 0, np.zeros(dim), np.zeros((dim, dim))
        for i, j, n, m, c in duckdb.sql(f"SELECT a.i, b.i, count(*), avg(a.x), covar_samp(a.x, b.x) FROM {table} a JOIN {table} b USING (vec_id) "
                                        f"WHERE {where} GROUP BY 1, 2").fetchall():
            mean[i - 1], cov[i - 1, j - 1] = m, c
        return n, mean, cov

    out, m = J.pca(_emb(spark), "embedding", 4)
    _, _, cov = moments("true")
    top = np.sort(np.linalg.eigvalsh(cov))[::-1][:4]
    assert np.allclose(cov @ m.pc, m.pc * top, atol=1e-8)
    assert np.allclose(m.explainedVariance, top / np.trace(cov), atol=1e-8)
    rows = out.select("embedding", "components").collect()
    assert np.allclose([r["components"] for r in rows], np.array([r["embedding"] for r in rows]) @ m.pc, atol=1e-8)

    (n0, m0, c0), (n1, m1, c1) = moments("NOT a.pos"), moments("a.pos")
    w = np.linalg.solve(((n0 - 1) * c0 + (n1 - 1) * c1) / (n0 + n1 - 2), m1 - m0)
    rows = G.penalised_lda(_emb(spark), "embedding", "label", 3).select("embedding", "score", "prediction").collect()
    want = (np.array([r["embedding"] for r in rows]) - (m0 + m1) / 2) @ w
    assert np.allclose([r["score"] for r in rows], want, rtol=1e-5, atol=1e-6)
    assert [r["prediction"] for r in rows] == [float(r["score"] > 0) for r in rows]
