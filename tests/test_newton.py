"""The logistic members of the ensembles: Newton's method against Spark's fit and on odd rows."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from quarry.functions.vectors import as_vector
from quarry.operators.imbalance import divide_conquer_ensemble
from quarry.operators.newton import fit_logistic

SCHEMA = "x array<double>, t double, n double"


def _sample(rows=400, dim=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dim)) * [1.0, 50.0, 0.01][:dim] + [0.0, 1e6, 5.0][:dim]
    t = (x[:, 0] + (x[:, 1] - 1e6) / 50 + rng.normal(size=rows) > 0.5).astype(float)
    return [(v.tolist(), float(y), float(i % 4)) for i, (v, y) in enumerate(zip(x, t))]


@pytest.mark.parametrize("weight", [None, "n"])
def test_same_optimum_as_spark(spark, weight):
    df = spark.createDataFrame(_sample(), SCHEMA)
    model = fit_logistic(df, "x", "t", weight)
    est = LogisticRegression(featuresCol="v", labelCol="t", regParam=0.01, tol=1e-12, maxIter=300)
    spark_model = (est.setWeightCol("n") if weight else est).fit(df.filter("n > 0" if weight else "true").withColumn("v", as_vector("x")))
    scale = np.array([1.0, 50.0, 0.01])
    assert np.allclose(model.coefficients * scale, spark_model.coefficients.toArray() * scale, atol=1e-4)
    got = df.withColumn("v", as_vector("x")).withColumn("p", model.prediction("x"))
    assert spark_model.transform(got).filter("p <> prediction").count() <= 1


def test_odd_rows(spark):
    rows = _sample(120, 2)
    plain = fit_logistic(spark.createDataFrame(rows, SCHEMA), "x", "t")
    # rows without a vector, component, target or weight take no part; a constant feature has no weight
    odd = [*rows, (None, 1.0, 1.0), ([None, 1.0], 0.0, 1.0), ([9.0, 9.0], None, 1.0)]
    same = fit_logistic(spark.createDataFrame(odd, SCHEMA), "x", "t")
    assert np.allclose(same.coefficients, plain.coefficients, rtol=1e-7) and same.intercept == pytest.approx(plain.intercept, rel=1e-6)
    wide = fit_logistic(spark.createDataFrame([([*x, 7.0], t, n) for x, t, n in rows], SCHEMA), "x", "t")
    assert wide.coefficients[2] == 0 and np.allclose(wide.coefficients[:2], plain.coefficients, rtol=1e-6)
    with pytest.raises(Exception, match="length"):
        fit_logistic(spark.createDataFrame([*rows, ([1.0, 2.0, 3.0, 4.0], 1.0, 1.0), *rows[:1]], SCHEMA).coalesce(1), "x", "t")


def test_one_class_no_rows_and_separable(spark):
    one = spark.createDataFrame([([1.0, 2.0], 1.0, 1.0), ([3.0, 4.0], 1.0, 1.0)], SCHEMA)
    for df, want in ((one, 1.0), (one.withColumn("t", F.lit(0.0)), 0.0), (one.limit(0), 0.0)):
        model = fit_logistic(df, "x", "t")
        assert [r[0] for r in one.select(model.prediction("x")).collect()] == [want, want]
    apart = spark.createDataFrame([([float(i), 0.0], float(i >= 10), 1.0) for i in range(40)], SCHEMA)
    model = fit_logistic(apart, "x", "t", reg=1e-6)
    assert apart.filter(model.prediction("x") != F.col("t")).count() == 0


def test_weights_count_rows(spark):
    rows = _sample(150, 2)
    by_weight = fit_logistic(spark.createDataFrame(rows, SCHEMA), "x", "t", "n", reg=0.0)
    repeated = fit_logistic(spark.createDataFrame([r for r in rows for _ in range(int(r[2]))], SCHEMA), "x", "t", reg=0.0)
    assert np.allclose(by_weight.coefficients * [1, 50], repeated.coefficients * [1, 50], atol=1e-7)


def test_given_split(spark):
    """A member of a group without majority rows calls every row positive."""
    df = spark.createDataFrame([([float(i), 1.0], float(i < 4), 0.0) for i in range(20)], SCHEMA)
    out = divide_conquer_ensemble(df, "x", "t", 1.0, n_models=3, split=F.lit(0)).collect()
    assert all(r["votes"] >= 2 and r["prediction"] == 1.0 for r in out)
