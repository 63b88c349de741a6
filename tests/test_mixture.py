"""Gaussian mixtures: one step against numpy, growth of the likelihood, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators.imbalance import anomaly_then_classify
from quarry.operators.mixture import RIDGE, Mixture, fit_mixture


def _blobs(seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(m, s, (80, 3)) for m, s in ((0, 1), (1e4, 2), (2e4, 0.5))])


def _frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(x)], "id int, x array<double>")


def _numpy_step(x, m):
    t = np.array([np.log(w) - 1.5 * np.log(2 * np.pi) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (((x - mu) @ np.linalg.inv(c)) * (x - mu)).sum(1)
                  for w, mu, c in zip(m.weights, m.means, m.covariances)])
    top = t.max(0)
    whole = top + np.log(np.exp(t - top).sum(0))
    r = np.exp(t - whole)
    means = (r @ x) / r.sum(1)[:, None]
    covs = []
    for q, mu in zip(r, means):
        c = ((x - mu) * q[:, None]).T @ (x - mu) / q.sum()
        covs.append(c + np.eye(3) * RIDGE * np.trace(c))
    return r.mean(1), means, np.array(covs), whole


def test_step_density_and_growth(spark):
    x = _blobs()
    df = _frame(spark, x)
    two, three = (fit_mixture(df, "x", 3, max_steps=n, tol=float("-inf")) for n in (2, 3))
    weights, means, covs, whole = _numpy_step(x, two)
    assert np.allclose(three.weights, weights) and np.allclose(three.means, means, rtol=1e-9) and np.allclose(three.covariances, covs, rtol=1e-6, atol=1e-6)
    got = [r[0] for r in df.orderBy("id").select(two.log_density("x")).collect()]
    assert np.allclose(got, whole, atol=1e-6) and abs(three.gains[-1] - whole.mean()) < 1e-6
    done = fit_mixture(df, "x", 3)
    assert all(b >= a - 1e-6 for a, b in zip(done.gains, done.gains[1:])) and len(done.gains) < 30
    assert np.allclose(sorted(done.means[:, 0]), [0, 1e4, 2e4], atol=1)


def test_odd_rows(spark):
    x = _blobs(1)
    plain = fit_mixture(_frame(spark, x), "x", 2)
    odd = fit_mixture(_frame(spark, [*x, None, [None, 1, 2], [float("nan"), 1, 2], [float("inf"), 1, 2]]), "x", 2)
    assert np.allclose(plain.means, odd.means, rtol=1e-9) and np.allclose(plain.weights, odd.weights)
    assert fit_mixture(_frame(spark, x).limit(0), "x", 2) is None
    equal = _frame(spark, [[1, 2, 3]] * 5)
    model = fit_mixture(equal, "x", 2)
    assert isinstance(model, Mixture) and np.allclose(model.means, [1, 2, 3]) and equal.filter(model.log_density("x").isNull()).count() == 0


def test_outliers_of_wide_vectors(spark):
    """Vectors longer than the components are projected first; an empty table gives no rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 12)) * np.linspace(5, 0.1, 12)
    x[:10, 0] += 100
    df = _frame(spark, x).withColumn("y", F.col("id") % 2)
    out = anomaly_then_classify(df, "x", "y", 1, share=0.05, k=1, method="mixture").cache()
    assert {r["id"] for r in out.filter("outlier").collect()} == set(range(10)) and out.count() == 200
    assert out.columns == ["id", "x", "y", "target", "score", "outlier", "prediction"]
    assert anomaly_then_classify(df.limit(0), "x", "y", 1, k=2, method="mixture").count() == 0
