"""Boosted stumps: rounds against numpy, the stop, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators.stumps import boosted_stumps, fit_stumps

SCHEMA = "id int, x array<double>, y double"


def _sample(n=300, noise=0.1, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 100, 0.01]
    y = ((x[:, 0] > 0.2) ^ (rng.random(n) < noise)).astype(float)
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], SCHEMA)


def _plain(x, y, val, rounds, bins, rate, lam):
    lo, hi = x[~val].min(0), x[~val].max(0)
    b = np.clip(np.floor((x - lo) / ((hi - lo) / bins)), 0, bins - 1)
    m = np.full(len(y), np.log(y[~val].mean() / (1 - y[~val].mean())))
    losses = []
    for k in range(rounds + 1):
        losses.append((np.logaddexp(0, m) - y * m)[val].mean())
        p = 1 / (1 + np.exp(-m))
        g, h = (y - p) * ~val, p * (1 - p) * ~val
        best = max(((g[b[:, j] <= s].sum() ** 2 / (h[b[:, j] <= s].sum() + lam) + g[b[:, j] > s].sum() ** 2 / (h[b[:, j] > s].sum() + lam), -j, -s)
                    for j in range(x.shape[1]) for s in sorted(set(b[~val, j]))[:-1]))
        left = b[:, -best[1]] <= -best[2]
        if k < rounds:
            m = m + rate * np.where(left, g[left].sum() / (h[left].sum() + lam), g[~left].sum() / (h[~left].sum() + lam))
    return losses, m


def test_rounds_against_numpy(spark):
    x, y = _sample()
    val = np.arange(len(y)) % 4 == 0
    out, model = boosted_stumps(_frame(spark, x, y), "x", "y", 1.0, F.col("id") % 4 == 0, rounds=5, tol=float("-inf"), bins=16)
    losses, margin = _plain(x, y, val, 5, 16, 0.3, 1.0)
    assert np.allclose(model.losses, losses, atol=1e-9) and model.kept == 5
    got = {r["id"]: r["prediction"] for r in out.collect()}
    assert all(got[i] == float(m > 0) for i, m in enumerate(margin)) and len(got) == len(y)


def test_stops_where_nothing_is_learnt(spark):
    x, y = _sample(noise=0.5)
    model = fit_stumps(_frame(spark, x, y), "x", "y", F.col("id") % 2 == 0, rounds=20)
    assert model.kept < 5 and len(model.losses) == model.kept + 2 and len(model.stumps) == model.kept + 1
    assert min(model.losses) == model.losses[model.kept] or model.losses[model.kept] - min(model.losses) < 0.01


def test_odd_rows(spark):
    x, y = _sample(100)
    df = _frame(spark, x, y)
    plain = fit_stumps(df, "x", "y", F.lit(False), rounds=3)
    odd = spark.createDataFrame([(500, None, 1.0), (501, [1.0, 2.0, 3.0], None)], SCHEMA)
    same = fit_stumps(df.unionByName(odd), "x", "y", F.lit(None), rounds=3)
    assert np.allclose(plain.losses, same.losses) and [s[:2] for s in plain.stumps] == [s[:2] for s in same.stumps]
    strange = spark.createDataFrame([(600, [None, float("nan"), float("inf")], 1.0), (601, [], 0.0)], SCHEMA)
    out, _ = boosted_stumps(df.unionByName(strange), "x", "y", 1.0, F.col("id") % 2 == 0, rounds=2)
    assert out.count() == 102 and out.filter("id >= 600 and prediction is null").count() == 0
    one, model = boosted_stumps(df.filter("y = 1"), "x", "y", 1.0, F.lit(False), rounds=2)
    assert one.filter("prediction <> 1").count() == 0
    flat = fit_stumps(spark.createDataFrame([(i, [7.0], float(i % 2)) for i in range(9)], SCHEMA), "x", "y", F.lit(False))
    assert flat.stumps == () and flat.kept == 0
    empty, model = boosted_stumps(df.limit(0), "x", "y", 1.0, F.lit(False))
    assert empty.count() == 0 and model.kept == 0
