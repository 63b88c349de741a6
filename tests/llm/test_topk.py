"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk


def brute(rows, every, k):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    queries = {}
    for i, v in kept:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v, key=lambda x: np.array(x, np.int32).tobytes())
    for i, q in queries.items():
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, every=3, k=5, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, _q string, stretch int")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("_id") % every == 0, k=k, **kw).collect())


@pytest.mark.parametrize("kw", [{}, {"annulus": 16, "stretch": 64, "queries": 8, "pivots": 5}])
def test_against_brute_force_with_ties_and_copies(spark, kw):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.4, (40, 6))
    rows = [(i, [float(x) for x in base[i % 40 if i % 2 else 0]]) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in rng.normal(0, 0.2 + i / 100, 6)]) for i in range(200)]
    assert run(spark, rows, **kw) == brute(rows, 3, 5)


def test_nulls_non_finite_short_vectors_and_repeats(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (3, [0.5]), (3, [-4.0, 1.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, [-0.001, 0.001]), (12, [])]
    assert run(spark, rows) == brute(rows, 3, 5)


def test_empty_vectors_are_zeros(spark):
    assert run(spark, [(0, []), (3, []), (4, None)]) == [(0, 1, 3, 0), (3, 1, 0, 0)]
    rows = [(0, []), (1, [1.0, -2.0]), (2, []), (3, [-1.0, -1.0]), (6, [0.5])]
    assert run(spark, rows) == brute(rows, 3, 5)


def test_large_components_are_exact(spark):
    rows = [(i, [float(1000 * i), 70000.5, -3.25 * i]) for i in range(20)]
    assert run(spark, rows) == brute(rows, 3, 5)


def test_empty_table_and_a_single_vector(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


@pytest.mark.parametrize("size", [262144.0, 5e6, 4e7])
@pytest.mark.parametrize("kw", [{}, {"annulus": 4, "stretch": 16, "queries": 8, "pivots": 5}])
def test_rows_of_any_size_whose_scores_fit(spark, size, kw):
    """Large finite vectors are queries and candidates; only those whose scores do not fit a long are none."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.4, 3)]) for i in range(60)]
    rows += [(60 + i, [float(np.float32(size * (1 - i / 99))), -0.5 * i, size / 8]) for i in range(9)]
    whole = {i: [math.floor(64 * y) for y in v] for i, v in rows}
    want = [(i, r + 1, j, -s) for i, q in whole.items() if i % 3 == 0
            for r, (s, j) in enumerate(sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole.items() if j != i)[:5])]
    assert run(spark, [*rows, (99, [1e9, 0.0, 0.0]), (100, [3e38, 1.0, 1.0])], **kw) == sorted(want)


def test_copies_of_the_queries_are_never_broadcast(spark):
    """Each stretch gets a copy of all queries: Spark would judge them by the size of one and send them through the driver."""
    rows = [(i, [0.5 - i / 400, i / 400, 0.25]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = topk.top_k(df, F.col("_id") % 3 == 0, k=5, stretch=16, queries=8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


@pytest.mark.parametrize("size", [1, 127 / 64, 2, 500, 600, 40_000])
def test_whole_numbers_of_every_width(spark, size):
    """Components are kept in the fewest bytes that hold the largest; of the vectors of one id the query is the first in byte order, whatever the width."""
    rng = np.random.default_rng(7)
    rows = [(i % 50, [float(np.float32(x)) for x in rng.uniform(-1, 1, 4) * size]) for i in range(120)]
    rows += [(200, [float(size), -float(size), 0.0, -1.0 / 64]), (201, [-float(size)] * 4)]
    assert run(spark, rows, annulus=8, stretch=32, queries=8, pivots=5) == brute(rows, 3, 5)
