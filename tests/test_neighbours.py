"""Exact nearest neighbours."""

import numpy as np
import pytest

from quarry.operators import neighbours as N


def brute(rows, k):
    """(key, nb_key, rank) by all pairs, of rows without odd vectors."""
    rows = [(key, x) for key, x in rows if x and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for i, (key, x) in enumerate(rows):
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), other) for j, (other, y) in enumerate(rows) if j != i)
        out += [(key, other, round(d, 9), r + 1) for r, (d, other) in enumerate(near[:k])]
    return sorted(out)


def found(spark, rows, k, **kw):
    df = spark.createDataFrame([(key, x, 1, 2) for key, x in rows], "name long, v array<double>, id int, x int")
    got = N.nearest_neighbours(df, "name", "v", k, **kw)
    assert got.columns == ["name", "nb_key", "nb_features", "dist2", "nb_rank"]
    return sorted((r["name"], r["nb_key"], round(r["dist2"], 9), r["nb_rank"]) for r in got.collect())


@pytest.mark.parametrize("pivots,block", [(32, 1024), (5, 7), (1, 3)])
def test_against_all_pairs(spark, pivots, block):
    """Clusters, ties on a grid and equal vectors, in one block and in many."""
    rng = np.random.default_rng(pivots)
    rows = [(int(k), (rng.normal(0, 0.1, 3) + 5 * (k % 4)).tolist()) for k in range(60)]
    rows += [(100 + k, [float(k % 5), float(k // 5), 0.0]) for k in range(25)] + [(200 + k, [9.0, 9.0, 9.0]) for k in range(9)]
    rows += [(300, None), (301, [1.0, None, 2.0]), (302, [float("nan"), 1.0, 1.0]), (303, [float("inf"), 1.0, 1.0]), (304, [])]
    assert found(spark, rows, 4, pivots=pivots, block=block) == brute(rows, 4)


def test_few_rows(spark):
    assert found(spark, [], 3) == [] and found(spark, [(1, [1.0])], 3) == []
    assert found(spark, [(1, [1.0]), (2, [4.0])], 3) == [(1, 2, 9.0, 1), (2, 1, 9.0, 1)]
    for key in ("id", "nb", "x", "key", "cell"):  # names that the operator uses itself
        df = spark.createDataFrame([("a", [1.0]), ("b", [4.0])], f"{key} string, v array<double>")
        assert sorted(r[0] + r[1] for r in N.nearest_neighbours(df, key, "v", 1).collect()) == ["ab", "ba"]


def test_far_blocks_are_not_sent(spark, monkeypatch):
    """Of clusters far apart a block meets its own cell's blocks only: under a fifth of all pairs."""
    rng = np.random.default_rng(3)
    rows = [(int(k), (rng.normal(0, 0.1, 8) + 100 * (k % 16)).tolist()) for k in range(1600)]
    seen = []
    plain = N._written

    def written(df, name):
        if name == "neighbours":
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Join Cross" not in plan and "MapInArrow" in plan
        out = plain(df, name)
        if name == "neighbour-blocks":
            seen.append(out)
        return out
    monkeypatch.setattr(N, "_written", written)
    got = found(spark, rows, 3, pivots=64, block=10)
    assert got == brute(rows, 3)
    blocks = seen[0].collect()
    near = sum(max(max(np.subtract(c["lo"], b["hi"])), max(np.subtract(b["lo"], c["hi"]))) <= b["theta"] for b in blocks for c in blocks)
    assert near < 0.2 * len(blocks) ** 2
