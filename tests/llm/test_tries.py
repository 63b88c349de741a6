"""Prefix trie of conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm import tries


def brute(rows):
    """The trie from its definition; rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        b = c - c % 100
        whole = turns.get(b, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(p[-1][1]) * (len(members[p]) - 1) if p else 0)
    out = []
    for p, m in members.items():
        ids = ",".join(str(c) for c in sorted(c for c, end in m if end))
        out.append((min(m)[0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def trie(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    out = tries.prefix_trie(df, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def odd(seed):
    """Shared starts, missing and short ones, repeated conversations, nulls, gaps."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 700), 120):
        n = rng.choice([1, 1, 2, 3, 5, 8])
        rows += [(c, t * 2 if rng.random() < 0.95 else t * 2 + 1, rng.choice(["user", None]), rng.choice(["hé😀", "", None, "b" * 9])) for t in range(n)]
    rows += [(c, t, "user", f"x{t}") for c in (800, 801, 803, 805, 899, 900) for t in range(5)]
    rows += [(950, None, "system", "s"), (950, 0, "user", "u"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard": 5, "band": 2, "queue": 2}])
def test_against_brute_force(spark, options):
    """Whole in one shard, and through shards, bands of bands and a queue that spills."""
    rows = odd(len(options))
    # turns of one number are in the order of a hash; here such rows are alike
    assert trie(spark, rows, **options) == brute(rows)


def test_long_conversation(spark):
    """Blocks of turns, and bands of levels along one long conversation."""
    rows = [(7, t, "user", f"t{t % 50}") for t in range(9000)] + [(8, 0, "user", "t0")]
    assert trie(spark, rows, shard=50, band=100) == brute(rows)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert trie(spark, df.withColumn("key", tries.F.lit(1))) == brute([tuple(r) for r in df.collect()])


def test_empty(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []


def test_queue_spills():
    rng = random.Random(1)
    queue, sums = tries.SpillingQueue(4), defaultdict(int)
    for _ in range(300):
        k = rng.randrange(60)
        queue.push((k,), (1, k))
        sums[k] += 1
    assert queue.runs
    assert {k: queue.pop((k,)) for k in range(60)} == {k: (sums[k], k * sums[k]) if sums[k] else None for k in range(60)}
