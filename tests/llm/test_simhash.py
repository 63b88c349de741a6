"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm import simhash
from quarry.llm.components import stars


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, most=3):
    fp = np.array(fps, np.uint64)
    label = np.arange(len(fp))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= most
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fp))], dtype=int)
        if (new == label).all():
            break
        label = new
    out = {}
    for i, x in enumerate(label):
        if ids[i] is not None:
            out[x] = min(out.get(x, ids[i]), ids[i])
    return [out.get(x) for x in label]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = brute_components([d for d, _, _ in rows], fps)
    assert got == sorted([(d, f"{f:016x}", c) for (d, _, _), f, c in zip(rows, fps, want)], key=str)


def test_small_texts_nulls_repeats_and_clashing_columns(spark):
    long = "Word " + " ".join(f"w{i}" for i in range(120_000))
    check(spark, [(1, None, "a"), (2, "", "b"), (3, " \t\n", "c"), (4, "One", "d"), (5, "one two", "e"), (5, "one two", "e"),
                  (None, "one TWO", "f"), (7, "one\x0btwo\x0cthree four", "g"), (8, "İ ß é x\x1cy", "h"), (9, long, "i"), (10, long + " end", "j")])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [(r[0], r[1], "x") for r in docs.collect()])


@pytest.mark.parametrize("block", [8, 1 << 12])
def test_links_find_all_pairs_up_to_three_bits(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 8), replace=False)) for b in np.repeat(base, 12)]
    fps += [(1 << 63) | i for i in range(200)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["u"]: r["v"] for r in stars(simhash.links(df, 3, block)).collect()}
    want = brute_components(fps, [x % (1 << 64) for x in fps])
    assert [roots.get(x, x) for x in fps] == want


def test_one_of_each_keeps_one_row_of_each_component(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(20))
    kept = simhash.one_of_each(docs)
    found = simhash.near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in found.select("component_id").distinct().collect())


def test_stars_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 7) % 50) for i in range(50)] + [(500, 500)]
    got = {r["u"]: r["v"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}}
    assert stars(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).count() == 0
