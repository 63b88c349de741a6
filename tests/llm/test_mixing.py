"""Mixing against plain Python and the registered SQL."""

import hashlib
import re
from collections import defaultdict

import pytest

from quarry.llm import mixing
from quarry.plans.oracle import _digest, duck_connection


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for s, (_, _, src) in zip(size, rows):
        total[src] += s
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(total, key=lambda x: (x is None, (x or "").encode())))}
    target, open_ = {}, set(total)
    rest = 1.5 * sum(total.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2.0 * total[s] <= weight[s] * level}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else weight[s] * level
        if not full:
            break
        open_ -= full
        rest -= sum(target[s] for s in full)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = [md5(f"7:{'-' if i is None else i}:{md5(t or '')}") for i, t, _ in rows]
    out = [None] * len(rows)
    for src in total:
        at = 0
        epochs = int(target[src] // total[src]) if total[src] else 0
        for r in sorted((r for r in range(len(rows)) if rows[r][2] == src), key=lambda r: key[r]):
            once = at + size[r] / 2 <= target[src] - epochs * total[src]
            out[r] = (rows[r][0], size[r], total[src], target[src], size[r] * (epochs + once))
            at += size[r]
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, target string")
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    rounded = lambda x: sorted(str((*r[:3], round(r[3], 6), r[4])) for r in x)
    assert rounded(got) == rounded(brute(rows))


def test_nulls_ties_repeats_and_sources_of_no_words(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two", None), (3, "one two", None), (None, "x y z", "B"), (None, "x y z", "B"), (5, "p q", "é"), (6, "r", "z"),
            (7, "w " * 4000, "a"), (8, "v\x0bu\x1ct\x85s", "a")] + [(100 + i, "k l m " * (i % 7), "abcd"[i % 4]) for i in range(300)]
    check(spark, rows)


def test_one_source_and_empty(spark):
    check(spark, [(i, "a b c", "only") for i in range(50)])
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 5)
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 3)
    check(spark, [(i, "a b " * (i % 9), "pq"[i % 3 > 1]) for i in range(400)])


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    got = mixing.mix(spark.read.parquet(f"{d}/documents.parquet"))
    cur = duck_connection(d).execute(mixing.ORACLE_SQL)
    assert _digest(got.columns, [tuple(r) for r in got.collect()])[0] == _digest([c[0] for c in cur.description], cur.fetchall())[0]


def test_mixed_repeats_rows_as_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in taken.items() if n}
