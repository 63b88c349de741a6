"""Repeated byte strings against brute force."""

import hashlib

import numpy as np
import pytest

from quarry.llm import suffixes


def brute(rows):
    """Of (id, text): the removed places of each row."""
    first = {}
    keyed = [((i is None, i or 0), (t or "").encode()) for i, t in rows]
    for i, b in sorted(keyed):
        for k in range(len(b) - 99):
            w = b[k:k + 100]
            first[w] = min(first.get(w, (i, k)), (i, k))
    out = []
    for i, b in keyed:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if first[b[k:k + 100]] < (i, k):
                gone[k:k + 100] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, start int")
    got = sorted((tuple(r)[:5] for r in suffixes.remove_repeats(docs, **kw).collect()), key=str)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute(rows))), key=str)


def cases():
    rng = np.random.default_rng(5)
    word = [" ".join(rng.choice(["alpha", "beta", "gämma", "d"], 60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 350), (5, "x" * 350), (None, "x" * 120 + "y" * 150), (None, "y" * 150),
            (7, "ab" * 300), (8, "b" + "ab" * 90 + "q" * 30), (9, word[0]), (10, word[0]), (11, "z" + word[0][3:] + word[1]), (11, word[1]),
            (0, word[1] + word[2]), (12, word[2][1:140]), (13, word[3] + word[3]), (14, word[4][:101] + "!" + word[4][50:])]
    return rows + [(100 + i, word[5][i:] + str(i)) for i in range(40)]


@pytest.mark.parametrize("kw", [{}, {"buckets": 3, "bucket_most": 2000}, {"buckets": 2, "sort": 500, "sort_most": 1500}])
def test_nulls_ties_repeats_and_periods(spark, kw):
    check(spark, cases(), **kw)


def test_documents_with_and_without_split_buckets(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_long_text_is_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    rng = np.random.default_rng(2)
    long = "".join(rng.choice(list("abcdefgh "), 20_000))
    check(spark, [(1, long), (2, long[2900:3200] + "-" + long[:5000]), (3, long[5990:6100])])


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CROWDED = """
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from quarry.llm import suffixes as S

rng = np.random.default_rng(3)
some = rng.integers(97, 123, 4 << 20).astype(np.uint8).tobytes()
texts = [some[k:k + (1 << 18)] for k in range(0, len(some), 1 << 18)] + [some[100_000:1_500_000], b"-" * 1_000_000]
rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t.decode() for t in texts]), pa.array([0] * len(texts), pa.int32())], ["_id", "_text", "_th"])
dealt = [b for b in S._mapper(1)(iter([rows])) if b.num_rows]
before, parts, most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, [], 0
held = sum(b.num_rows for b in S._sorter(S.BUCKET_MOST, 1)(iter(dealt)))
for b in S._sorter(S.SORT_MOST, 1)(iter(dealt)):
    for k, x in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
        if k == 7:
            parts.append(x)
one = pa.RecordBatch.from_arrays([pa.array([7] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["bucket", "blob"])
n = sum(b.num_rows for b in S._sorter(S.BUCKET_MOST, 2)(iter([one])))
print(len(parts), n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_crowded_bucket_keeps_to_its_memory():
    """A bucket in turns, one of more text than its bound, and the next pass take no more than 600 MB."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", CROWDED.format(root=root)], capture_output=True, text=True, timeout=600)
    parts, found, peak = map(int, done.stdout.split()[-3:])
    assert parts and found and peak < 600, done.stdout + done.stderr


def test_sorting_network_orders_ties():
    rng = np.random.default_rng(0)
    lines = [b"h" * 33 + bytes(rng.integers(97, 99, 8).astype(np.uint8)) + b"m" * 59 for _ in range(300)]
    text = np.frombuffer(b"".join(lines), np.uint8)
    begin = np.arange(300) * 100
    found = suffixes.repeated(text, begin, np.ones(300, np.int64), np.arange(300))
    seen, want = set(), []
    for x in lines:
        want.append(x in seen)
        seen.add(x)
    assert found.tolist() == want
