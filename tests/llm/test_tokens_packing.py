"""Token counts and packing against the tokenizer library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import packing, tokens

ODD = [None, "", "  \n", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "é ́a İSTANBUL ΟΔΟΣ J̌ x", "a\x1cb\x85c d", "it's we'll 'S don't, can't! (x) ☃ a☃b",
       "12345 ½ ²", "日本語 text한국", "a​c\x00d", "x" * 300 + " " + "y." * 400, "word, " * 9000]


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts(spark):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in found] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (1000, "again"), (1000, "again")]


def test_encoder_gives_the_library_ids(spark):
    encode, rows = library(), [t or "" for _, t in texts(spark)]
    for memo in (20, 10_000):
        e = tokens.WordEncoder(None, memo_words=memo)
        e.BLOCK = 5000
        for _ in range(2):
            got = e.ids_of([t.encode() for t in rows])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encode(t) for t in rows]
            assert e.counts([t.encode() for t in rows]).tolist() == [len(encode(t)) for t in rows]
    assert e.ids_of([]) == [] and e.ids_of([b""]) == [b""]


@pytest.mark.parametrize("chunk,overlap", [(tokens.CHUNK, tokens.OVERLAP), (700, 40), (300, 2)])
def test_counts_with_and_without_chunks(spark, chunk, overlap):
    rows = texts(spark)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sha string, n long")
    got = tokens.token_counts(docs, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    encode = library()
    want = [(i, len((t or "").encode()), len(encode(t)), len(encode(t)) > 2048) for i, t in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(docs).count() == 0
    assert packing.pack(docs).count() == 0


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pieces_are_whole_and_places_gapless(spark, capacity):
    rows = texts(spark)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack(docs, capacity=capacity).collect()
    encode, want = library(), Counter()
    for i, t in rows:
        ids = np.array([*encode(t), 1], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // capacity) + 2


def least_bins(items, capacity):
    """The fewest sequences, by trying all partitions of a few items."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1:]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = np.random.default_rng(4)
    for _ in range(150):
        items = sorted(rng.integers(1, 21, rng.integers(1, 10)).tolist(), reverse=True)
        lengths = packing._Lengths(Counter(items), 20)
        fixed = packing.reduce_by_dominance(lengths, 20)
        left = [w for w in range(20, 0, -1) for _ in range(int(lengths.n[w]))]
        used = Counter(left)
        for times, pattern in fixed:
            assert sum(pattern) <= 20
            for w in pattern:
                used[w] += times
        assert used == Counter(items)
        assert sum(t for t, _ in fixed) + (least_bins(left, 20) if left else 0) == least_bins(items, 20)
