"""Order MinHash fingerprints."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quarry.llm import fingerprints


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _id string, n_chars int")
    return [r.asDict() for r in fingerprints.fingerprint(df, **kw).collect()]


def text(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


@pytest.mark.parametrize("blocks", [None, 1, 7, 200])
def test_edited_texts_follow_descending_ids(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(int(i), text(rng, int(rng.integers(1, 40)))) for i in rng.permutation(300)[:150]] + [(1000, None), (1001, ""), (1002, "é" * 7)]
    got = {r["doc_id"]: r for r in run(spark, rows, blocks=blocks)}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if edited == t:
            assert got[i]["fingerprint"] == got[i]["edited_fingerprint"] and got[i]["near_edited"] == 1.0
    assert len(got) == len(rows)


def test_equal_texts_and_likeness(spark):
    rng = np.random.default_rng(2)
    a, b = text(rng, 600), text(rng, 600)
    words = a.split()
    swapped = " ".join(words[300:] + words[:300])
    scattered = " ".join(np.random.default_rng(3).permutation(words))
    near = " ".join(words[:300] + ["new"] + words[301:])
    got = run(spark, [(9, a), (8, a), (7, b), (6, a), (5, near), (4, a), (3, scattered), (2, a), (1, swapped)])
    got = {r["doc_id"]: r for r in got}
    assert got[9]["fingerprint"] == got[8]["fingerprint"] == got[6]["fingerprint"]
    assert got[9]["near_next"] == 1.0 and got[8]["near_next"] == 0.0
    assert got[6]["near_next"] > 0.9 and got[4]["near_next"] < 0.1
    # halves that change places keep the k-mers, not the order of all pairs
    assert 0.1 < got[2]["near_next"] < 0.8
    assert 0.1 < got[9]["near_edited"] <= 1.0


def plain_signatures(t):
    """{slot: 24 bits}, by the method in plain Python."""
    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed
    words = [w.encode() for w in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", t)]
    pairs = list(zip(words, words[1:])) if len(words) > 1 else [(w,) for w in words]
    times, slots = Counter(), {}
    for place, pair in enumerate(pairs):
        kmer = h(*pair) % 2 ** 33
        numbered = h(kmer.to_bytes(8, "little"), times[kmer].to_bytes(4, "little")) % 2 ** 33
        times[kmer] += 1
        slots.setdefault(numbered >> 27, []).append((numbered, place))
    least = {slot: sorted(sorted(found)[:2], key=lambda x: x[1]) for slot, found in slots.items()}
    return {slot: h(*(n.to_bytes(8, "little") for n, _ in found)) % 2 ** 24 for slot, found in sorted(least.items())}


def test_signatures_and_likeness_against_plain_python(spark):
    rng = np.random.default_rng(7)
    texts = [text(rng, int(rng.integers(1, 400))) for _ in range(60)]
    texts += ["", None, "one", "one  two", "a " * 500, "x\ty\nz w   v", "\U0001f600" * 40 + " é", "w" * 33, *texts[:5]]
    texts += [" ".join(texts[3].split()[5:] + texts[4].split()[:9]), texts[5] + " more"]
    got = {r["doc_id"]: r for r in run(spark, list(enumerate(texts)))}
    plain = [plain_signatures(t or "") for t in texts]

    def shown(signatures):
        return "".join(f"{slot << 24 | s:08x}" for slot, s in signatures.items())

    def alike(a, b):
        return sum(a.get(s) == b.get(s) for s in a) / len(a.keys() | b.keys()) if a or b else 1.0
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        edited = plain_signatures(t[:len(t) - len(t) // 3] + after[:len(t) // 3])
        assert got[i]["fingerprint"] == shown(plain[i]) and got[i]["edited_fingerprint"] == shown(edited)
        assert got[i]["near_edited"] == pytest.approx(alike(plain[i], edited))
        assert got[i]["near_next"] == pytest.approx(alike(plain[i], plain[i - 1]))


def test_occurrences_count(spark):
    got = {r["doc_id"]: r for r in run(spark, [(2, "a b " * 50), (1, "a b " * 5)])}
    assert got[2]["fingerprint"] != got[1]["fingerprint"]


def test_nulls_repeats_alone_long_and_empty(spark):
    alone = run(spark, [(5, "one two three four")])[0]
    assert alone["near_next"] == 1.0
    got = run(spark, [(None, "x y"), (None, "x y"), (3, ""), (3, ""), (2, None), (1, "w " * 40_000), (0, "z" * 50_000)])
    assert len(got) == 7
    empty = [r for r in got if r["n_chars"] == 0]
    assert all(r["fingerprint"] == "" and r["near_edited"] == 1.0 for r in empty)
    assert run(spark, []) == []
