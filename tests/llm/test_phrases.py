"""Phrase collocations."""

import random
import re
from collections import Counter

import pytest

from quarry.llm import phrases


def brute(rows, longest=5, least=100, first=2000, absorb=100):
    """Plain counting, straight from the definition."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                f.update((lang or "und" if lang is None else lang, *words[i:i + m]) for i in range(len(words) - m + 1))
    n = Counter()
    for (lang, *words), a in f.items():
        n[lang] += a * (len(words) == 1)
    out = []
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    gone = set()
    for (lang, *w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, *w[i:i + k])
                if 100 * a >= absorb * f[part]:
                    gone.add(part)
    for key, a in candidates.items():
        lang, *w = key
        if key in gone:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked, seen = [], Counter()
    for lang, phrase, a, left, right, total, score in sorted(out, key=lambda x: (x[0], -x[6], -x[2], x[1].encode())):
        seen[lang] += 1
        if seen[lang] <= first:
            ranked.append((lang, seen[lang], phrase, a, left, right, total, score))
    return ranked


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "A", "é", "É", "x\x00y", "New", "york", "w z", "d\x1ce", "-"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; ", "\r\n"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60)))) for _ in range(40)]
    return [*rows, *rows[:9], ("en", None), ("en", ""), (None, None), ("de", " . "), ("en", "new york city " * 400), ("xx", "rare words here")]


@pytest.mark.parametrize("options", [
    {"least": 2, "first": 5, "longest": 3}, {"least": 3, "absorb": 60, "slice_bytes": 40, "hot_least": 1, "filter_bits": 1 << 15}])
def test_against_brute_force(spark, options):
    """Cut texts, slots for hot prefixes and a crowded filter change nothing."""
    rows = corpus(len(options))
    df = spark.createDataFrame([(lang, text, i, "x", 1) for i, (lang, text) in enumerate(rows)], "lang string, text string, phrase long, a string, n int").repartition(3)
    got = phrases.mine(df, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, **{k: v for k, v in options.items() if k in ("least", "first", "longest", "absorb")})
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_stripe_totals(spark):
    """A merged stripe adds up to its prefix's count, whatever follows it."""
    rows = [("en", "a b a b a c. a\na b")] * 3
    df = spark.createDataFrame(rows, "lang string, _text string").repartition(3)
    one = phrases.merged(df.mapInArrow(phrases._striper(1, 5, None, phrases.np.zeros(0, "uint64"), 64, 1 << 20), phrases.STRIPES), 2)
    bits, hot = phrases._filter_of(spark.createDataFrame([("en", "a", 18), ("en", "b", 9)], "lang string, phrase string, a long"), 1 << 40, 1 << 20)
    two = phrases.merged(df.mapInArrow(phrases._striper(2, 5, bits, hot, 64, 1 << 20), phrases.STRIPES), 2)
    assert sum(r["total"] for r in one.collect()) == 27
    got = {r["prefix"]: (r["total"], sorted(map(tuple, r["stripe"]))) for r in two.collect()}
    assert got == {"a": (15, [("b", 9)]), "b": (9, [("a", 6)])}


def test_long_scores_are_exact(spark):
    """Products beyond 64 bits."""
    rows = [("en", "p q " * 30_000)] * 50 + [("en", "u v")] * 100
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.mine(df).collect()}
    n = 50 * 60_000 + 200
    assert got["u v"] == (100, 100, 100, n, 1000 * 100 * n // 10_000)


def test_empty(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.mine(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).collect() == []
