"""Language identification."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import langid


def kneser_ney(texts, order, letters):
    """The interpolated model as a plain recursion over counts of strings."""
    grams = Counter()
    for t in texts:
        t = " " * (order - 1) + t
        grams.update(t[i:i + order] for i in range(len(t) - order + 1))
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    totals = {n: defaultdict(float) for n in counts}
    kinds = {n: defaultdict(int) for n in counts}
    discount = {}
    for n, table in counts.items():
        once, twice = (sum(1 for c in table.values() if c == k) for k in (1, 2))
        discount[n] = once / (once + 2 * twice) if once else 0.5
        for g, c in table.items():
            totals[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / letters
        if not totals[n][g[:-1]]:
            return lower
        return (max(counts[n][g] - discount[n], 0) + discount[n] * kinds[n][g[:-1]] * lower) / totals[n][g[:-1]]
    return p


def test_probabilities_are_kneser_ney(spark):
    """Every string's cost, seen or not, is that of the plain recursion in each language."""
    texts = {"aa": ["abra cadabra ", "abba "], "bb": ["bcd bcd ", "da capo "]}
    rows = [(lang, t) for lang, ts in texts.items() for t in ts]
    model = langid.fit(spark.createDataFrame(rows, "lang string, _text string"), spark.createDataFrame([], "lang string, _text string"))
    letters = len(set("".join(t for ts in texts.values() for t in ts))) + 1
    some = ["    a", "abrac", "  bcd", "zzzzz", "abraz", "cadab", " d ca", "apo  ", "xabra"]
    got = model.costs(np.array([[ord(c) for c in s] for s in some], np.uint32), langid.ORDER)
    for k, lang in enumerate(model.langs):
        p = kneser_ney(texts[lang], langid.ORDER, letters)
        for i, s in enumerate(some):
            assert math.isclose(got[i, k], -math.log(p(s)), rel_tol=1e-4), (lang, s)


def test_characters():
    codes, doc, letters = langid._characters(["Été!! 12 x", "", "--", "Ab", "नमस्ते"])
    texts = ["".join(chr(c) for c in codes[doc == i]) for i in range(5)]
    assert texts == ["    été x ", "", "", "    ab ", "    नमस्ते "] and letters.tolist()[:4] == [4, 0, 0, 2]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) > 50
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in held) < 0.05 * len(held)


def test_defined_results(spark):
    """Nulls, empty and long texts, repeats, clashing names; held-out rows teach nothing."""
    train = [(i, "the cat sat on the mat and the dog " * 3 if i % 2 else "der hund und die katze sind auf dem dach " * 3, "en" if i % 2 else "de", i) for i in range(60)]
    odd = [(100, None, "en", 0), (101, "", None, 0), (102, "123 !!", "de", 0), (103, "die katze und der hund", None, 0), (103, "die katze und der hund", None, 0),
           (104, "the dog " * 50_000, None, 0), (None, "the mat", "zz", 0)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, score int")
    got = langid.predict(df)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = [r for r in got.collect() if r["doc_id"] is None or r["doc_id"] >= 100]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in rows) == sorted(
        [("100", "und"), ("101", "und"), ("102", "und"), ("103", "de"), ("103", "de"), ("104", "en"), ("None", "en")])
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    none = langid.predict(df.withColumn("lang", langid.F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert langid.predict(df.limit(0)).collect() == []


@pytest.mark.parametrize("cells", [40, 400])
def test_small_models_still_tell_languages(spark, cells):
    """The rarest strings go when the model must be small; every document is still scored whole."""
    train = [(i, "the cat sat on the mat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(80)]
    got = langid.predict(spark.createDataFrame(train, "doc_id long, text string, lang string"), most_cells=cells).collect()
    assert len(got) == 80 and sum(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in got) == 80


@pytest.mark.parametrize("cells", [0, 300])
def test_model_too_large_for_a_task_is_whole(spark, cells, monkeypatch):
    """Strings beyond what tasks hold are joined: results are those of the whole model, long texts in parts, too."""
    rng = np.random.default_rng(5)
    words = {"en": "the cat sat on a mat and some dog ran by it".split(), "de": "der hund und die katze sind auf dem dach 😀x".split(), "fr": "le chat est sur la table et un chien".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(1000, "zebra quux hund", None), (1001, None, "en"), (1002, "!!", None), (1003, "le chat zzz " * 400, None), (1003, "le chat zzz " * 400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SLICE", 1500)
    want, got = (sorted(langid.predict(docs, most_cells=n).collect(), key=lambda r: (r["doc_id"], r["score"])) for n in (10_000_000, cells))
    assert len(want) == len(got) == len(rows)
    for a, b in zip(want, got):
        assert (a["doc_id"], a["held_out"], a["lang_pred"]) == (b["doc_id"], b["held_out"], b["lang_pred"])
        assert math.isclose(a["score"], b["score"], abs_tol=1e-4) and (a["entropy"] is None) == (b["entropy"] is None)
        assert a["entropy"] is None or math.isclose(a["entropy"], b["entropy"], rel_tol=1e-4)


def test_all_of_the_calibration_counts(spark):
    """Limits are exact quantiles over all calibrating texts, however many."""
    model = langid.Model(["a", "b"], [], [], np.zeros(2))
    rng = np.random.default_rng(9)
    h = rng.uniform(1, 2, (12_345, 2))
    truth = rng.integers(0, 2, len(h))
    df = spark.createDataFrame([("ab"[k], x) for k, x in zip(truth.tolist(), h.tolist())], "lang string, h array<double>")
    langid.calibrate(model, df.repartition(7))
    right = h.argmin(1) == truth
    for k in range(2):
        assert math.isclose(model.limits[k], np.quantile(h[right & (truth == k), k], 1 - langid.REJECT, method="higher"))
    assert math.isclose(model.least_score, np.quantile(langid._chances(h, model.temperature).max(1)[right], langid.REJECT, method="lower"))
