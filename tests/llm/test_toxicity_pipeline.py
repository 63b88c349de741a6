"""The classifier chain on held-out labels, and the pipeline against its parts."""

import importlib
import sys

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, secrets, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_documents(spark):
    """Fitted on labels of four fifths, right on the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    found = toxicity.toxicity(docs, toxicity.as_categories(labels.filter(~held)))
    r = found.join(labels.filter(held).withColumnRenamed("toxic", "y"), "doc_id").agg(
        F.sum(F.when(F.col("toxic") & (F.col("y") == 1), 1).otherwise(0)), F.sum("y"),
        F.sum(F.when(F.col("toxic") & (F.col("y") == 0), 1).otherwise(0)), F.count(F.lit(1))).first()
    assert r[0] >= 0.9 * r[1] and r[2] <= 0.03 * (r[3] - r[1])


def test_rows_stay_and_labels_may_be_odd(spark, corpus):
    docs, labels = corpus
    odd = docs.limit(30).select("doc_id", "text").withColumn("_text", F.lit("x")).withColumn("toxic", F.lit(5))
    odd = odd.unionByName(spark.createDataFrame([(None, None, "x", 5), (None, None, "x", 5), (3, "", "x", 5), (4, "t " * 100_000, "x", 5)], odd.schema))
    names = ("low_quality", "toxic")
    for given in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int")), labels.unionByName(labels).limit(5)):
        found = toxicity.toxicity(odd, toxicity.as_categories(given), names)
        assert found.count() == odd.count() and found.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    assert not found.filter("p_toxic is null or p_toxic < 0 or p_toxic > 1").count()
    assert toxicity.toxicity(odd.limit(0), toxicity.as_categories(labels)).count() == 0
    kept = toxicity.without_toxic(odd, toxicity.as_categories(labels.limit(0)))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_earlier_probabilities_reach_later_models(spark, corpus):
    docs, labels = corpus
    first, second = toxicity.fit_chain(docs, toxicity.as_categories(labels), ("low_quality", "toxic"))
    assert len(first["weights"]) == len(first["terms"]) and len(second["weights"]) == len(second["terms"]) + 1


def test_pipeline_is_its_stages(spark, corpus):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, labels = corpus
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash near-dedup", "secret scans", "mixing sources", "best-fit packing"]
    now = docs
    sizes = []
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).checkpoint()
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        sizes.append(now.count())
    toxic = {r[0] for r in toxicity.toxicity(docs, toxicity.as_categories(labels)).filter("toxic").select("doc_id").collect()}
    assert sizes[0] == docs.count() - len(toxic) and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    # one document of each component of what toxicity left
    clean = docs.filter(~F.col("doc_id").isin(sorted(toxic)))
    assert sizes[1] == simhash.near_duplicates(clean).select("component_id").distinct().count()
    got = pipeline.run(spark, SF)
    want = packing.pack(now)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert secrets.scan(now).agg(F.sum("n_live")).first()[0] == 0
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_pipeline_on_an_empty_table(spark, corpus):
    pipeline = importlib.import_module("corpus_pipeline")
    now = corpus[0].limit(0)
    for _, stage in pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_entry_points_hold_all_queries():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
    assert "corpus_pipeline" in sys.modules


def test_stages_keep_columns_of_any_name(spark, corpus):
    """Helper columns never meet the table's own; rows without columns named for the operators pass through."""
    names = ["_key", "_row", "_cut", "_text", "_copy", "_kept", "_p", "size", "taken"]
    docs = corpus[0].limit(60).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).checkpoint()
    for stage in (simhash.one_of_each, secrets.redact, mixing.mixed, lambda d: toxicity.without_toxic(d, toxicity.as_categories(corpus[1].limit(0)))):
        out = stage(docs)
        assert out.columns == docs.columns and out.count()
        bad = [F.col(n) != F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names]
        assert not out.filter(F.greatest(*[b.cast("int") for b in bad]) == 1).count()


def test_fold_models_find_their_own_terms(spark):
    """Terms and weights come from the rows given: a word that only the held-out
    fold's toxic documents use is unknown to that fold's model."""
    from quarry.llm import toxicity as T
    rows = [(f, float(k % 2), sorted(T._terms(f"calm word{k} " + (f"insult secret{f} " if k % 2 else "thanks ")))) for f in range(3) for k in range(8)]
    train = spark.createDataFrame(rows, "fold int, y0 double, terms array<string>")
    terms, model, as_vectors = T._fit(train.filter("fold <> 0"), 0, 100)
    assert {"=secret1", "=secret2", "=insult"} <= set(terms) and "=secret0" not in terms
    assert model.transform(as_vectors(train.filter("fold = 0"))).filter("prediction <> y0").count() == 0


def test_words_of_any_length_are_terms():
    from quarry.llm.toxicity import _terms
    assert "=" + "x" * 300 in _terms("a " + "x" * 300)
