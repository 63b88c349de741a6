"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models; the
probability of each earlier category is a feature of all later ones.  While
training, these probabilities are out of fold: they come from models whose
terms and weights were found without the document and its labels.  The
features are a document's words and word beginnings, as far as they tell a
category's documents from the others in the rows that the model is fitted
on.  The models are fitted on at most ``max_train`` labelled documents; every
document is scored, on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ship, text_of, tidy, written

#: bounds of the training sample and of the features of one category
MAX_TRAIN, MAX_TERMS, FOLDS = 10_000, 1500, 3
#: letters of the word beginnings
BEGINNINGS = (4, 6)


def _terms(text: str) -> set[str]:
    import re
    words = set(re.findall(r"\w+", text.lower()))
    terms = {"=" + w for w in words}
    for n in BEGINNINGS:
        terms.update(w[:n] for w in words)
    return terms


def _term_lister():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "_text"]
            for k in range(0, batch.num_rows, 500):  # the lists of a few documents at a time
                part = batch.slice(k, 500)
                terms = [sorted(_terms(t)) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(terms, pa.list_(pa.string()))], [*keep, "terms"])
    return tidy(run)


def _probabilities(models: list[dict]):
    """A function from a text to its categories' probabilities, in order."""
    place: dict[str, int] = {}
    for m in models:
        for t in m["terms"]:
            place.setdefault(t, len(place))
    weights = np.zeros((len(models), len(place)))
    for c, m in enumerate(models):
        weights[c, [place[t] for t in m["terms"]]] = m["weights"][:len(m["terms"])]
    known = place.keys()

    def of(text: str) -> list[float]:
        at = [place[t] for t in known & _terms(text)]
        earlier: list[float] = []
        for c, m in enumerate(models):
            z = weights[c, at].sum() + np.dot(m["weights"][len(m["terms"]):], earlier) + m["intercept"]
            earlier.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return earlier
    return of


def _scorer(models: list[dict]):
    """Adds an array of the categories' probabilities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _probabilities(models)
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column("_text")]
            keep = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.float64()))], [*keep, "_p"])
    return tidy(run)


def _telling_terms(train: DataFrame, category: str, most: int) -> list[str]:
    """The terms whose share of the category's documents stands out most."""
    n, positive = train.agg(F.count(F.lit(1)), F.sum(category)).first()
    counts = train.select(F.explode("terms").alias("term"), F.col(category).alias("y")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("y").alias("pos"))
    p, q = F.col("pos") / positive, (F.col("df") - F.col("pos")) / (n - positive)
    pooled = F.col("df") / n
    z = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / (n - positive)) + F.lit(1e-9))
    best = counts.filter(F.col("df") >= 3).withColumn("z", z).orderBy(F.desc("z"), "term").limit(most)
    return [r["term"] for r in best.select("term").collect()]  # at most `most`


def _constant(rate: float, earlier: int) -> dict:
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return {"terms": [], "weights": np.zeros(earlier), "intercept": float(np.log(rate / (1 - rate)))}


def _fit(rows: DataFrame, i: int, max_terms: int):
    """The terms of category ``i``, its model, and the function that gives rows
    their vectors ``x``: everything from ``rows``, which hold both values."""
    n, positive = rows.agg(F.count(F.lit(1)), F.sum(f"y{i}")).first()
    terms = _telling_terms(rows, f"y{i}", max_terms) or ["="]
    bag = CountVectorizerModel.from_vocabulary(terms, "terms", "_bag").setBinary(True)
    assembler = VectorAssembler(inputCols=["_bag", *[f"p{j}" for j in range(i)]], outputCol="x")

    def as_vectors(of: DataFrame) -> DataFrame:
        return assembler.transform(bag.transform(of))
    balance = F.when(F.col(f"y{i}") == 1, F.lit(float(n - positive) / positive) ** 0.5).otherwise(F.lit(1.0))
    regression = LogisticRegression(featuresCol="x", labelCol=f"y{i}", weightCol="w", regParam=0.002, maxIter=25)
    return terms, regression.fit(as_vectors(rows).withColumn("w", balance)), as_vectors


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text",
              max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS, folds: int = FOLDS) -> list[dict]:
    """One model for each category, in order: terms, their weights and those
    of the earlier categories' probabilities, intercept.

    ``labels`` has the id and a 0/1 column per category; rows with a null in
    any of them are left out, of rows with one id the least is used.  The
    sample is the ``max_train`` ids with the smallest hash.  A category with
    one value only, or no labels at all, gets a constant model.
    """
    rows = labels.dropna(subset=[id_col, *categories]).groupBy(F.col(id_col).alias("_lid")).agg(
        F.min(F.struct(*[F.col(c).cast("double").alias(c) for c in categories])).alias("y"))
    sample = F.broadcast(rows.orderBy(F.xxhash64("_lid"), "_lid").limit(max_train))  # bounded by max_train
    fold = F.pmod(F.xxhash64("_lid", F.lit(5)), F.lit(folds)).cast("int")
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(sample, F.col("_id") == F.col("_lid"))
    texts = texts.select(fold.alias("fold"), *[F.col(f"y.{c}").alias(f"y{i}") for i, c in enumerate(categories)], "_text")
    schema = "fold int, " + ", ".join(f"y{i} double" for i in range(len(categories)))
    train = written(texts.repartition(24).mapInArrow(_term_lister(), f"{schema}, terms array<string>"), "toxicity-train")
    models = []
    for i in range(len(categories)):
        n, positive = train.agg(F.count(F.lit(1)), F.sum(f"y{i}")).first()
        if not n or not 0 < positive < n:
            models.append(_constant(positive / n if n else 0.0, i))
            train = train.withColumn(f"p{i}", F.lit(positive / n if n else 0.0))
            continue
        terms, model, _ = _fit(train, i, max_terms)
        models.append({"terms": terms, "weights": np.array(model.coefficients.toArray()), "intercept": float(model.intercept)})
        if i + 1 == len(categories):
            break
        parts = []
        for f in range(folds):
            seen, unseen = train.filter(F.col("fold") != f), train.filter(F.col("fold") == f)
            if seen.agg(F.countDistinct(f"y{i}")).first()[0] < 2:
                part = unseen.withColumn(f"p{i}", F.lit(positive / n))
            else:
                _, fitted, as_vectors = _fit(seen, i, max_terms)
                part = fitted.transform(as_vectors(unseen)).withColumn(f"p{i}", vector_to_array("probability")[1])
            parts.append(part.select(*train.columns, f"p{i}"))
        train = written(reduce(DataFrame.unionByName, parts), "toxicity-folds")
    return models


def score(docs: DataFrame, models: list[dict], categories: tuple[str, ...], text_col: str = "text",
          keep: dict | None = None) -> DataFrame:
    """The columns of ``keep`` (name: column) and ``p_<category>`` for each row."""
    keep = keep or {}
    rows = docs.select(*[c.alias(f"_k{i}") for i, c in enumerate(keep.values())], text_of(text_col).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    found = rows.mapInArrow(_scorer(models), f"{schema}, _p array<double>")
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], *[F.col("_p")[i].alias(f"p_{c}") for i, c in enumerate(categories)])


#: the registered chain: low quality first, then toxic
CATEGORIES, LIMIT = ("low_quality", "toxic"), 0.2


def as_categories(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id",
             text_col: str = "text", limit: float = LIMIT, **sizes) -> DataFrame:
    """(id, p_<category>..., toxic), one row per row of ``docs``: toxic if the
    last category's probability is over ``limit``.

    A null or empty text has no terms and gets what the intercepts say.
    Null and repeated ids keep their rows; other columns are not read.
    Without labels nothing is toxic.
    """
    models = fit_chain(docs, labels, categories, id_col, text_col, **sizes)
    return score(docs, models, categories, text_col, {id_col: F.col(id_col)}).withColumn("toxic", F.col(f"p_{categories[-1]}") > limit)


def _keeper(models: list[dict], text_col: str, limit: float):
    """The rows of a batch whose last category's probability is not over ``limit``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _probabilities(models)
        for batch in batches:
            stays = [of(str(t.as_py()) if t.is_valid else "")[-1] <= limit for t in batch.column(text_col)]
            yield batch.filter(pa.array(stays, pa.bool_()))
    return tidy(run)


def without_toxic(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, id_col: str = "doc_id",
                  text_col: str = "text", limit: float = LIMIT, **sizes) -> DataFrame:
    """The rows of ``docs`` that are not toxic, as they are."""
    models = fit_chain(docs, labels, categories, id_col, text_col, **sizes)
    return docs.mapInArrow(_keeper(models, text_col, limit), docs.schema)


ship(__name__)
