"""Registered queries for SURVEY §2.8.

Feature table: ``embeddings``; label 3 against the rest is the minority.
``labels.toxic`` serves the count-only rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.expr import unit_hash
from quarry.operators import imbalance as G
from quarry.plans.registry import register
from quarry.sources.tables import load

MINORITY = 3


def _emb(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.withColumn("is_minority", (F.col("label") == MINORITY).cast("int"))


@register("class_balance", "R", section="G1", sql="""
SELECT toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 10) AS p FROM labels GROUP BY toxic
""")
def q_class_balance(spark, sf):
    out = G.class_balance(load(spark, sf, "labels"), "toxic")
    return out.withColumn("p", F.round("p", 10))


@register("inverse_freq_weight", "R", section="G2", sql="""
SELECT l.*, round(1.0 / (c.n / t.total), 10) AS weight
FROM labels l JOIN (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic) c USING (toxic),
     (SELECT count(*) AS total FROM labels) t
""")
def q_inverse_freq_weight(spark, sf):
    out = G.inverse_freq_weight(load(spark, sf, "labels"), "toxic")
    return out.withColumn("weight", F.round("weight", 10))


@register("threshold_move", "R", section="G3", sql="""
SELECT event_id, round(value / (SELECT max(value) FROM events), 10) AS score,
       CAST(value / (SELECT max(value) FROM events) > 0.2 AS INTEGER) AS pred
FROM events
""")
def q_threshold_move(spark, sf):
    ev = load(spark, sf, "events")
    scored = ev.select("event_id", (F.col("value") / ev.select(F.max("value")).scalar()).alias("score"))
    out = G.threshold_move(scored, "score", 0.2)
    return out.withColumn("score", F.round("score", 10))


@register("undersample", "O", section="G4", sql="""
WITH h AS (SELECT *, ('0x' || substr(md5('u1' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS hh FROM labels),
     sizes AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic),
     k AS (SELECT min(n) AS keep FROM sizes),
     r AS (SELECT h.*, row_number() OVER (PARTITION BY toxic ORDER BY hh, doc_id) AS rk FROM h)
SELECT doc_id, quality, toxic FROM r JOIN sizes USING (toxic), k
WHERE rk <= CASE WHEN sizes.n = k.keep THEN sizes.n ELSE floor(k.keep * 1.0) END
""")
def q_undersample(spark, sf):
    return G.undersample(load(spark, sf, "labels"), "toxic", "doc_id", "u1")


@register("oversample_copies", "O", section="G5", sql="""
SELECT l.*, CAST(t.copy AS INTEGER) AS copy FROM labels l JOIN range(1, 4) t(copy) ON l.toxic = 1 OR t.copy = 1
""")
def q_oversample_copies(spark, sf):
    return G.oversample_copies(load(spark, sf, "labels"), "toxic", 1, 3)


@register("nearest_neighbours", "R", section="G6", sql=f"""
WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label = {MINORITY}),
     d AS (SELECT x.vec_id, y.vec_id AS nb_key, list_sum(list_transform(list_zip(x.e, y.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist2
           FROM m x JOIN m y ON x.vec_id <> y.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist2, nb_key) AS nb_rank FROM d)
SELECT vec_id, nb_key, round(dist2, 8) AS dist2, nb_rank::INT AS nb_rank FROM r WHERE nb_rank <= 5
""")
def q_nearest_neighbours(spark, sf):
    """The minority's exact neighbours, between which smote makes its rows."""
    minority = _emb(spark, sf).filter(F.col("is_minority") == 1)
    return G.near_neighbours(minority, "vec_id", "embedding", 5).select("vec_id", "nb_key", F.round("dist2", 8).alias("dist2"), "nb_rank")


@register("smote", "P", section="G6")
def q_smote(spark, sf):
    return G.smote(_emb(spark, sf), "vec_id", "embedding", "is_minority", 1, k=5, per_row=2)


@register("cluster_undersample", "P", section="G7")
def q_cluster_undersample(spark, sf):
    return G.cluster_undersample(_emb(spark, sf), "vec_id", "embedding", "is_minority")


def _keep(out, *cols):
    return out.select("vec_id", "label", *cols)


@register("penalised_svm", "P", section="G8")
def q_penalised_svm(spark, sf):
    return _keep(G.penalised_svm(_emb(spark, sf), "embedding", "label", MINORITY), "target", "prediction")


@register("penalised_lda", "P", section="G9")
def q_penalised_lda(spark, sf):
    return _keep(G.penalised_lda(_emb(spark, sf), "embedding", "label", MINORITY), "score", "prediction")


@register("divide_conquer_ensemble", "P", section="G10")
def q_divide_conquer_ensemble(spark, sf):
    out = G.divide_conquer_ensemble(_emb(spark, sf), "embedding", "label", MINORITY, n_models=3)
    return _keep(out, "target", "votes", "prediction")


def split_train_test(df, key, test_share=0.2, salt="split"):
    """Deterministic split by a hash of the key."""
    u = unit_hash(salt, F.col(key))
    return df.filter(u >= test_share), df.filter(u < test_share)


@register("layered_ensemble", "P", section="G11")
def q_layered_ensemble(spark, sf):
    train, test = split_train_test(_emb(spark, sf), "vec_id")
    out = G.layered_ensemble(train, test, "embedding", "label", MINORITY)
    return _keep(out, "target", "p1", "p2", "p3", "prediction")


@register("anomaly_then_classify", "P", section="G12")
def q_anomaly_then_classify(spark, sf):
    out = G.anomaly_then_classify(_emb(spark, sf), "embedding", "label", MINORITY, share=0.1)
    return _keep(out, "target", "score", "outlier", "prediction")
