"""Registered queries for SURVEY §2.11 (J1-J7) and I11."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.expr import unit_hash
from quarry.operators import models as J
from quarry.plans.q_imbalance import MINORITY, _emb
from quarry.plans.registry import register
from quarry.sources.tables import load


@register("standardise", "R", section="J1", sql="""
SELECT p_partkey,
       round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 10) AS p_size_z,
       round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 10) AS p_retailprice_z,
       round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 10) AS p_size_mm,
       round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 10) AS p_retailprice_mm
FROM part
""")
def q_standardise(spark, sf):
    p = load(spark, sf, "part")
    cols = ["p_size", "p_retailprice"]
    out = J.standardise(J.standardise(p, cols, "zscore"), cols, "minmax")
    return out.select("p_partkey", *[F.round(c, 10).alias(c) for c in
                                     ("p_size_z", "p_retailprice_z", "p_size_mm", "p_retailprice_mm")])


def _keep(out, *cols):
    return out.select("vec_id", "label", *cols)


@register("elastic_net", "P", section="J2")
def q_elastic_net(spark, sf):
    out, _ = J.elastic_net(_emb(spark, sf), "embedding", "label", MINORITY, alpha=0.5, lam=0.01)
    return _keep(out, "target", "prediction")


@register("feature_subset", "O", section="J3", sql="""
WITH d AS (SELECT max(len(embedding)) AS d FROM embeddings),
     j AS (SELECT unnest(range(0, d)) AS j FROM d),
     ranked AS (SELECT j, row_number() OVER (ORDER BY md5('fs1' || CAST(j AS VARCHAR)), j) AS r FROM j),
     picked AS (SELECT j FROM ranked, d WHERE r <= CAST(round(0.25 * d) AS BIGINT))
SELECT e.vec_id, e.label, CAST(p.j AS BIGINT) AS feature, e.embedding[p.j + 1] AS value
FROM embeddings e, picked p
""")
def q_feature_subset(spark, sf):
    out, idx = J.feature_subset(_emb(spark, sf), "embedding", 0.25, "fs1", "features")
    # one row per (vector, kept feature): (vec_id, label, feature, value)
    original = F.array(*[F.lit(int(i)) for i in idx])
    long = out.select("vec_id", "label", F.posexplode("features").alias("_q_p", "value"))
    return long.select("vec_id", "label", F.element_at(original, F.col("_q_p") + 1).cast("long").alias("feature"),
                       "value")


@register("shallow_tree", "P", section="J4")
def q_shallow_tree(spark, sf):
    out, _ = J.shallow_tree(_emb(spark, sf), "embedding", "label", MINORITY, max_depth=3)
    return _keep(out, "target", "prediction")


@register("bagging_mixed", "P", section="J5")
def q_bagging_mixed(spark, sf):
    out = J.bagging_mixed(_emb(spark, sf), "embedding", "label", MINORITY, "vec_id")
    return _keep(out, "target", "pred_logistic", "pred_tree", "pred_svm", "votes", "prediction")


@register("early_stopping", "P", section="J6")
def q_early_stopping(spark, sf):
    is_val = unit_hash("val", F.col("vec_id")) < 0.2
    out, _ = J.early_stopping(_emb(spark, sf), "embedding", "label", MINORITY, is_val, max_iter=10)
    return _keep(out, "target", "prediction", "n_trees")


@register("pca", "P", section="J7")
def q_pca(spark, sf):
    out, _ = J.pca(_emb(spark, sf), "embedding", 4)
    return _keep(out, "components")


@register("als_recommend", "P", section="I11")
def q_als_recommend(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.sum("l_quantity").alias("qty"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    inter = li.join(o, li.l_orderkey == o.o_orderkey)
    return J.als_recommend(inter, "o_custkey", "l_partkey", "qty", top_n=5)
