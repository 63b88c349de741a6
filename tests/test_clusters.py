"""Cluster centres of the undersampling."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarry.operators import imbalance as G


def cost(x, centres):
    return sum(((x[i:i + 500, None] - centres[None]) ** 2).sum(2).min(1).sum() for i in range(0, len(x), 500))


def plain(x, centres):
    """Lloyd's method without bounds."""
    for _ in range(200):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(len(centres))])
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres


def test_bounds_change_nothing():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in rng.normal(0, 3, (7, 3))])
    for k in (1, 2, 9):
        start = G._spread_start(x, k, np.random.default_rng(8))
        assert np.allclose(G._lloyd(x, k, 8), plain(x, start), atol=1e-8)


def test_fewer_distinct_rows_than_centres():
    assert G._lloyd(np.ones((5, 2)), 3, 1).tolist() == [[1.0, 1.0]] * 3


def test_centres_cost_no_more_than_plain_kmeans(spark, monkeypatch):
    """Within 5 % of Spark's k-means with all N centres at once; in slices, too."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("m", (F.col("label") == 3).cast("int"))
    x = np.array([r[0] for r in e.filter("m = 0").select("embedding").collect()], float)
    n = e.filter("m = 1").count()
    whole = KMeans(k=n, seed=1, featuresCol="v", maxIter=30).fit(e.filter("m = 0").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    want = cost(x, np.array(whole.clusterCenters()))

    def found():
        rows = G.cluster_undersample(e, "vec_id", "embedding", "m").filter("kind = 'centre'").select("embedding").collect()
        assert len(rows) == n
        return cost(x, np.array([r[0] for r in rows]))
    assert found() <= 1.05 * want
    monkeypatch.setattr(G, "CELL_ROWS", 40)
    assert found() <= 1.15 * want
