"""Connected components of a graph given by edges, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _least_neighbour(both).filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with u > v."""
    linked = _least_neighbour(edges)
    return (linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(linked.select("u", F.col("m").alias("v"))).distinct())


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node but the least of its component, and the least one.

    ``edges`` has two columns of one ordered type.  Every round is a few
    combinable aggregates and equi-joins, checkpointed; the rounds grow with
    the logarithm of the longest path.
    """
    a, b = (F.col(c) for c in edges.columns)
    now = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .filter(F.col("u") != F.col("v")).distinct().checkpoint())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before = state
        now = _small_star(_large_star(now)).checkpoint()
