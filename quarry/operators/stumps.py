"""Boosted stumps that stop early, on histograms.

A feature's values fall into equal bins between its least and greatest
training value.  A round is one pass: every row gives its gradient and
curvature to one bin of each feature, and the sums of features x bins are
all that reaches the driver, which picks the split.  The same pass adds up
the validation rows' loss of the rounds so far.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stumps:
    """``stumps``: (feature, last bin of the left side, left, right) by round;
    ``losses``: the validation rows' mean log loss after 0, 1, ... rounds
    (the training rows' where none validates); ``kept``: rounds in use."""

    lows: tuple
    widths: tuple
    bins: int
    base: float
    stumps: tuple
    losses: tuple
    kept: int

    def binned(self, features: str) -> Column:
        """The bin of each feature; values outside the training range are in
        the outer ones, NULL and NaN in the first.  Infinite values set no range."""
        x = F.col(features).cast("array<double>")
        cells = []
        for j, (low, width) in enumerate(zip(self.lows, self.widths)):
            v = F.get(x, j)
            cell = F.least(F.greatest(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(self.bins - 1)) if width else F.lit(0)
            cells.append(F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(cell).cast("int"))
        return F.array(*cells)

    def margin(self, binned: str, rounds: int | None = None) -> Column:
        """The log odds after so many rounds, from the column of bins."""
        used = self.stumps[:self.kept if rounds is None else rounds]
        if not used:
            return F.lit(self.base)
        table = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b")) for j, s, a, b in used])
        return F.aggregate(table, F.lit(self.base), lambda m, t: m + F.when(F.get(F.col(binned), t["j"]) <= t["s"], t["a"]).otherwise(t["b"]))


def _best_split(cells: dict, totals: tuple[float, float], dim: int, lam: float):
    """The split of the greatest gain, ties to the lesser feature and bin."""
    best = None
    for j in range(dim):
        g = h = 0.0
        for s in sorted(b for f, b in cells if f == j)[:-1]:
            g, h = g + cells[j, s][0], h + cells[j, s][1]
            rest = totals[0] - g, totals[1] - h
            gain = g * g / (h + lam) + rest[0] ** 2 / (rest[1] + lam)
            if best is None or gain > best[0] * (1 + 1e-12):
                best = gain, j, s, g / (h + lam), rest[0] / (rest[1] + lam)
    return best


def fit_stumps(df: DataFrame, features: str, target: str, is_validation: Column, rounds: int = 20, tol: float = 0.01,
               bins: int = 32, rate: float = 0.3, lam: float = 1.0) -> Stumps:
    """Log-loss boosting of the 0/1 column ``target`` by Newton leaves.

    A round whose loss on the validation rows is not under the best so far
    by ``tol`` times the loss (at least 0.01) is the last, and only the best
    rounds are in use.  Rows with a NULL target or vector take no part; a
    NULL ``is_validation`` is a training row.  Without a split, or rows,
    there are no rounds.
    """
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"),
                     F.coalesce(is_validation.cast("boolean"), F.lit(False)).alias("val"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    values = [F.get("x", F.lit(j)) for j in range(dim)]
    sound = [F.when(~F.col("val") & (F.abs(v) < F.lit(float("inf"))), v) for v in values]  # NaN is over infinity here
    ends = rows.agg(F.count(F.when(~F.col("val"), 1)).alias("n"), F.sum(F.when(~F.col("val"), F.col("y"))).alias("p"),
                    F.count(F.when(F.col("val"), 1)).alias("v"), *[f(c).alias(f"{n}{j}") for j, c in enumerate(sound) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    lows = tuple(ends[f"lo{j}"] or 0.0 for j in range(dim))
    widths = tuple(((ends[f"hi{j}"] or 0.0) - lows[j]) / bins for j in range(dim))
    n, share = ends["n"], min(max((ends["p"] or 0.0) / max(ends["n"], 1), 1e-6), 1 - 1e-6)
    model = Stumps(lows, widths, bins, math.log(share / (1 - share)), (), (), 0)
    if not n or not dim:
        return model
    judged = F.col("val") if ends["v"] else ~F.col("val")
    data = rows.select(model.binned("x").alias("b"), "y", "val").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stumps, losses, best, kept = [], [], None, 0
        while True:
            now = Stumps(lows, widths, bins, model.base, tuple(stumps), (), len(stumps))
            placed = data.withColumn("m", now.margin("b")).withColumn("p", 1 / (1 + F.exp(-F.col("m"))))
            loss = F.greatest("m", F.lit(0.0)) + F.log1p(F.exp(-F.abs("m"))) - F.col("y") * F.col("m")
            cells = placed.select("y", "val", "p", loss.alias("loss"), F.posexplode("b").alias("j", "s")).groupBy("j", "s").agg(
                F.sum(F.when(~F.col("val"), F.col("y") - F.col("p"))).alias("g"), F.sum(F.when(~F.col("val"), F.col("p") * (1 - F.col("p")))).alias("h"),
                F.sum(F.when(judged, F.col("loss"))).alias("loss"), F.count(F.when(judged, 1)).alias("n")).collect()  # features x bins
            own = [c for c in cells if c["j"] == 0]
            losses.append(sum(c["loss"] or 0.0 for c in own) / sum(c["n"] for c in own))
            if best is None or best - losses[-1] >= tol * max(losses[-1], 0.01):
                best, kept = losses[-1], len(stumps)
            else:
                break
            sums = {(c["j"], c["s"]): (c["g"], c["h"]) for c in cells if c["g"] is not None}
            totals = tuple(sum(v[i] for (j, _), v in sums.items() if j == 0) for i in (0, 1))
            split = _best_split(sums, totals, dim, lam) if len(stumps) < rounds else None
            if split is None:
                break
            stumps.append((split[1], split[2], rate * split[3], rate * split[4]))
        return Stumps(lows, widths, bins, model.base, tuple(stumps), tuple(losses), kept)
    finally:
        data.unpersist()


def boosted_stumps(df: DataFrame, features: str, y: str, positive, is_validation: Column, **sizes):
    """J6 by stumps: (df + target, prediction, n_rounds, model)."""
    data = df.withColumn("target", (F.col(y) == F.lit(positive)).cast("double"))
    model = fit_stumps(data, features, "target", is_validation, **sizes)
    out = data.withColumn("_q_b", model.binned(features)).withColumn("prediction", (model.margin("_q_b") > 0).cast("double"))
    return out.drop("_q_b").withColumn("n_rounds", F.lit(model.kept)), model
