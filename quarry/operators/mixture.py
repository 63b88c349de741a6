"""A Gaussian mixture by expectation and maximisation.

A step is one aggregate over the rows: densities, responsibilities and their
moments are column expressions, so the rows stay in the JVM and only the k
components' sums reach the driver.  A step has k (d + 1)(d + 2) / 2 sums, so
wide vectors are projected to a few principal components first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: added to every covariance's diagonal, times its trace
RIDGE = 1e-9


@dataclass(frozen=True)
class Mixture:
    """k components of d dimensions; ``gains`` holds the mean log likelihood
    that each step started from."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    gains: tuple = ()

    def log_parts(self, x: list[Column]) -> list[Column]:
        """Each component's log weight plus log density at the point ``x``."""
        out = []
        for weight, mean, covariance in zip(self.weights, self.means, self.covariances):
            root = np.linalg.inv(np.linalg.cholesky(covariance))
            base = math.log(max(weight, 1e-300)) + float(np.log(np.diag(root)).sum()) - len(mean) / 2 * math.log(2 * math.pi)
            away = [sum((F.lit(float(row[j])) * (x[j] - F.lit(float(mean[j]))) for j in range(i + 1)), F.lit(0.0)) for i, row in enumerate(root)]
            out.append(F.lit(base) - F.lit(0.5) * reduce(Column.__add__, [z * z for z in away]))
        return out

    def log_density(self, features: str) -> Column:
        """The log density of an array column; NULL where a component is NULL."""
        parts = F.array(*self.log_parts(_point(features, self.means.shape[1])))
        top = F.array_max(parts)
        total = F.aggregate(F.transform(parts, lambda t: F.exp(t - top)), F.lit(0.0), lambda a, t: a + t)
        return F.when(F.forall(features, lambda v: v.isNotNull()), top + F.log(total))


def _point(features: str, dim: int) -> list[Column]:
    return [F.get(F.col(features), i).cast("double") for i in range(dim)]


def _steadied(covariance: np.ndarray) -> np.ndarray:
    return covariance + np.eye(len(covariance)) * RIDGE * max(float(np.trace(covariance)), 1e-9)


def _step(rows: DataFrame, model: Mixture, n: int) -> Mixture:
    """One pass: responsibilities at ``model``, and the mixture of their moments."""
    k, d = model.means.shape
    x = [F.col(f"x{i}") for i in range(d)]
    placed = rows.select("*", *[t.alias(f"t{c}") for c, t in enumerate(model.log_parts(x))])
    placed = placed.withColumn("top", F.array_max(F.array(*[F.col(f"t{c}") for c in range(k)])))
    placed = placed.withColumn("l", F.col("top") + F.log(sum((F.exp(F.col(f"t{c}") - F.col("top")) for c in range(k)), F.lit(0.0))))
    placed = placed.select(*x, "l", *[F.exp(F.col(f"t{c}") - F.col("l")).alias(f"r{c}") for c in range(k)])
    sums = [F.sum("l")]
    for c in range(k):  # moments around the component's last mean
        r, z = F.col(f"r{c}"), [x[i] - F.lit(float(model.means[c, i])) for i in range(d)]
        sums += [F.sum(r), *[F.sum(r * z[i]) for i in range(d)], *[F.sum(r * z[i] * z[j]) for i in range(d) for j in range(i + 1)]]
    found = np.array(placed.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), dtype=float)
    parts = found[1:].reshape(k, -1)
    weights, means, covariances = parts[:, 0] / n, model.means.copy(), model.covariances.copy()
    for c, p in enumerate(parts):
        if p[0] <= 1e-12 * n:  # a component without rows stays where it is
            continue
        move, second = p[1:d + 1] / p[0], np.zeros((d, d))
        second[np.tril_indices(d)] = p[d + 1:] / p[0]
        second = second + np.tril(second, -1).T
        means[c] += move
        covariances[c] = _steadied(second - np.outer(move, move))
    return Mixture(weights, means, covariances, (*model.gains, found[0] / n))


def fit_mixture(df: DataFrame, features: str, k: int, max_steps: int = 30, tol: float = 1e-4) -> Mixture | None:
    """``k`` Gaussians of the array column ``features``.

    All start with the rows' covariance, side by side along the vector of
    standard deviations, so that no seed is needed; steps end when the mean
    log likelihood grows by less than ``tol``.  Rows with a NULL vector or
    component, or one that is no finite number, take no part; without any
    row there is no mixture (None).  A single row, or equal rows, have a
    spread near zero.
    """
    finite = F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = df.filter(finite)
    first = rows.select(features).first()
    if first is None:
        return None
    d = len(first[0])
    rows = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(_point(features, d))])
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    # around the first row, so that large means lose no digits
    z = [F.col(f"x{i}") - F.lit(float(first[0][i])) for i in range(d)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(z[i]).alias(f"m{i}") for i in range(d)],
                     *[F.covar_samp(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    n, mean = found["n"], np.array([found[f"m{i}"] for i in range(d)]) + np.array(first[0], dtype=float)
    covariance = np.zeros((d, d))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = found[f"c{i}_{j}"] or 0.0
    spread = np.sqrt(np.diag(covariance))
    means = np.array([mean + ((2 * c + 1) / k - 1) * spread for c in range(k)])
    model = Mixture(np.full(k, 1 / k), means, np.array([_steadied(covariance)] * k))
    for _ in range(max_steps):
        model = _step(rows, model, n)
        if len(model.gains) > 1 and model.gains[-1] - model.gains[-2] < tol:
            break
    return model
