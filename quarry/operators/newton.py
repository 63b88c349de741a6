"""Logistic members of the ensembles (G10, G11, G12, J5), by Newton's method.

A step is one pass over the rows: every task adds up the gradient and the
Hessian of its rows, and the (d + 1)^2 sums meet in one grouped sum.  The
driver solves a system of d + 1 unknowns; no row reaches it.  The work of a
pass is rows x d^2, so the method is for some hundred features.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import dot, lit_array

# what tasks call goes with them: workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LogisticModel:
    """Weights of the features as they are, and the intercept."""

    coefficients: np.ndarray
    intercept: float
    steps: int = 0

    def margin(self, features: str) -> Column:
        if not self.coefficients.any():  # one class, or none
            return F.lit(float(self.intercept))
        x = F.col(features).cast("array<double>")
        return dot(x, lit_array(self.coefficients)) + F.lit(float(self.intercept))

    def prediction(self, features: str) -> Column:
        """1.0 where the probability is over a half, else 0.0."""
        return (self.margin(features) > 0).cast("double")


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    if (np.diff(batch.column("x").offsets.to_numpy()) != dim).any():
        raise ValueError(f"a feature vector's length is not {dim}")
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _moments(dim: int):
    """Sums over a task's rows: weight, its square, positives, w x, w x^2
    around the first row (shifted, so that large means lose no digits)."""
    def run(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> np.ndarray:
        out = np.zeros(3 + 2 * dim)
        for batch in batches:
            x, y, w = _vectors(batch, dim) - shift, batch.column("y").to_numpy(), batch.column("w").to_numpy()
            out[:3] += w.sum(), (w * w).sum(), (w * y).sum()
            out[3:3 + dim] += w @ x
            out[3 + dim:] += w @ (x * x)
        return out
    return run


def _derivatives(dim: int):
    """Sums over a task's rows at the weights ``at``: loss, gradient, Hessian."""
    def run(batches: Iterator[pa.RecordBatch], at: tuple) -> np.ndarray:
        shift, scale, beta = at
        loss, gradient, hessian = 0.0, np.zeros(dim + 1), np.zeros((dim + 1, dim + 1))
        for batch in batches:
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            z = np.hstack([np.ones((len(y), 1)), (_vectors(batch, dim) - shift) * scale])
            t = z @ beta
            p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
            loss += float(w @ (np.logaddexp(0, t) - y * t))
            gradient += z.T @ (w * (p - y))
            hessian += z.T @ (z * (w * p * (1 - p))[:, None])
        return np.concatenate([[loss], gradient, hessian.ravel()])
    return run


def _summed(rows: DataFrame, job, given) -> np.ndarray:
    """The tasks' sums, added by position: as many numbers as one task has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([job(batches, given)], pa.list_(pa.float64()))], ["sums"])
    found = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    added = found.groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(added))
    for r in added:
        out[r["i"]] = r["v"]
    return out


def fit_logistic(df: DataFrame, features: str, target: str, weight: str | None = None, reg: float = 0.01,
                 max_steps: int = 50, tol: float = 1e-10) -> LogisticModel:
    """The least mean log loss of the 0/1 column ``target`` plus ``reg`` / 2
    times the squared weights of the scaled features (sample standard
    deviations; the intercept is free).

    Rows with a NULL target, vector, component or weight, or a weight of zero,
    take no part; vectors of another length than the first are an error; a feature of one value gets no weight.  One class only: that class
    is predicted for every row; no rows: class 0.  A step that raises the
    loss is halved.  A column ``weight`` counts a row that many times.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), w.alias("w"))
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull()) & F.col("y").isNotNull() & (F.col("w") > 0)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = rows.select("x").first()
        if first is None:
            return LogisticModel(np.zeros(0), -np.inf)
        shift, dim = np.array(first[0]), len(first[0])
        moments = _summed(rows, _moments(dim), shift)
        total, squares, positive = moments[:3]
        if not 0 < positive < total:
            return LogisticModel(np.zeros(dim), np.inf if positive else -np.inf)
        mean = moments[3:3 + dim] / total
        spread = np.maximum(0, moments[3 + dim:] - total * mean ** 2) / max(total - squares / total, 1e-300)
        varies = spread > 1e-18 * np.maximum(1, (shift + mean) ** 2)
        scale = np.where(varies, 1 / np.sqrt(np.where(varies, spread, 1)), 0.0)
        centre = shift + mean
        penalty = np.array([0.0, *np.full(dim, reg)])
        beta, step, value = np.zeros(dim + 1), np.zeros(dim + 1), np.inf
        beta[0] = np.log(positive / (total - positive))
        steps = 0
        while steps < max_steps:
            steps += 1
            found = _summed(rows, _derivatives(dim), (centre, scale, beta)) / total
            now = found[0] + 0.5 * float(penalty @ beta ** 2)
            if now > value + 1e-12 * abs(value):  # too far: half the way
                step = step / 2
                beta = beta - step
                continue
            value = now
            gradient = found[1:dim + 2] + penalty * beta
            hessian = found[dim + 2:].reshape(dim + 1, dim + 1) + np.diag(penalty)
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            beta = beta + step
            if np.abs(step).max() < tol * max(1.0, np.abs(beta).max()):
                break
        weights = beta[1:] * scale
        return LogisticModel(weights, float(beta[0] - weights @ centre), steps)
    finally:
        rows.unpersist()
