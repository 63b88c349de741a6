"""Tail probabilities for the test statistics.

The statistics themselves are Spark aggregates; these formulas turn the one
result row into a p-value.  SciPy is not available, so the regularized
incomplete beta and gamma functions are evaluated here with the classical
continued-fraction / series expansions (Abramowitz & Stegun 6.5, 26.5).
They run inside an Arrow-batched pandas UDF on the (tiny) result rows.  This
module is sent to the workers by value, so they need no copy of the package.
"""

from __future__ import annotations

import math

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# before the UDFs below are made: what they call goes with them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 1e-15
_TINY = 1e-300
_MAX_ITER = 500


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, _MAX_ITER + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Upper regularized incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        term = total = 1.0 / a
        ap = a
        for _ in range(_MAX_ITER):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER + 1):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) for Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or not np.isfinite(t) or not dof or dof <= 0:
        return float("nan")
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def chi2_upper(x: float, k: float) -> float:
    """P(X >= x) for chi-square with ``k`` degrees of freedom."""
    if x is None or k is None or not np.isfinite(x) or not k or k <= 0:
        return float("nan")
    return gammaincc(k / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    if z is None or not np.isfinite(z):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2_p_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(a, b) for a, b in zip(x, k)], dtype="float64")


def t_upper_quantile(q: float, dof: float) -> float:
    """The t that a Student's t stays under with probability ``q`` > 0.5."""
    if q is None or dof is None or not np.isfinite(dof) or dof <= 0:
        return float("nan")
    low, high = 0.0, 1.0
    while 1.0 - t_two_sided(high, dof) / 2.0 < q:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 1.0 - t_two_sided(mid, dof) / 2.0 < q:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


@F.pandas_udf(DoubleType())
def _t_q_udf(q: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_upper_quantile(a, b) for a, b in zip(q, dof)], dtype="float64")


def t_quantile(q: Column, dof: Column) -> Column:
    """Student-t quantile as a Column (for one-row results)."""
    return _t_q_udf(q.cast("double"), dof.cast("double"))


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided Student-t p-value as a Column (for one-row results)."""
    return _t_p_udf(t.cast("double"), dof.cast("double"))


def chi2_p_value(x: Column, k: Column) -> Column:
    """Chi-square upper-tail p-value as a Column (for one-row results)."""
    return _chi2_p_udf(x.cast("double"), k.cast("double"))
