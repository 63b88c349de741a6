"""Array/vector helpers kept JVM-side (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.expr import col_of


def as_vector(c) -> Column:
    """array<float|double> -> ml Vector (for Spark ML estimators)."""
    return array_to_vector(col_of(c).cast("array<double>"))


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    prod = F.zip_with(col_of(a), col_of(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays."""
    diff = F.zip_with(col_of(a), col_of(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x)


def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def unit_from_hash(*cols) -> Column:
    """A deterministic number in [0, 1) from the given columns (xxhash64)."""
    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(1 << 30)).cast("double")) / F.lit(float(1 << 30))
