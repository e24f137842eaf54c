"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector is unchanged."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (scale == 0), 0.0).otherwise(dot(a, b) / scale)


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
