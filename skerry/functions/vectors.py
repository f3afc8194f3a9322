"""Vector expressions on arrays; sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a null, empty or zero vector and for unequal lengths."""
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    scale = norm(a) * norm(b)
    return F.when(usable & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """A vector of norm 0 stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n))).otherwise(F.transform(a, lambda x: x.cast("double")))


def fit_dim(a: Column, dim: int) -> Column:
    """Cut or zero-padded to ``dim`` numbers."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)
