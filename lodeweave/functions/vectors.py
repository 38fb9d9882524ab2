"""Vector functions as native column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def scaled(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * factor)


def pair_features(a: Column, b: Column) -> Column:
    """Both vectors, the absolute difference and the product, one after another."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.concat(d(a), d(b), F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
