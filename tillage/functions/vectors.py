"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def hashed_embedding(text: Column, size: int) -> Column:
    """A deterministic stand-in for a model: component i from the first four bytes of sha1(text|i), scaled to unit length."""
    part = lambda i: F.conv(F.substring(F.sha1(F.concat(text, F.lit("|"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    return unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), part))
