"""Column expressions over arrays of numbers, and information criteria."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """A place that one of the arrays lacks counts as 0."""
    return _folded(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")))


def euclidean(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = F.coalesce(x, F.lit(0)).cast("double") - F.coalesce(y, F.lit(0)).cast("double")
        return d * d

    return F.sqrt(_folded(F.zip_with(a, b, square)))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the arrays has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def aic(n: Column, rss: Column, parameters: int) -> Column:
    """Akaike's criterion of a least-squares fit: n ln(rss / n) + 2 k."""
    return n * F.log(rss / n) + 2 * parameters


def bic(n: Column, rss: Column, parameters: int) -> Column:
    """Schwarz's criterion: n ln(rss / n) + k ln n."""
    return n * F.log(rss / n) + parameters * F.log(n)
