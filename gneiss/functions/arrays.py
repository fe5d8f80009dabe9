"""Array expressions with the rules of script arrays: places from the end, depth of flattening, pairs to the shorter end.

All are null for a null array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slice_of(col: Column, start: int = 0, end: int | None = None) -> Column:
    """Elements from ``start`` to before ``end``; negative places count from the end, and what lies outside is left out."""
    n = F.size(col)

    def place(k: int) -> Column:
        return F.least(F.lit(k), n) if k >= 0 else F.greatest(n + k, F.lit(0))

    low, high = place(start), n if end is None else place(end)
    return F.slice(col, low + 1, F.greatest(high - low, F.lit(0)))


def flat(col: Column, depth: int = 1) -> Column:
    """An array of arrays opened so many times; null parts are left out."""
    for _ in range(depth):
        col = F.flatten(F.filter(col, lambda x: x.isNotNull()))
    return col


def includes(col: Column, value: Column) -> Column:
    """Whether a value is in an array; a null is found among nulls, too."""
    return F.when(col.isNotNull(), F.exists(col, lambda x: x.eqNullSafe(value)))


def zipped(left: Column, right: Column) -> Column:
    """Pairs (a, b) by place, up to the shorter end."""
    n = F.least(F.size(left), F.size(right))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
