"""Exact order statistics of groups of any size: running counts over ranges of values.

Rows become counts of distinct values, the counts are dealt into ranges of (keys,
value), and the sum of each range tells the next where it begins.  So no task ever
holds or sorts more than a range, though one key may hold the whole table; what
comes last to one place is a row for each range of a key.

Values that are null or NaN are left out; null keys form a group; a group
without a value has no row; ties share what the counts give them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.session import cut


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys under which nulls are equal, too."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in keys])


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys, nulls being equal; the keys stand once."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # right has one row
    renamed = right.select(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(keys)])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in range(len(keys))])


def running_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, n, before): how often each value stands in its group, and how many values are smaller."""
    v = stats.number(F.col(f"`{value}`"))
    counts = df.select(*[F.col(f"`{c}`") for c in keys], v.alias("v")).where("v is not null").groupBy(*[f"`{c}`" for c in keys], "v").agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(counts.repartitionByRange(*[f"`{c}`" for c in keys], "v").withColumn("__range", F.spark_partition_id()))
    parts = [f"`{c}`" for c in keys]
    ahead = Window.partitionBy(*parts).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*parts, "__range").agg(F.sum("n").alias("m")).select(*parts, "__range", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy(*parts, "__range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return match(dealt, starts, [*keys, "__range"]).select(*parts, "v", "n", (F.col("__ahead") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))


def at_places(counts: DataFrame, keys: list[str], places: dict[str, Column]) -> DataFrame:
    """(keys, size, distinct, low, high, one column a place) from running counts; a place is a 0-based number told from ``size``."""
    parts = [f"`{c}`" for c in keys]
    totals = counts.groupBy(*parts).agg(F.sum("n").alias("size"), F.count("v").alias("distinct"), F.min("v").alias("low"), F.max("v").alias("high"))
    totals = cut(totals.select("*", *[p.cast("bigint").alias(f"__at_{name}") for name, p in places.items()]))
    held = [(F.col("before") <= F.col(f"__at_{name}")) & (F.col(f"__at_{name}") < F.col("before") + F.col("n")) for name in places]
    near = match(counts, totals, keys).where(reduce(lambda a, b: a | b, held))
    return near.groupBy(*parts, "size", "distinct", "low", "high").agg(*[F.max(F.when(h, F.col("v"))).alias(name) for name, h in zip(places, held)])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, size, distinct, low, high, one column a share): quantiles linear between the two nearest ranks."""
    counts = cut(running_counts(df, keys, value))
    spot = {name: F.lit(q) * (F.col("size") - 1) for name, q in shares.items()}
    places = {f"__lo_{name}": F.floor(p) for name, p in spot.items()} | {f"__hi_{name}": F.ceil(p) for name, p in spot.items()}
    found = at_places(counts, keys, places)

    def between(name: str) -> Column:
        low, high, p = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), spot[name]
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return found.select(*[f"`{c}`" for c in keys], "size", "distinct", "low", "high", *[between(name).alias(name) for name in shares])


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, n, mean_rank): 1-based ranks of the distinct values of a group; ties share their mean rank."""
    return running_counts(df, keys, value).select(*[f"`{c}`" for c in keys], "v", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("mean_rank"))


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, rho): correlation of mean ranks over the rows that have both values, from counts of pairs."""
    parts = [f"`{c}`" for c in keys]
    x, y = (stats.number(F.col(f"`{c}`")) for c in (a, b))
    pairs = df.select(*parts, x.alias("x"), y.alias("y")).where("x is not null and y is not null")
    counted = cut(pairs.groupBy(*parts, "x", "y").agg(F.count(F.lit(1)).alias("c")))
    whole = counted.groupBy(*parts).agg(F.sum("c").alias("size"))
    told = counted
    for side in ("x", "y"):
        ranks = running_counts(pairs, keys, side).select(*parts, F.col("v").alias(side), (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{side}"))
        told = match(told, ranks, [*keys, side])
    middle = (F.col("size") + 1) / 2  # the mean of mean ranks
    told = match(told, whole, keys).select(*parts, "c", (F.col("rx") - middle).alias("dx"), (F.col("ry") - middle).alias("dy"))
    sums = told.groupBy(*parts).agg(*[F.sum(F.col("c") * F.col(p) * F.col(q)).alias(f"{p}{q}") for p, q in (("dx", "dx"), ("dy", "dy"), ("dx", "dy"))])
    return sums.select(*parts, F.coalesce(F.try_divide(F.col("dxdy"), F.sqrt(F.col("dxdx") * F.col("dydy"))), F.lit(0.0)).alias("rho"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "place") -> DataFrame:
    """df with the number (from 0) of each row in its group; equal rows in no particular order."""
    parts = [f"`{c}`" for c in keys]
    dealt = cut(df.repartitionByRange(*parts, *[f"`{c}`" for c in order]).withColumn("__range", F.spark_partition_id()))
    ahead = Window.partitionBy(*parts).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*parts, "__range").agg(F.count(F.lit(1)).alias("m")).select(*parts, "__range", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy(*parts, "__range").orderBy(*[f"`{c}`" for c in order])
    told = match(dealt, starts, [*keys, "__range"]).withColumn(out, F.col("__ahead") + F.row_number().over(within) - 1)
    return told.drop("__range", "__ahead")
