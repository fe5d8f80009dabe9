"""Joins by order and by range, without a product of the two sides."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import ordered
from gneiss.session import cut


#: Pairs of a point and a range that a task compares, about.
_PAIRS = 20_000_000


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """left with the values of the right row of its keys whose time is the last not after its own; null where there is none.

    Both sides are stacked and dealt into ranges of keys and time, so no pair of rows is
    made and the rows of one key may fill many ranges; a range carries the last right
    row it holds into the next ones.  Of right rows of equal keys and time the greatest
    values count; a null time, and a null key, matches nothing.
    """
    matched = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, time)])
    found = right.where(matched).groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("__found"))
    kind = found.schema["__found"].dataType
    rows = left.withColumns({"__found": F.lit(None).cast(kind), "__left": F.lit(1)})
    both = rows.unionByName(found.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    dealt = cut(both.repartitionByRange(*keys, time, "__left").withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy(*keys, "__range").orderBy(F.col(time).asc_nulls_first(), "__left").rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.withColumn("__found", F.last("__found", ignorenulls=True).over(w))
    ends = dealt.where("__left = 0").groupBy(*keys, "__range").agg(F.max_by("__found", time).alias("__end"))
    marks = dealt.select(*keys, "__range").distinct().join(ends, [*keys, "__range"], "left")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*keys, "__range", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    joined = ordered.match(told.where("__left = 1"), carried, [*keys, "__range"], "left")
    best = F.when(F.col(time).isNotNull(), F.coalesce("__found", "__carried"))
    return joined.withColumn("__found", best).select(*left.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join of points and the ranges [low, high] that hold them, by buckets.

    A range has the level at which buckets, each 16 times as wide as those of the level
    before, are at least as long as it is, so that it touches one or two of them; a
    point is posted once at every level there is.  A pair meets once.  A bucket of many
    pairs is cut into pieces by the points, each with all its ranges, and there are as
    many tasks as the pairs ask for, so that no task is long (equal points share a piece).  ``width`` is
    that of the narrowest buckets, near the length of a short range.
    """
    ratio = (F.col(high) - F.col(low)) / F.lit(float(width))
    level = F.when(ratio > 1, F.ceil(F.log(ratio) / F.lit(math.log(16)))).otherwise(0).cast("int")
    usable = ranges.where(F.col(low) <= F.col(high)).withColumn("__level", level)
    levels = [r[0] for r in usable.select("__level").distinct().collect()]  # few, as each is 16 times as wide

    def bucket(column: Column):
        return F.floor(column / (F.lit(float(width)) * F.pow(F.lit(16.0), F.col("__level"))))

    posted = usable.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    at = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    placed = points.where(F.col(point).isNotNull()).withColumn("__level", F.explode(at)).withColumn("__bucket", bucket(F.col(point)))
    place = ["__level", "__bucket"]
    met = cut(placed.groupBy(*place).agg(F.count("*").alias("__p")).join(posted.groupBy(*place).agg(F.count("*").alias("__q")), place))
    cutting = met.select(*place, F.ceil(F.col("__p") * F.col("__q") / F.lit(float(_PAIRS))).alias("__pieces")).where("__pieces > 1")
    tasks = met.agg(F.ceil(F.sum(F.col("__p") * F.col("__q") / F.lit(float(_PAIRS)))).alias("n")).first().n or 1
    pieces = F.coalesce("__pieces", F.lit(1))
    placed = placed.join(cutting, place, "left").withColumn("__piece", F.pmod(F.xxhash64(*points.columns), pieces)).drop("__pieces")
    posted = posted.join(cutting, place, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("__pieces")
    tasks = max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed, posted = (side.repartition(tasks, *place, "__piece") for side in (placed, posted))
    return placed.join(posted, [*place, "__piece"]).where(F.col(point).between(F.col(low), F.col(high))).drop(*place, "__piece")


def contradictions(causes: DataFrame, effects: DataFrame, key: str, correlation: str, coefficient: str, least: float = 0.7) -> DataFrame:
    """Rows of both sides whose correlation is strong while the fitted coefficient is negative."""
    return causes.where(F.col(correlation) > least).join(effects.where(F.col(coefficient) < 0), key)
