"""Seeded synthetic rows and their comparison with real ones."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sales_sample(spark: SparkSession, rows: int = 60, seed: int = 1) -> DataFrame:
    """A small shop: dates three days apart, round-robin products and regions, a seasonal sales curve."""
    i = F.col("id")
    sales = F.round(1500 + 25 * i + 400 * F.sin(0.3 * i) + (F.rand(seed) - 0.5) * 300)
    base = spark.range(rows).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (3 * i).cast("int")).alias("date"), sales.alias("sales"))
    product = F.concat(F.lit("product "), (i % 6).cast("string"))
    out = base.withColumns({"product": product, "region": F.element_at(F.array(*map(F.lit, ("north", "south", "east", "west"))), (i % 4 + 1).cast("int"))})
    return out.withColumn("quantity", F.greatest(F.lit(1), F.round(F.col("sales") / 40 + (F.rand(seed + 1) - 0.5) * 5))).withColumn("unit_price", F.round(F.col("sales") / F.col("quantity"), 2))


def synthesize(df: DataFrame, numeric: list[str], categorical: list[str], rows: int, seed: int = 1) -> DataFrame:
    """Rows with each numeric column normal around its mean and each categorical one by its frequencies.

    A category is drawn by a join of a random number with the cumulative shares of
    all categories, cut into steps, so their number is not bounded.
    """
    spark = df.sparkSession
    out = spark.range(rows)
    if numeric:
        moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        out = out.withColumns({c: F.lit(moments[f"m_{c}"]) + F.randn(seed + k) * F.lit(moments[f"s_{c}"] or 0.0) for k, c in enumerate(numeric)})
    for k, c in enumerate(categorical):
        out = _drawn(out, df, c, seed + 100 + k)
    return out


def _drawn(out: DataFrame, df: DataFrame, column: str, seed: int, steps: int = 1000) -> DataFrame:
    """out with a column of values of df, each drawn with its share.

    Values are put in order of a hash inside ``steps`` groups, whose sums are few; a
    drawn number of rows falls into a group first and into a value of the group then.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("__v")).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__g", F.pmod(F.xxhash64("__v"), F.lit(steps)))
    inside = Window.partitionBy("__g").orderBy("__v")
    counts = counts.withColumn("__past", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    groups = counts.groupBy("__g").agg(F.sum("__n").alias("n")).orderBy("__g").collect()  # at most ``steps`` rows
    edges = list(accumulate(r.n for r in groups))
    if not edges:
        return out.withColumn(column, F.lit(None).cast("string"))
    past, names = F.array(*map(F.lit, edges)), F.array(*[F.lit(r["__g"]) for r in groups])
    starts = F.array(F.lit(0), *map(F.lit, edges[:-1]))
    drawn = out.withColumn("__at", F.floor(F.rand(seed) * edges[-1]).cast("long"))
    drawn = drawn.withColumn("__k", F.size(F.filter(past, lambda e: e <= F.col("__at"))))
    drawn = drawn.withColumns({"__group": names[F.col("__k")], "__rest": F.col("__at") - starts[F.col("__k")]})
    # of the group's values, by falling sums, the last before the rest of the number
    values = counts.select(F.col("__g").alias("__group"), F.col("__past").alias("__rest"), F.col("__v"))
    both = drawn.drop("__at", "__k").unionByName(values, allowMissingColumns=True)
    seen = Window.partitionBy("__group").orderBy(F.desc("__rest"), F.col("__v").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(column, F.last("__v", True).over(seen)).where(F.col("__v").isNull())
    return both.drop("__group", "__rest", "__v")


def fake_value(kind: str, key: Column, seed: int = 1) -> Column:
    """A made-up value of a kind of personal data, fixed by the key."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10**9)).cast("string")
    d = F.lpad(h, 9, "0")
    return {
        "email": F.concat(F.lit("user"), h, F.lit("@example.com")),
        "phone": F.concat(F.lit("+1-555-"), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 4)),
        "ssn": F.concat(F.lit("900-"), F.substring(d, 1, 2), F.lit("-"), F.substring(d, 3, 4)),
        "name": F.concat(F.lit("Person "), h),
        "ip": F.concat(F.lit("10."), F.pmod(F.xxhash64(F.lit(1), key), F.lit(256)).cast("string"), F.lit("."), F.pmod(F.xxhash64(F.lit(2), key), F.lit(256)).cast("string"), F.lit(".1")),
    }[kind]


def compare_numeric(real: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """Relative gap of means and of deviations, and similarity in percent, for each column."""
    a = real.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    b = made.agg(*[f(c).alias(f"{n}2_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    both = a.crossJoin(b)  # one row each
    cells = []
    for c in columns:
        gap = [F.abs(F.col(f"{n}_{c}") - F.col(f"{n}2_{c}")) / F.greatest(F.abs(f"{n}_{c}"), F.lit(1e-9)) for n in "ms"]
        cells.append(F.struct(F.lit(c).alias("column"), gap[0].alias("mean_gap"), gap[1].alias("deviation_gap"), F.greatest(F.lit(0.0), 100 * (1 - (gap[0] + gap[1]) / 2)).alias("similarity_pct")))
    return both.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def compare_categorical(real: DataFrame, made: DataFrame, column: str) -> DataFrame:
    """Overlap of the two distributions: the sum of the smaller shares."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("value", (F.col("n") / F.col("t")).alias(name))

    both = shares(real, "p").join(shares(made, "q"), "value", "full")
    return both.agg(F.sum(F.least(F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0)))).alias("overlap"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
