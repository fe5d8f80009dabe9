"""Profiling, schema inference and data quality, each a single pass over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered
from gneiss.session import cut

_NUMERIC = ("int", "bigint", "smallint", "tinyint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in _NUMERIC or kind.startswith("decimal")]


def _stacked(row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row of ``column__field`` aggregates as one row per column."""
    items = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in columns]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def _one_pass(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    found = [fn(c).alias(f"{c}__{name}") for c in columns for name, fn in measures.items()]
    return _stacked(df.agg(*found), columns, list(measures))


def numeric_profile(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Sixteen statistics per numeric column; values that do not parse count as null."""
    columns = columns or numeric_columns(df)

    def of(fn):
        return lambda c: F.round(fn(stats.number(F.col(f"`{c}`"))).cast("double"), digits)

    def whole(fn):
        return lambda c: fn(stats.number(F.col(f"`{c}`"))).cast("bigint")

    measures = {
        "count": whole(F.count), "nulls": whole(lambda x: F.count_if(x.isNull())), "mean": of(stats.mean), "stdev": of(stats.stdev), "variance": of(stats.variance),
        "min": of(F.min), "max": of(F.max), "range": of(lambda x: F.max(x) - F.min(x)), "skewness": of(stats.skewness), "kurtosis": of(stats.kurtosis),
    }
    base = _one_pass(df, columns, measures)
    # distinct counts and quartiles come from the counts of (column, value)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), stats.number(F.col(f"`{c}`")).alias("v")) for c in columns])).alias("x")).select("x.*")
    found = ordered.quantiles(pairs, ["column"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = found.select("column", "distinct", *[F.round(x, digits).alias(n) for n, x in {"median": F.col("median"), "q1": F.col("q1"), "q3": F.col("q3"), "iqr": F.col("q3") - F.col("q1")}.items()])
    names = ["column", "count", "nulls", "distinct", "mean", "median", "stdev", "variance", "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis"]
    return base.join(F.broadcast(spread), "column", "left").select(*names).fillna(0, ["distinct"])  # a row a column


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column with share in percent; ties by value."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = pairs.where("value is not null and value <> ''").groupBy("column", "value").agg(F.count("*").alias("n"))
    # every task keeps k values of a column before the shuffle; the totals have one row a column
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    ranked = ranked.join(totals, "column").withColumn("pct", F.round(F.col("n") * 100 / F.col("total"), 4))
    return ranked.select("column", "value", "n", "pct", "rank")


def column_entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shannon entropy in bits of the non-missing values of each column, with their distinct count."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = pairs.where("value is not null and value <> ''").groupBy("column", "value").agg(F.count("*").alias("n"))
    # sum(-p log p) = log(total) - sum(n log n) / total
    out = counts.groupBy("column").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return out.select("column", "distinct", F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("entropy"))


def missing_values(df: DataFrame, columns: list[str] | None = None, trim: bool = False, critical: float = 50.0) -> DataFrame:
    """Missing count and percent of each column; critical above the given percent."""
    columns = columns or df.columns
    out = _one_pass(df, columns, {"missing": lambda c: F.count_if(stats.is_missing(F.col(f"`{c}`"), trim)), "rows": lambda c: F.count(F.lit(1))})
    pct = F.when(F.col("rows") > 0, F.col("missing") * 100 / F.col("rows")).otherwise(0.0)
    return out.select("column", "missing", F.round(pct, 4).alias("missing_pct"), (pct > critical).alias("critical"))


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values (null counts as one), their ratio to the rows, key and low-cardinality flags."""
    columns = columns or df.columns
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    out = pairs.groupBy("column", "value").agg(F.count("*").alias("n")).groupBy("column").agg(F.count("*").alias("distinct"), F.sum("n").alias("rows"))
    ratio = F.col("distinct") / F.col("rows")
    return out.select("column", "distinct", F.round(ratio, 6).alias("ratio"), (F.col("distinct") == F.col("rows")).alias("is_key"), ((F.col("distinct") < 20) & (ratio < 0.05)).alias("is_low"))


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, groups of equal rows and rows beyond the first of a group, with the rate in percent."""
    groups = df.groupBy(*[f"`{c}`" for c in (columns or df.columns)]).agg(F.count("*").alias("__n"))
    out = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count_if(F.col("__n") > 1).alias("groups"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("rate_pct", F.when(F.col("rows") > 0, F.round(F.col("duplicates") * 100 / F.col("rows"), 4)).otherwise(0.0))


def infer_schema(df: DataFrame, columns: list[str] | None = None, rules: str = "current") -> DataFrame:
    """Semantic type of each column by the share of values that parse.

    ``current``: numeric above 80 %, boolean if all, datetime if all (length 8 or
    more), categorical below 50 % distinct and 50 values, else text.  ``strict``:
    numeric and boolean above 85 %, datetime above 70 % with an ISO date,
    else categorical; ``empty`` without a value.
    """
    columns = columns or df.columns

    def text(c):
        return F.col(f"`{c}`").cast("string")

    def present(c):
        return ~stats.is_missing(F.col(f"`{c}`"))

    iso = r"^\d{4}-\d{2}-\d{2}([ T].*)?$"
    measures = {
        "present": lambda c: F.count_if(present(c)),
        "nulls": lambda c: F.count_if(~present(c)),
        "numbers": lambda c: F.count_if(present(c) & stats.number(text(c)).isNotNull()),
        "bools": lambda c: F.count_if(present(c) & F.lower(text(c)).isin("true", "false", "0", "1", "yes", "no")),
        "strict_bools": lambda c: F.count_if(present(c) & F.lower(text(c)).isin("true", "false")),
        "dates": lambda c: F.count_if(present(c) & text(c).rlike(iso) & text(c).try_cast("timestamp").isNotNull() & (F.length(text(c)) >= 8)),
    }
    base = _one_pass(df, columns, measures)
    unique = cardinality(df.select(*[F.when(present(c), text(c)).alias(c) for c in columns]), columns).select("column", "distinct")
    out = base.join(unique, "column").withColumn("distinct", F.col("distinct") - F.when(F.col("nulls") > 0, 1).otherwise(0))
    n = F.col("present")

    def share(name):
        return F.when(n > 0, F.col(name) / n).otherwise(0.0)

    if rules == "strict":
        kind = F.when(n == 0, "empty").when(share("numbers") > 0.85, "numeric").when(share("strict_bools") > 0.85, "boolean").when(share("dates") > 0.7, "datetime").otherwise("categorical")
    else:
        kind = F.when(share("numbers") > 0.8, "numeric").when(F.col("bools") == n, "boolean").when(F.col("dates") == n, "datetime")
        kind = kind.when((F.col("distinct") / n < 0.5) & (F.col("distinct") < 50), "categorical").otherwise("text")
    return out.select("column", kind.alias("type"), F.col("nulls").alias("null_count"), F.col("distinct").alias("unique_count"))


def quality_score(df: DataFrame) -> DataFrame:
    """Mean of completeness, uniqueness, validity and consistency (the last two constant) with its grade."""
    cells = len(df.columns)
    missing = reduce(lambda a, b: a + b, [F.count_if(stats.is_missing(F.col(f"`{c}`"))) for c in df.columns])
    row = df.agg(F.count("*").alias("rows"), missing.alias("missing")).crossJoin(duplicate_summary(df).select("duplicates"))  # one row each
    completeness = 100 - F.col("missing") * 100 / (F.col("rows") * cells)
    uniqueness = 100 - F.col("duplicates") * 100 / F.col("rows")
    score = F.round((completeness + uniqueness + 200) / 4, 1)
    return row.select("rows", F.round(completeness, 4).alias("completeness"), F.round(uniqueness, 4).alias("uniqueness"), score.alias("score"), stats.grade(score).alias("grade"))


def text_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average, extremes and median of the lengths of non-empty texts."""

    def size(c):
        n = F.length(F.col(f"`{c}`").cast("string"))
        return F.when(n > 0, n)

    measures = {"avg": lambda c: F.round(F.avg(size(c)), 6), "max": lambda c: F.max(size(c)), "min": lambda c: F.min(size(c)), "median": lambda c: F.median(size(c))}
    return _one_pass(df, columns, {k: (lambda c, v=v: v(c).cast("double")) for k, v in measures.items()})


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last closed; one bin if all values are equal."""
    value = stats.number(F.col(f"`{column}`")).alias("v")
    rows = df.select(value).where("v is not null")
    edge = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = rows.crossJoin(F.broadcast(edge)).select(F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int").alias("bin"), "lo", width.alias("w"))
    out = placed.groupBy("bin", "lo", "w").agg(F.count("*").alias("n"))
    return out.select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("high"), "n")


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """Five numbers per group by floor index, without interpolation."""
    counts = cut(ordered.running_counts(df, [group], column))
    places = {name: F.least(F.floor(F.col("size") * p), F.col("size") - 1) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return ordered.at_places(counts, [group], places).select(f"`{group}`", F.col("low").alias("min"), "q1", "median", "q3", F.col("high").alias("max"))


def pivot_matrix(df: DataFrame, row: str, column: str, values: list, value: Column) -> DataFrame:
    """Heat-map cells: one column per given value of ``column``."""
    return df.groupBy(row).pivot(column, values).agg(value)
