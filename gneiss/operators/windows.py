"""Ranking and frame windows, calendar resampling, and measures of ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered
from gneiss.session import cut


def ranks(df: DataFrame, groups: list[str], order: str, tiles: int = 4, nth: int = 2) -> DataFrame:
    """Adds rank, dense_rank, ntile, percent_rank, cume_dist and nth_value of order within the groups.

    Rows are dealt into ranges of (groups, order), where equal values stay together; what
    ranges hold tells the later ones where they begin, so no task sorts a whole group.
    Nulls come first and count as a value; a group shorter than ``nth`` has no nth value.
    """
    parts = [f"`{c}`" for c in groups]
    dealt = cut(df.repartitionByRange(*parts, f"`{order}`").withColumn("__range", F.spark_partition_id()))
    kinds = F.count_distinct(f"`{order}`") + F.max(F.col(f"`{order}`").isNull().cast("int"))
    held = dealt.groupBy(*parts, "__range").agg(F.count(F.lit(1)).alias("__m"), kinds.alias("__d"))
    before, whole = Window.partitionBy(*parts).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parts)
    starts = held.select(*parts, "__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("__m", "__rows"), ("__d", "__kinds"))], F.sum("__m").over(whole).alias("__n"))
    within = Window.partitionBy(*parts, "__range").orderBy(f"`{order}`")
    known = {
        "__k": F.col("__rows") + F.row_number().over(within), "rank": F.col("__rows") + F.rank().over(within), "dense_rank": F.col("__kinds") + F.dense_rank().over(within),
        "__upto": F.col("__rows") + F.count(F.lit(1)).over(within.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
    }
    told = cut(ordered.match(dealt, starts, [*groups, "__range"]).withColumns(known))
    small, more, k = F.floor(F.col("__n") / tiles), F.col("__n") % tiles, F.col("__k")
    ntile = F.when(k <= more * (small + 1), F.ceil(k / (small + 1))).otherwise(more + F.ceil((k - more * (small + 1)) / F.greatest(small, F.lit(1))))
    chosen = told.where(k == nth).select(*parts, F.col(f"`{order}`").alias("nth_value"))
    out = told.withColumns({
        "rank": F.col("rank").cast("int"), "dense_rank": F.col("dense_rank").cast("int"), "ntile": ntile.cast("int"), "percent_rank": F.when(F.col("__n") > 1, (F.col("rank") - 1) / (F.col("__n") - 1)).otherwise(0.0),
        "cume_dist": F.col("__upto") / F.col("__n"),
    })
    joined = ordered.match(out, chosen, groups, "left") if groups else out.join(F.broadcast(chosen), F.lit(True), "left")  # chosen is a row
    return joined.drop("__range", "__rows", "__kinds", "__n", "__k", "__upto")


def range_sum(df: DataFrame, groups: list[str], order: str, value: str, before: float, after: float = 0, out: str = "range_sum") -> DataFrame:
    """Sum over the rows whose order lies from ``before`` below to ``after`` above that of the row."""
    w = Window.partitionBy(*groups).orderBy(order).rangeBetween(-before, after)
    return df.withColumn(out, F.sum(value).over(w))


def daily_rolling(df: DataFrame, series: list[str], time: str, value: str, window: int = 7) -> DataFrame:
    """(series, day, mean, rolling_mean, rolling_std): daily means on a whole calendar; windows with a missing day are null."""
    days = df.groupBy(*series, F.to_date(time).alias("day")).agg(F.avg(value).alias("mean"))
    ends = days.groupBy(*series).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = ends.select(*series, F.explode(F.sequence("a", "b")).alias("day"))
    full = calendar.join(days, [*series, "day"], "left")
    w = Window.partitionBy(*series).orderBy("day").rowsBetween(-(window - 1), 0)
    whole = F.count("mean").over(w) == window
    return full.withColumns({"rolling_mean": F.when(whole, F.avg("mean").over(w)), "rolling_std": F.when(whole, F.stddev_samp("mean").over(w))})


def volatility(df: DataFrame, series: list[str], order: str, value: str, periods: int = 252) -> DataFrame:
    """Root mean square of simple returns, times the root of the periods a year."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(order))
    rows = df.select(*series, F.when(before != 0, (F.col(value) - before) / before).alias("r"))
    return rows.groupBy(*series).agg((F.sqrt(F.avg(F.col("r") * F.col("r"))) * periods**0.5).alias("volatility"))


def trend_direction(df: DataFrame, series: list[str], order: str, value: str, share: float = 0.1) -> DataFrame:
    """up, down or stable: the mean of the second half against that of the first, by more than the share of it."""
    w = Window.partitionBy(*series)
    rows = df.select(*series, F.col(value).alias("v"), F.row_number().over(w.orderBy(order)).alias("k"), F.count("*").over(w).alias("n"))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    halves = rows.groupBy(*series).agg(F.avg(F.when(first, F.col("v"))).alias("early"), F.avg(F.when(~first, F.col("v"))).alias("late"))
    change = (F.col("late") - F.col("early")) / F.abs("early")
    return halves.withColumn("direction", F.when(change > share, "up").when(change < -share, "down").otherwise("stable"))


def regime_changes(df: DataFrame, series: list[str], order: str, value: str, least: float = 0.3) -> DataFrame:
    """Rows that differ from the one before by more than a share of it (of at least 0.001)."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(order))
    step = F.abs(F.col(value) - before) / F.greatest(F.abs(before), F.lit(0.001))
    return df.withColumn("step_share", step).where(F.col("step_share") > least)


def alerts(df: DataFrame, series: list[str], order: str, value: str, least: float = 0.2) -> DataFrame:
    """(series, first, last, change, alert): the last value against the first, an alert beyond the share."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*series).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    change = F.when(F.col("first") != 0, F.col("last") / F.col("first") - 1)
    return ends.withColumn("change", change).withColumn("alert", F.coalesce(F.abs("change") > least, F.lit(False)))


def percentile_band(value: Column, benchmark: dict[int, float]) -> Column:
    """The highest of the benchmark's percentiles whose value is reached; 0 below all."""
    found = F.lit(0)
    for p in sorted(benchmark):
        found = F.when(value >= benchmark[p], p).otherwise(found)
    return found


def column_cards(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type, rows, missing, missing_pct, distinct) of each column, from one pass and the counts of its values.

    type is numeric or boolean if 85 percent of the present values read as such, datetime
    from 70 percent on, empty without any, else categorical.
    """
    texts = {c: F.col(f"`{c}`").cast("string") for c in columns}
    shares, cells = {}, []
    for k, c in enumerate(columns):
        present = F.when(texts[c] != "", texts[c])
        shares |= {
            f"n{k}": F.count(present), f"x{k}": F.count(present.try_cast("double")), f"b{k}": F.count_if(F.lower(present).isin("true", "false", "yes", "no")),
            f"d{k}": F.count_if(present.rlike(r"\d{4}-\d{2}-\d{2}") & F.try_to_timestamp(present).isNotNull()),
        }
        n, numeric, boolean, dated = (F.col(f"{x}{k}") for x in "nxbd")
        # fixed values: the shares from which a type holds
        kind = F.when(n == 0, "empty").when(numeric / n > 0.85, "numeric").when(boolean / n > 0.85, "boolean").when(dated / n > 0.7, "datetime").otherwise("categorical")
        missing = F.col("rows") - n
        cells.append(F.struct(F.lit(c).alias("column"), kind.alias("type"), F.col("rows"), missing.alias("missing"), (missing * 100 / F.col("rows")).alias("missing_pct")))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in shares.items()])
    cards = row.where("rows > 0").select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), t.alias("value")) for c, t in texts.items()])).alias("x")).select("x.*").where("value <> ''").distinct()
    return cards.join(values.groupBy("column").agg(F.count("*").alias("distinct")), "column", "left").fillna(0, ["distinct"])


def group_variance(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F of the means of the groups, from sums of one pass."""
    parts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    total = parts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    f = (between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return total.select("k", "n", f.alias("f"))


def target_column(df: DataFrame, columns: list[str], words: tuple[str, ...] = ("target", "label", "outcome", "price", "sales", "revenue", "churn")) -> DataFrame:
    """(column, reason, deviation): the first column that varies and whose name holds one of the words, else the one of the largest deviation.

    A column of a single value is no target, whatever its name; none is told where nothing varies.
    """
    cells = [F.struct(F.lit(k).alias("k"), F.lit(c).alias("column"), F.coalesce(F.stddev_samp(stats.number(F.col(f"`{c}`"))), F.lit(0.0)).alias("s")) for k, c in enumerate(columns)]
    varied = df.agg(F.filter(F.array(*cells), lambda x: x["s"] > 0).alias("all"))
    named = F.coalesce(*[F.get(F.filter("all", _names(w)), F.lit(0)) for w in words])
    widest = F.array_max(F.transform("all", lambda x: F.struct(x["s"].alias("s"), (-x["k"]).alias("back"), x["column"].alias("column"))))
    chosen = F.when(named.isNotNull(), F.struct(named["column"].alias("column"), F.lit("name").alias("reason"), named["s"].alias("deviation"))).otherwise(
        F.struct(widest["column"].alias("column"), F.lit("deviation").alias("reason"), widest["s"].alias("deviation"))
    )
    return varied.where(F.size("all") > 0).select(chosen.alias("x")).select("x.*")


def _names(word: str):
    return lambda x: F.contains(F.lower(x["column"]), F.lit(word))
