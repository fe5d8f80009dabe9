"""Anomaly flags and fraud rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered
from gneiss.operators.timeseries import ewma
from gneiss.session import cut


def _with_stats(df: DataFrame, **aggregates) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))  # the right side has one row


def zscore(df: DataFrame, value: str, threshold: float = 3.0, sample: bool = True) -> DataFrame:
    """Rows beyond ``threshold`` deviations, with z."""
    v = stats.number(F.col(value))
    rows = _with_stats(df, __m=F.avg(v), __s=stats.stdev(v, sample)).withColumn("z", F.when(F.col("__s") > 0, (v - F.col("__m")) / F.col("__s")).otherwise(0.0))
    return rows.where(F.abs("z") > threshold).drop("__m", "__s")


def iqr(df: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by ``factor`` times their distance, with the side."""
    v = stats.number(F.col(value))
    q = ordered.quantiles(df, [], value, {"q1": 0.25, "q3": 0.75}).first()
    if q is None:
        return df.withColumn("side", F.lit("low")).where("false")
    wide = factor * (q.q3 - q.q1)
    side = F.when(v < q.q1 - wide, "low").when(v > q.q3 + wide, "high")
    return df.withColumn("side", side).where("side is not null")


def modified_zscore(df: DataFrame, value: str, threshold: float = 3.5) -> DataFrame:
    """Rows whose 0.6745 |x - median| / MAD exceeds the threshold."""
    v = stats.number(F.col(value))
    middle = ordered.quantiles(df, [], value, {"m": 0.5}).first()
    away = F.abs(v - F.lit(middle.m if middle else 0.0))
    mad = ordered.quantiles(df.select(away.alias("__d")), [], "__d", {"m": 0.5}).first()
    score = F.lit(0.6745) * away / mad.m if mad and mad.m > 0 else F.lit(0.0)
    return df.withColumn("modified_z", score).where(F.col("modified_z") > threshold)


def ensemble(df: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """Votes of z-score (population, 3), quartiles (1.5) and EWMA residual (3 deviations of the EWMA); rows with one vote or more."""
    smooth = cut(ewma(df, series, order, value, 0.3))
    spread = smooth.groupBy(*series).agg(F.count(value).alias("__n"), F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd"), F.stddev_samp("ewma").alias("__e"))
    quartiles = ordered.quantiles(smooth, series, value, {"__q1": 0.25, "__q3": 0.75}).select(*series, "__q1", "__q3")
    rows = ordered.match(ordered.match(smooth, spread, series), quartiles, series)
    rows = rows.withColumn("__z", F.when(F.col("__sd") > 0, F.abs(F.col(value) - F.col("__m")) / F.col("__sd")).otherwise(0.0))
    wide = 1.5 * (F.col("__q3") - F.col("__q1"))
    flags = {
        "z_flag": F.col("__z") > 3,
        "iqr_flag": (F.col(value) < F.col("__q1") - wide) | (F.col(value) > F.col("__q3") + wide),
        "ewma_flag": F.abs(F.col(value) - F.col("ewma")) > 3 * F.coalesce("__e", F.lit(0.0)),
    }
    rows = rows.where(F.col("__n") >= 4).withColumns(flags)
    votes = reduce(lambda a, b: a + b, [F.col(f).cast("int") for f in flags])
    rows = rows.withColumn("votes", votes).where("votes > 0")
    level = F.when(F.col("votes") == 3, "critical").when(F.col("votes") == 2, "warning").otherwise("info")
    return rows.select(*series, order, value, *flags, "votes", level.alias("severity"))


def spikes(df: DataFrame, series: list[str], order: str, value: str, threshold_pct: float = 50.0) -> DataFrame:
    """Rows that change by more than the threshold against the row before."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(order))
    pct = F.when(F.abs(before) > 1e-9, (F.col(value) - before) / F.abs(before) * 100)
    return df.withColumn("pct_change", pct).where(F.abs("pct_change") > threshold_pct)


def fraud_rules(df: DataFrame, id_col: str, amount: str, time: str, entity: list[str], gap_ms: int = 60_000) -> DataFrame:
    """Rules high_amount (3 sample deviations), off_hours (before 6 or after 22) and rapid_succession per entity; 30 points each."""
    rows = _with_stats(df.withColumn("__ts", F.col(time).cast("timestamp")), __m=F.avg(amount), __s=F.stddev_samp(amount))
    gap = F.unix_millis("__ts") - F.lag(F.unix_millis("__ts")).over(Window.partitionBy(*entity).orderBy("__ts", id_col))
    rows = rows.withColumn("__gap", gap)
    rules = {
        "high_amount": F.col(amount) > F.col("__m") + 3 * F.col("__s"),
        "off_hours": (F.hour("__ts") < 6) | (F.hour("__ts") > 22),
        "rapid_succession": (F.col("__gap") > 0) & (F.col("__gap") < gap_ms),
    }
    hit = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    out = rows.withColumn("__rules", hit).where(F.size("__rules") > 0)
    return out.select(id_col, F.array_join("__rules", ",").alias("rules"), (F.size("__rules") * 30).alias("risk_score"))


def merge_by_row(found: list[DataFrame], id_col: str) -> DataFrame:
    """One row per id from frames with (id, score, reason): highest score, reasons in order."""
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(id_col).agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
