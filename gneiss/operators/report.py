"""Benchmarks, alerts, insights and questions over small profile tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.relational import Query

# Benchmark table (domain, metric, median, top 10 %, top 25 %, bottom 25 %).
BENCHMARKS = [
    ("finance/sales", "conversion_rate_pct", 2.9, 11.0, 5.0, 1.0),
    ("finance/sales", "cart_abandonment_pct", 69.8, 40.0, 55.0, 80.0),
    ("finance/sales", "avg_order_value_usd", 113.0, 250.0, 175.0, 60.0),
    ("finance/sales", "customer_retention_pct", 65.0, 90.0, 78.0, 45.0),
    ("web/analytics", "bounce_rate_pct", 47.0, 25.0, 35.0, 65.0),
    ("web/analytics", "avg_session_duration_sec", 54.0, 180.0, 90.0, 25.0),
    ("web/analytics", "pages_per_session", 2.5, 6.0, 4.0, 1.5),
    ("web/analytics", "signup_conversion_pct", 1.5, 5.0, 3.0, 0.5),
    ("healthcare", "appointment_no_show_pct", 18.0, 5.0, 10.0, 30.0),
    ("healthcare", "patient_satisfaction_score", 7.5, 9.5, 8.5, 6.0),
    ("healthcare", "readmission_rate_pct", 14.0, 8.0, 11.0, 20.0),
    ("iot/sensors", "device_uptime_pct", 97.0, 99.9, 99.0, 92.0),
    ("iot/sensors", "anomaly_rate_per_day", 5.0, 1.0, 2.0, 15.0),
    ("general", "data_quality_score", 75.0, 95.0, 88.0, 55.0),
    ("general", "missing_data_pct", 5.0, 0.5, 2.0, 15.0),
    ("general", "duplicate_record_pct", 3.0, 0.1, 1.0, 10.0),
]


def benchmark_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BENCHMARKS, "domain string, metric string, median double, top10 double, top25 double, bottom25 double")


def percentile_rank(value: Column) -> Column:
    """95, 50 to 95, 25 to 50 or 0 to 25, linear between the benchmark's points (higher is better)."""
    low, mid, high = F.col("bottom25"), F.col("median"), F.col("top10")
    rank = F.when(value >= high, 95.0).when(value >= mid, 50 + (value - mid) / (high - mid) * 45).when(value >= low, 25 + (value - low) / (mid - low) * 25)
    return rank.otherwise(F.greatest(F.lit(0.0), value / low * 25))


def compare_benchmarks(metrics: DataFrame, domain: str) -> DataFrame:
    """metrics has (metric, value); adds the percentile rank and its quartile."""
    rows = metrics.join(F.broadcast(benchmark_table(metrics.sparkSession).where(F.col("domain") == domain)), "metric")
    rows = rows.withColumn("percentile", F.round(percentile_rank(F.col("value")), 4))
    status = F.when(F.col("percentile") > 75, "top_quartile").when(F.col("percentile") > 50, "above_median").when(F.col("percentile") > 25, "below_median").otherwise("bottom_quartile")
    return rows.select("metric", "value", "median", "percentile", status.alias("status"))


def value_share(df: DataFrame, column: str, k: int = 10, unknown: str = "Unknown") -> DataFrame:
    """The k most frequent values with their percent of all rows; missing counts as ``unknown``."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))
    out = counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("pct"))
    return out.orderBy(F.desc("n"), "value").limit(k)


def monthly_averages(df: DataFrame, time: str, value: str, band_pct: float = 15.0) -> DataFrame:
    """Mean and count by calendar month, flagged where the mean is off the overall mean by more than the band."""
    overall = df.agg(F.avg(value).alias("__m"))
    months = df.groupBy(F.month(time).alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).crossJoin(F.broadcast(overall))
    return months.select("month", F.round("mean", 4).alias("mean"), "n", (F.abs(F.col("mean") - F.col("__m")) > F.abs("__m") * band_pct / 100).alias("seasonal"))


def latest_change(df: DataFrame, order: str, value: str) -> DataFrame:
    """Last against previous value, and the mean of the last three against the three before, in percent."""
    last = df.orderBy(F.desc(order)).limit(6).select(order, F.col(value).cast("double").alias("v"))
    a = last.agg(F.reverse(F.array_sort(F.collect_list(F.struct(order, "v")))).alias("s"))
    v = F.col("s").getField("v")
    three, before = (v[0] + v[1] + v[2]) / 3, (v[3] + v[4] + v[5]) / 3
    return a.select(F.round((v[0] - v[1]) / F.abs(v[1]) * 100, 4).alias("change_pct"), F.round((three - before) / F.abs(before) * 100, 4).alias("trend_pct"))


_INTENTS = [
    ("count", r"\b(how many|count|number of)\b"), ("avg", r"\b(average|mean|avg)\b"), ("sum", r"\b(total|sum)\b"),
    ("max", r"\b(max|maximum|highest|largest|top)\b"), ("min", r"\b(min|minimum|lowest|smallest|bottom)\b"),
]


def ask(df: DataFrame, question: str) -> DataFrame:
    """Answers a question of the form <aggregate> <column> [by <column>] with the fluent query.

    The first column named in the question is the measure, else the first numeric
    one; what follows ``by``, ``per`` or ``across`` groups.
    """
    text = question.lower()
    kind = next((k for k, p in _INTENTS if re.search(p, text)), "count")
    named = sorted((c for c in df.columns if c.lower() in text), key=lambda c: text.index(c.lower()))
    group = re.search(r"\b(?:by|per|across)\s+(\w+)", text)
    by = next((c for c in df.columns if group and c.lower() == group[1]), None)
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    measure = next((c for c in named if c != by and c in numeric), numeric[0] if numeric else "*")
    query = Query(df).aggregate(kind, "*" if kind == "count" else measure, "answer")
    if by:
        query = query.group_by(by)
    return query.to_df()


# What a question about stored results asks for, in the order in which the patterns are tried.
RESULT_INTENTS = [
    ("overview", r"what.*overview|summar|describe|explain"),
    ("findings", r"key finding|finding"),
    ("recommendations", r"recommend|suggest|next step|what should"),
    ("quality", r"quality|clean|missing|duplicate"),
    ("anomalies", r"anomal|outlier|unusual"),
    ("forecast", r"forecast|predict|future|trend"),
    ("causes", r"causal|cause|driver|affect|impact"),
    ("size", r"how many|count|size|rows"),
]


def result_intent(question: str) -> str | None:
    """The first kind of result whose pattern a question fits."""
    return next((kind for kind, pattern in RESULT_INTENTS if re.search(pattern, question.lower())), None)


def ask_results(results: dict[str, tuple[DataFrame, list[Column], int | None]], question: str) -> DataFrame:
    """Answers a question from stored results: by kind a table, its order and how many rows of it to tell.

    A question that fits no kind, or one of which there is no result, is answered
    by the kinds that can be asked for, (kind, columns).
    """
    found = results.get(result_intent(question) or "")
    if found is None:
        spark = next(iter(results.values()))[0].sparkSession if results else SparkSession.getActiveSession()
        return spark.createDataFrame([(k, ",".join(df.columns)) for k, (df, _, _) in results.items()], "kind string, columns string")
    table, order, rows = found
    table = table.orderBy(*order) if order else table
    return table if rows is None else table.limit(rows)


def insights(profile: DataFrame, missing: DataFrame, correlations: DataFrame) -> DataFrame:
    """(kind, subject, detail, impact) from a numeric profile, missing values and correlations, by fixed rules."""
    skewed = profile.where(F.abs("skewness") > 2).select(F.lit("skewed").alias("kind"), F.col("column").alias("subject"), F.round("skewness", 4).alias("detail"), F.lit("medium").alias("impact"))
    constant = profile.where("distinct = 1").select(F.lit("constant"), "column", F.lit(1.0), F.lit("low"))
    gaps = missing.where("missing_pct > 10").select(F.lit("missing"), "column", "missing_pct", F.when(F.col("missing_pct") > 50, "high").otherwise("medium"))
    strong = correlations.where("abs(r) > 0.7").select(F.lit("correlated"), F.concat_ws("~", "a", "b"), "r", F.lit("high"))
    return skewed.union(constant).union(gaps).union(strong)
