"""Data-quality dimensions, domain and role rules over a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered

# Value classes, weights of the dimensions, and name rules.
CLASSES = {
    "integer": r"^-?\d+$",
    "float": r"^-?\d+\.\d+$",
    "boolean": r"(?i)^(true|false|yes|no)$",
    "date": r"^\d{4}-\d{2}-\d{2}",
    "email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$",
    "url": r"^https?://",
}
WEIGHTS = {"completeness": 0.25, "consistency": 0.20, "accuracy": 0.20, "uniqueness": 0.15, "validity": 0.15, "timeliness": 0.05}
DOMAINS = {
    "finance/sales": "revenue sales price amount cost profit",
    "healthcare": "patient diagnosis admission treatment",
    "web/analytics": "session page click visitor bounce",
    "iot/sensors": "sensor device temperature reading",
}


def value_class(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    out = F.when(col.isNull() | (text == ""), None)
    for name, pattern in CLASSES.items():
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("text")


def _pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def consistency(df: DataFrame, columns: list[str]) -> DataFrame:
    """The commonest class of each column's values (ties: first by name) and its share in percent."""
    counts = _pairs(df, columns).select("column", value_class(F.col("value")).alias("class")).where("class is not null").groupBy("column", "class").agg(F.count("*").alias("n"))
    out = counts.groupBy("column").agg(F.min_by("class", F.struct(-F.col("n"), "class")).alias("dominant"), (F.max("n") * 100 / F.sum("n")).alias("pct"))
    return out.select("column", "dominant", F.round("pct", 4).alias("pct"))


def accuracy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values beyond three quartile distances, and the score 100 - 500 x share (at least 0)."""
    out = []
    for c in columns:
        v = stats.number(F.col(c))
        q = ordered.quantiles(df, [], c, {"q1": 0.25, "q3": 0.75}).select("q1", "q3")
        wide = 3 * (F.col("q3") - F.col("q1"))
        row = df.select(v.alias("v")).crossJoin(F.broadcast(q)).agg(F.count_if((F.col("v") < F.col("q1") - wide) | (F.col("v") > F.col("q3") + wide)).alias("extreme"), F.count("v").alias("n"))
        out.append(row.select(F.lit(c).alias("column"), "extreme", F.greatest(F.lit(0.0), 100 - 500 * F.col("extreme") / F.col("n")).alias("score")))
    done = out[0]
    for more in out[1:]:
        done = done.union(more)
    return done


def timeliness(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """Days from the newest value to as_of and the score 100 - 0.5 x days (at least 0)."""
    days = F.date_diff(F.lit(as_of).cast("date"), F.max(F.col(column).cast("date")))
    return df.agg(days.alias("days")).select("days", F.greatest(F.lit(0.0), 100 - 0.5 * F.col("days")).alias("score"))


def overall(scores: DataFrame) -> DataFrame:
    """Weighted mean of (dimension, score) with its grade, at 95, 85, 75, 60 and 45."""
    weight = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("dimension"))
    out = scores.agg((F.sum(weight * F.col("score")) / F.sum(weight)).alias("score"))
    s = F.col("score")
    return out.withColumn("grade", F.when(s >= 95, "A+").when(s >= 85, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 45, "D").otherwise("F"))


def detect_domain(columns: list[str]) -> str:
    """The first domain one of whose words occurs in a column name, else general."""
    names = " ".join(columns).lower()
    return next((d for d, words in DOMAINS.items() if any(w in names for w in words.split())), "general")


def suggest_roles(profile: DataFrame) -> DataFrame:
    """identifier, timestamp, grouping or feature for (column, type, is_key, is_low)."""
    role = F.when(F.col("is_key"), "identifier").when(F.col("type") == "datetime", "timestamp").when(F.col("is_low") | (F.col("type") == "categorical"), "grouping").otherwise("feature")
    return profile.select("column", role.alias("role"))


def find_columns(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c.lower())]


def cleaning_plan(missing: DataFrame) -> DataFrame:
    """Action for each column of missing_values: drop_column above 50 %, impute above 10 %, drop_rows above 0."""
    action = F.when(F.col("missing_pct") > 50, "drop_column").when(F.col("missing_pct") > 10, "impute").when(F.col("missing_pct") > 0, "drop_rows").otherwise("keep")
    return missing.select("column", "missing_pct", action.alias("action"))
