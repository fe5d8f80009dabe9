"""Event streams: the same transformations serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as an unbounded table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def decode_messages(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON messages as columns; what does not parse keeps its text, base64 encoded, in ``undecoded``."""
    parsed = F.from_json(F.col(value).cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    out = df.withColumn("__m", parsed)
    bad = F.col("__m").isNull() | F.forall(F.array(*[F.col(f"__m.{f.name}").isNull() for f in T.StructType.fromDDL(schema).fields]), lambda x: x)
    return out.select(*df.columns, "__m.*", F.when(bad, F.base64(F.col(value).cast("binary"))).alias("undecoded")).drop("__m")


def windowed_metrics(df: DataFrame, time: str, value: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, sum, mean, minimum and maximum per window and key; late rows beyond the watermark are left out of a stream."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total", "mean", "low", "high")


def sessions(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = df.withWatermark(time, late) if df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def filter_metrics(df: DataFrame, name: str | None = None, tags: dict[str, str] | None = None, start=None, end=None) -> DataFrame:
    """Metric rows (name, value, ts, tags) that fit all conditions; times are inclusive."""
    out = df
    if name is not None:
        out = out.where(F.col("name") == name)
    for k, v in (tags or {}).items():
        out = out.where(F.try_element_at("tags", F.lit(k)) == v)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end))
    return out


def event_metrics(df: DataFrame, key: str, kind: str, time: str, value: str, error: str = "error") -> DataFrame:
    """Per key: events, first and last time, errors, total and mean value."""
    return df.groupBy(key).agg(F.count("*").alias("events"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count_if(F.col(kind) == error).alias("errors"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def run_once(df: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what is there into an in-memory table and stops; the checkpoint marks what was taken."""
    query = df.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def metric_series(df: DataFrame, name: str, tags: str, time: str, value: str) -> DataFrame:
    """(name, tags, points, first, last, low, high): one row per metric and set of tags, whatever the order of the tags.

    The points themselves stay rows of df; a series is summed up, not gathered.
    """
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))
    rows = df.select(F.col(name).alias("name"), key.alias("tags"), F.col(time).alias("t"), F.col(value).alias("v"))
    return rows.groupBy("name", "tags").agg(F.count("v").alias("points"), F.min_by("v", "t").alias("first"), F.max_by("v", "t").alias("last"), F.min("v").alias("low"), F.max("v").alias("high"))


def select_events(df: DataFrame, time: str, equal: dict, start=None, end=None, last: int | None = None) -> DataFrame:
    """Events whose columns have the values asked for, between two times (both included), by time; the last ones if a number is given."""
    for column, wanted in equal.items():
        df = df.where(F.col(column) == wanted)
    df = df if start is None else df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    df = df if end is None else df.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return (df if last is None else df.orderBy(F.col(time).desc()).limit(last)).orderBy(time)
