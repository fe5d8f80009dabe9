"""Messages to a callback with acknowledgement: each batch of a stream counts once, however often it is delivered.

A batch goes through three steps: the callback makes rows of it, the rows replace
whatever an earlier try of that batch has written, and a mark acknowledges it.  A batch
that has its mark is skipped, one without is done again from the first step, and
``delivered`` shows only rows of batches with a mark.  So a replay changes nothing, and
neither does a crash between any two steps.  An error of the callback stops the query
with the batch unacknowledged; starting it again with the same folder tries that batch anew.

Messages that come twice are dropped by their id as long as the second one is not
later than the watermark allows; what is later than the watermark itself is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Callback = Callable[[DataFrame, int], DataFrame]


def once(df: DataFrame, ids: list[str], time: str, late: str) -> DataFrame:
    """Each message id once within the watermark; in a batch, the earliest row of each id."""
    if df.isStreaming:
        return df.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)
    return df.dropDuplicates(ids)


def acknowledge(spark: SparkSession, folder: str, batch_id: int, rows: int) -> None:
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")


def is_acknowledged(spark: SparkSession, folder: str, batch_id: int) -> bool:
    try:
        return spark.read.schema("rows long").parquet(f"{folder}/marks/batch={batch_id}").count() > 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def handle(batch: DataFrame, batch_id: int, callback: Callback, folder: str) -> None:
    """One batch through all steps, or none if it has its mark."""
    spark = batch.sparkSession
    if is_acknowledged(spark, folder, batch_id):
        return
    made = callback(batch, batch_id)
    path = f"{folder}/rows/batch={batch_id}"
    made.write.mode("overwrite").parquet(path)
    acknowledge(spark, folder, batch_id, spark.read.schema(made.schema).parquet(path).count())


_SHUFFLE = "spark.sql.shuffle.partitions"


def subscribe(stream: DataFrame, callback: Callback, folder: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Starts delivery into a folder; flow is controlled by the source (files or pages a trigger).

    State has a partition a core, as each of them costs every batch a task (and a worker
    of its own where state is kept in Python), or fewer if the session shuffles to fewer.
    """
    spark = stream.sparkSession
    usual = spark.conf.get(_SHUFFLE)
    writer = stream.writeStream.foreachBatch(lambda batch, n: handle(batch, n, callback, folder))
    writer = writer.outputMode(mode).option("checkpointLocation", f"{folder}/offsets")
    spark.conf.set(_SHUFFLE, str(min(int(usual), max(1, spark.sparkContext.defaultParallelism))))
    try:
        return (writer.trigger(**trigger) if trigger else writer).start()  # the query keeps the settings it starts with
    finally:
        spark.conf.set(_SHUFFLE, usual)


def pull(stream: DataFrame, callback: Callback, folder: str, mode: str = "append", timeout: float | None = None) -> bool:
    """Delivers what is there, then stops; with a timeout in seconds it runs so long and tells whether the query ended by itself."""
    query = subscribe(stream, callback, folder, mode)
    try:
        if timeout is not None:
            return bool(query.awaitTermination(timeout))
        query.processAllAvailable()
        return False
    finally:
        query.stop()


def delivered(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all acknowledged batches, with the batch they came in."""
    marks = spark.read.schema("rows long, batch long").parquet(f"{folder}/marks").select("batch")
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/rows")
    return rows.join(marks, "batch", "left_semi")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row that was delivered last, without the batch."""
    kept = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("row"))
    return newest.select(*keys, "row.*")
