"""Arrow batches of texts through a Python function, other columns passing unchanged."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, and bytes of a text column, that are held as Python objects at once.
ROWS = 500
BYTES = 4 << 20
#: Rows of an Arrow batch that a session with Spark's default gets: texts may be long.
BATCH_ROWS = 512
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches where the session has Spark's default of 10,000 rows."""
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def free_name(taken: Iterable[str], base: str) -> str:
    """base, with as many underscores before it as make it unlike all names taken, whatever their case."""
    used = {c.lower() for c in taken}
    while base.lower() in used:
        base = "_" + base
    return base


def without(columns: Iterable[str], made: Iterable[str]) -> list[str]:
    """The columns that made does not replace (names are compared without case, as Spark does)."""
    new = {c.lower() for c in made}
    return [c for c in columns if c.lower() not in new]


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ROWS rows and about BYTES of text each; a longer text is a part of its own."""
    column = batch.column(text_col)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    else:
        offsets = range(len(column) + 1)
    at = 0
    while at < batch.num_rows:
        past = at + 1
        while past < batch.num_rows and past - at < ROWS and offsets[past + 1] - offsets[at] <= BYTES:
            past += 1
        yield batch.slice(at, past - at)
        at = past


def map_texts(rows: DataFrame, text_col: str, new: str, make: Callable[[], Callable[[list], list]], keep_text: bool = False) -> DataFrame:
    """rows with the columns of the DDL string ``new``, and without text_col unless keep_text.

    make() runs once per task; the function it returns takes the list of texts of
    some rows (None for null) and returns one list per new column.  A new column
    replaces one of rows with its name.
    """
    bound_batches(rows.sparkSession)
    fields = T.StructType.fromDDL(new).fields
    kept = [c for c in without(rows.columns, [f.name for f in fields]) if keep_text or c != text_col]
    schema = T.StructType([rows.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)
    read = rows.select(*kept, *([] if keep_text else [text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, text_col):
                made = fn(part.column(text_col).to_pylist())
                columns = [part.column(c).cast(arrow.field(c).type) for c in kept]
                columns += [pa.array(v, arrow.field(f.name).type) for v, f in zip(made, fields)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return read.mapInArrow(run, schema)
