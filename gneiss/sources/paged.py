"""Rows of paged web responses: spreadsheet ranges, warehouse query results, REST arrays.

A response is a folder of JSON page files whose names ascend.  Each page names the
next one (``nextPageToken`` or ``pageToken``); the last names none.  Three layouts:

``values``  {"values": [[cell, ...], ...]}; the first row of the first page is the header.
``fields``  {"schema": {"fields": [{"name", "type"}]}, "rows": [{"f": [{"v": text}]}]}.
``records`` any JSON; the rows are the array at a dotted path (the one value there if it is no array).

The source is Spark's own Python data source ``paged``: one partition a page, many
pages a partition where there are more than 256 (or ``pagesPerPartition``), pages read by executors, the driver lists names and opens the
first page for the columns.  As a stream its offset is the name of the last page
taken.  As a sink each task writes its pages under names of its attempt, and the
commit renames them, so that repeated or failed tasks leave nothing behind.

What is there: an empty folder has no rows and, without a schema, no columns to tell,
which is an error; short rows end in nulls, cells beyond the header are dropped; an
empty header cell becomes ``column_k``, a repeated one gets its place as suffix;
a page that is no JSON of its layout fails the read and is named.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from gneiss.sources.readers import coerce_columns, register_source

TOKENS = ("nextPageToken", "pageToken")
#: Types of warehouse fields; all others stay text.
FIELD_TYPES = {
    "INTEGER": T.LongType(),
    "INT64": T.LongType(),
    "FLOAT": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "NUMERIC": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
}
_PARSE = {"bigint": int, "int": int, "double": float, "boolean": lambda v: v == "true", "string": str}
_POSITION = [T.StructField("_page", T.StringType()), T.StructField("_row", T.LongType())]
#: Rows of a record batch.
_BATCH = 10_000
#: Partitions of a read that does not say its pages a partition: starting a task costs more than reading a page.
_PARTITIONS = 256


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def page_names(path: str) -> list[str]:
    where, root = _folder(path)
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(".json") and f.base_name[0] not in "._")


def load_page(path: str, name: str):
    where, root = _folder(path)
    with where.open_input_stream(f"{root}/{name}") as f:
        try:
            return json.loads(f.read())
        except ValueError as error:
            raise ValueError(f"page {name} is not JSON: {error}") from None


def header(cells: list) -> list[str]:
    names = [str(c) if c not in (None, "") else f"column_{k}" for k, c in enumerate(cells)]
    seen: set[str] = set()
    for k, name in enumerate(names):
        if name.lower() in seen:
            names[k] = f"{name}_{k}"
        seen.add(names[k].lower())
    return names


def rows_at(page, dotted: str) -> list:
    """The array at a path of a page, one value there as a list of one, nothing as none."""
    for part in filter(None, dotted.split(".")):
        page = page.get(part) if isinstance(page, dict) else None
    return page if isinstance(page, list) else [] if page is None else [page]


def token_of(page) -> str | None:
    return next((page[t] for t in TOKENS if page.get(t)), None) if isinstance(page, dict) else None


@dataclass
class Pages(InputPartition):
    names: list[str]
    first: str | None


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.path, self.layout, self.rows_path = options["path"], options.get("layout", "records"), options.get("rows", "")
        self.positions = options.get("positions", "false").lower() == "true"
        self.each = int(options.get("pagesPerPartition", "0"))
        self.schema = schema

    def split(self, names: list[str], first: str | None) -> list[Pages]:
        each = self.each if self.each > 0 else -(-len(names) // _PARTITIONS) or 1
        return [Pages(names[k : k + each], first) for k in range(0, len(names), each)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        for name in partition.names:
            rows = self._rows(load_page(self.path, name), name, name == partition.first)
            for at in range(0, len(rows), _BATCH):
                some = rows[at : at + _BATCH]
                if self.positions:
                    some = [[*r, name, at + k] for k, r in enumerate(some)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def _rows(self, page, name: str, first: bool) -> list[list]:
        own = self.schema.fields[: len(self.schema.fields) - len(_POSITION) * self.positions]
        try:
            if self.layout == "records":
                return [[json.dumps(r, ensure_ascii=False)] for r in rows_at(page, self.rows_path)]
            if self.layout == "links":
                return [[name, token_of(page)]]
            rows = page.get("values", [])[1 if first else 0 :] if self.layout == "values" else [[c["v"] for c in r["f"]] for r in page.get("rows", [])]
            parse = [_PARSE[f.dataType.simpleString()] for f in own]
            return [[None if k >= len(r) or r[k] is None else p(r[k]) for k, p in enumerate(parse)] for r in rows]
        except (AttributeError, KeyError, TypeError, ValueError) as error:
            raise ValueError(f"page {name} does not fit the layout {self.layout}: {error!r}") from None


class PagedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Pages]:
        names = page_names(self.path)
        return self.split(names, names[0] if names else None)


class PagedStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        super().__init__(options, schema)
        self.most = int(options.get("pagesPerTrigger", "0"))
        self.triggers = int(options.get("mostTriggers", "0"))
        self.told = ""

    def initialOffset(self) -> dict:
        return {"page": ""}

    def latestOffset(self) -> dict:
        names = page_names(self.path)
        ahead = [n for n in names if n > self.told]
        most = max(self.most, -(-len(names) // self.triggers)) if self.triggers else self.most  # of all pages, as a share of those ahead would shrink
        ahead = ahead[:most] if self.most else ahead
        self.told = ahead[-1] if ahead else self.told
        return {"page": self.told}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        names = page_names(self.path)
        self.told = max(self.told, end["page"])  # after a restart the offsets come from the checkpoint
        return self.split([n for n in names if start["page"] < n <= end["page"]], names[0] if names else None)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    attempt: int
    pages: int


class PagedWriter(DataSourceArrowWriter):
    """Page names are ``page-<run>-<task>-<number>``, so each page can name the next before that is written.

    Every task writes a page at least, and an empty page after the last task ends the
    chain; the commit renames and never reads what was written.
    """

    def __init__(self, options: Mapping[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.layout, self.rows_path = options["path"], options.get("layout", "records"), options.get("rows", "")
        self.each = max(1, int(options.get("rowsPerPage", "1000")))
        self.schema, self.overwrite = schema, overwrite
        old = page_names(self.path)
        self.old_end = None if overwrite or not old else old[-1]
        if self.old_end and self.layout == "values":
            raise ValueError("a sheet has one header: write it with mode overwrite")
        self.run = 1 + int(self.old_end.split("-")[1]) if self.old_end else 0

    def page(self, task: int, number: int = 0) -> str:
        return f"page-{self.run:05d}-{task:06d}-{number:06d}.json"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        where, root = _folder(self.path)
        where.create_dir(f"{root}/_attempts")
        number = 0

        def put(rows: list[dict], following: str) -> None:
            body = self._body(rows) | {TOKENS[0]: following}
            if task == number == 0 and self.layout == "values":
                body["values"].insert(0, list(self.schema.names))
            with where.open_output_stream(f"{root}/_attempts/{task}-{attempt}-{number}") as f:
                f.write(json.dumps(body, ensure_ascii=False).encode())

        held: list[dict] = []
        for batch in iterator:
            for row in batch.to_pylist():
                if len(held) == self.each:
                    put(held, self.page(task, number + 1))
                    held, number = [], number + 1
                held.append(row)
        put(held, self.page(task + 1))
        return Written(task, attempt, number + 1)

    def _body(self, rows: list[dict]) -> dict:
        names = self.schema.names
        if self.layout == "values":
            return {"values": [[_text(r[c]) for c in names] for r in rows]}
        if self.layout == "fields":
            kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "FLOAT64", "boolean": "BOOLEAN"}
            fields = [{"name": f.name, "type": kinds.get(f.dataType.simpleString(), "STRING")} for f in self.schema.fields]
            return {"schema": {"fields": fields}, "rows": [{"f": [{"v": _text(r[c])} for c in names]} for r in rows]}
        made = [{c: v if isinstance(v, (bool, int, float, str, list, dict, type(None))) else _text(v) for c, v in r.items()} for r in rows]
        for part in reversed(list(filter(None, self.rows_path.split("."))) or ["rows"]):
            made = {part: made}
        return made

    def commit(self, messages: list[Written | None]) -> None:
        where, root = _folder(self.path)
        for name in page_names(self.path) if self.overwrite else []:
            where.delete_file(f"{root}/{name}")
        told = [m for m in messages if m]
        for m in told:
            for number in range(m.pages):
                where.move(f"{root}/_attempts/{m.partition}-{m.attempt}-{number}", f"{root}/{self.page(m.partition, number)}")
        self._end(self.page(1 + max((m.partition for m in told), default=-1)), None)
        if self.old_end:
            self._end(self.old_end, self.page(0))
        self.abort(messages)

    def _end(self, name: str, following: str | None) -> None:
        where, root = _folder(self.path)
        with where.open_output_stream(f"{root}/{name}") as f:
            f.write(json.dumps(self._body([]) | ({TOKENS[0]: following} if following else {})).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, root = _folder(self.path)
        where.delete_dir_contents(f"{root}/_attempts", missing_dir_ok=True)


def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> T.StructType:
        layout = self.options.get("layout", "records")
        if layout == "links":
            return T.StructType([T.StructField(c, T.StringType()) for c in ("page", "next")])
        if layout == "records":
            own = [T.StructField("row", T.StringType())]
        else:
            names = page_names(self.options["path"])
            if not names:
                raise ValueError("no page tells the columns: give a schema")
            page = load_page(self.options["path"], names[0])
            if layout == "values":
                own = [T.StructField(c, T.StringType()) for c in header((page.get("values") or [[]])[0])]
            else:
                own = [T.StructField(f["name"], FIELD_TYPES.get(f["type"], T.StringType())) for f in page["schema"]["fields"]]
        return T.StructType(own + _POSITION * (self.options.get("positions", "false").lower() == "true"))

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> PagedStreamReader:
        return PagedStreamReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PagedWriter:
        return PagedWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """The source to Spark, and its layouts to the router of readers."""
    spark.dataSource.register(PagedSource)
    for kind, reader in (("sheet", read_sheet), ("warehouse", read_warehouse), ("rest", read_rest)):
        register_source(kind, reader)


def read_pages(spark: SparkSession, path: str, layout: str = "records", schema: str | None = None, **options: str) -> DataFrame:
    """The rows of a response as its layout gives them; ``records`` are JSON texts in the column row."""
    register(spark)
    reader = spark.read.format("paged").options(path=path, layout=layout, **options)
    return (reader.schema(schema) if schema else reader).load()


def stream_pages(spark: SparkSession, path: str, layout: str = "records", schema: str | None = None, **options: str) -> DataFrame:
    """The same as an unbounded table, of at most ``pagesPerTrigger`` pages a batch.

    With ``mostTriggers``, batches grow beyond that where a backlog would take more
    batches than so many: each batch costs seconds of its own, however few rows it has.
    """
    register(spark)
    reader = spark.readStream.format("paged").options(path=path, layout=layout, **options)
    return (reader.schema(schema) if schema else reader).load()


def write_pages(df: DataFrame, path: str, layout: str = "records", mode: str = "overwrite", **options: str) -> None:
    """df as page files; what JSON and the layouts do not know becomes text."""
    register(df.sparkSession)
    df.write.format("paged").mode(mode).options(path=path, layout=layout, **options).save()


def missing_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, next): links to pages that are not there; a response without any is whole."""
    links = read_pages(spark, path, "links", positions="false")
    there = links.select(F.col("page").alias("next"))
    return links.where("next is not null").join(there, "next", "left_anti").select("page", "next")


def read_sheet(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A spreadsheet range; columns whose cells are all whole numbers or decimals become such."""
    made = [c.name for c in _POSITION] if options.get("positions") == "true" else []
    return coerce_columns(read_pages(spark, path, "values", **options), ("bigint", "double"), made)


def read_warehouse(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A query result with the types of its fields."""
    return read_pages(spark, path, "fields", **options)


def read_rest(spark: SparkSession, path: str, rows: str = "", schema: str | None = None, **options: str) -> DataFrame:
    """The objects of a REST response; without a schema all rows decide the types, as fields that fit none stay variants."""
    texts = read_pages(spark, path, "records", rows=rows, **options)
    kept = [c for c in texts.columns if c != "row"]
    if schema is None:
        found = texts.agg(F.schema_of_variant_agg(F.parse_json("row")).alias("s")).first().s
        schema = struct_ddl(found or "OBJECT<>")
    return texts.select(F.from_json("row", schema, {"mode": "FAILFAST"}).alias("r"), *kept).select("r.*", *kept)


def struct_ddl(variant: str) -> str:
    """The DDL of the type that was told of variants: objects become structs, decimals doubles, nothing but nulls text."""
    out = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", variant)
    out = re.sub(r"\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", out))
    return out if out.startswith("STRUCT<") else f"STRUCT<value: {out}>"
