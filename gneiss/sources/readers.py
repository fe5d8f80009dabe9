"""Readers of delimited text, JSON and warehouse data, with the engine's token rules."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_TOKENS = ["", "null", "NULL", "NaN"]


def coerce_token(token: Column) -> dict[str, Column]:
    """What a text token can be read as: bigint, double, boolean, else text; null tokens are null in all."""
    text = F.when(~token.isin(*NULL_TOKENS), token)
    whole = F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))
    safe = F.when(F.abs(whole) <= 2**53 - 1, whole)  # larger integers stay text
    return {
        "bigint": safe,
        "double": F.coalesce(F.when(text.rlike(r"^-?\d+\.\d+$"), text.try_cast("double")), safe.cast("double")),
        "boolean": F.when(text.isin("true", "True", "TRUE"), True).when(text.isin("false", "False", "FALSE"), False),
        "string": text,
    }


def coerce_columns(df: DataFrame, kinds: tuple[str, ...] = ("bigint", "double", "boolean"), keep: Iterable[str] = ()) -> DataFrame:
    """Text columns in the narrowest of some types that reads all their tokens, decided in one pass; those to keep stay."""
    found = {c: coerce_token(F.col(f"`{c}`")) for c in df.columns if c not in keep}
    if not found:
        return df
    votes = df.agg(*[F.count(x).alias(f"{n}_{kind}") for n, c in enumerate(found) for kind, x in found[c].items()]).first()
    out = {}
    for n, c in enumerate(found):
        fit = [k for k in kinds if votes[f"{n}_{k}"] == votes[f"{n}_string"] > 0]
        out[c] = found[c][fit[0] if fit else "string"]
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Quoted fields with doubled quotes and newlines inside; short rows are padded, blank rows dropped, headers trimmed."""
    raw = spark.read.csv(path, header=True, sep=separator, multiLine=True, quote='"', escape='"', inferSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return coerce_columns(raw.dropna("all"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A top-level array or object; an array under data, rows, records or results is unwrapped."""
    raw = spark.read.json(path, multiLine=True)
    for key in ("data", "rows", "records", "results"):
        if key in raw.columns and raw.schema[key].dataType.typeName() == "array":
            return raw.select(F.explode(key).alias("row")).select("row.*")
    return raw


def read_jdbc(spark: SparkSession, url: str, query: str, split: tuple[str, object, object, int] | None = None, **options: str) -> DataFrame:
    """Rows of a query of a database, with its types.

    ``split`` is a numeric or date column with the bounds and the number of ranges in
    which tasks read side by side; rows beyond the bounds and those with a null are in
    the first and last range, none is left out.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if split is None:
        return reader.option("query", query).load()
    column, low, high, parts = split
    return reader.options(dbtable=f"({query}) asked", partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=parts).load()


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "csv": read_delimited,
    "tsv": lambda spark, path: read_delimited(spark, path, "\t"),
    "json": read_json,
    "parquet": lambda spark, path: spark.read.parquet(path),
    "orc": lambda spark, path: spark.read.orc(path),
    "jdbc": read_jdbc,
    "table": lambda spark, name: spark.table(name),
}


def register_source(name: str, reader: Callable[..., DataFrame]) -> None:
    SOURCES[name] = reader


def read(spark: SparkSession, target: str, kind: str | None = None, **options) -> DataFrame:
    """Reads by an explicit kind, else by the extension; delimited text by default."""
    kind = kind or target.rsplit(".", 1)[-1].lower()
    return SOURCES.get(kind, read_delimited)(spark, target, **options)


def sql_table(spark: SparkSession, query: str, **params) -> DataFrame:
    """A query with named parameters over the catalog."""
    return spark.sql(query, args=params)


def estimate_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a query that has not run."""
    view = f"gneiss_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        plan = df.sparkSession.sql(f"EXPLAIN COST SELECT * FROM {view}").first().plan
    finally:
        df.sparkSession.catalog.dropTempView(view)
    number, unit = re.search(r"sizeInBytes=([\d.E+]+) (\w+)", plan).groups()
    return int(float(number) * 1024 ** ("B KiB MiB GiB TiB PiB EiB".split().index(unit)))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length")


def json_rows(df: DataFrame, text: str, path: str, schema: str) -> DataFrame:
    """Rows found in JSON texts at a dotted path ("" for the top): the elements of an array, or the one object there."""
    found = F.get_json_object(text, "$." + path) if path else F.col(text)
    listed = F.when(F.ltrim(found).startswith("["), found).when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]")))
    return df.select(F.explode(F.from_json(listed, f"array<struct<{schema}>>")).alias("row")).select("row.*")
