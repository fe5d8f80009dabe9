"""The engine's own functions in SQL text: table functions, aggregates and SQL-bodied rules.

``register(spark)`` makes them known to a session:

* ``column_values(TABLE(t))``: (column, value) of every cell of the numeric columns.
* ``profile_parts(TABLE(t))``: moments and extremes of each numeric column, as far as
  one task sees them; ``profile(TABLE(parts) PARTITION BY column)`` merges such parts.
  Tasks send a row a column, so that a table of any size is profiled in one scan.
* ``sessionize(TABLE(t) PARTITION BY key ORDER BY time, time => 'ts', gap => 1800)``:
  the rows of t, whatever its columns, with the number of the session of their key; a
  row more than ``gap`` seconds after the one before begins the next.  State is one time.
* ``series_slope(t, v)``: least-squares slope as an Arrow aggregate.  It gathers a group,
  so it is for groups of bounded size, such as the months of a series.
* ``adjusted_skewness``, ``adjusted_kurtosis``, ``percent_change``, ``grade_of``: SQL bodies,
  which Catalyst inlines.

What is there: null and NaN cells are counted as nulls; a table without a numeric
column has an empty profile; rows without a time belong to session 0 and end none.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from gneiss.operators import ordered

_PARTS = "column string, n long, nulls long, mean double, m2 double, m3 double, m4 double, low double, high double"
_PROFILE = "column string, count long, nulls long, mean double, stdev double, variance double, min double, max double, range double, skewness double, kurtosis double"

BODIES = {
    "percent_change(later DOUBLE, earlier DOUBLE)": ("DOUBLE", "try_divide(later - earlier, abs(earlier))"),
    "grade_of(score DOUBLE)": ("STRING", "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"),
    "adjusted_skewness(n BIGINT, m2 DOUBLE, m3 DOUBLE)": (
        "DOUBLE",
        "CASE WHEN n > 2 AND m2 > 0 THEN n * CAST(n AS DOUBLE) / ((n - 1) * CAST(n - 2 AS DOUBLE)) * (m3 / n) / pow(m2 / n, 1.5) ELSE 0 END",
    ),
    "adjusted_kurtosis(n BIGINT, m2 DOUBLE, m4 DOUBLE)": (
        "DOUBLE",
        """CASE WHEN n > 3 AND m2 > 0 THEN CAST(n AS DOUBLE) * n * (n + 1) / (CAST(n - 1 AS DOUBLE) * (n - 2) * (n - 3)) * (m4 / n) / pow(m2 / n, 2)
        - 3 * CAST(n - 1 AS DOUBLE) * (n - 1) / (CAST(n - 2 AS DOUBLE) * (n - 3)) ELSE 0 END""",
    ),
}


class Moments:
    """Count, mean and central sums of powers 2 to 4 with extremes; two of them add up exactly."""

    __slots__ = ("n", "mean", "m2", "m3", "m4", "low", "high")

    def __init__(self, n=0, mean=0.0, m2=0.0, m3=0.0, m4=0.0, low=np.inf, high=-np.inf):
        self.n, self.mean, self.m2, self.m3, self.m4, self.low, self.high = n, mean, m2, m3, m4, low, high

    @classmethod
    def of(cls, x: np.ndarray) -> "Moments":
        if not len(x):
            return cls()
        d = x - x.mean()
        return cls(len(x), float(x.mean()), *(float((d**k).sum()) for k in (2, 3, 4)), float(x.min()), float(x.max()))

    def add(self, o: "Moments") -> "Moments":
        n = self.n + o.n
        if not n:
            return self
        d = o.mean - self.mean
        p, q = self.n / n, o.n / n
        m2 = self.m2 + o.m2 + d * d * self.n * q
        m3 = self.m3 + o.m3 + d**3 * self.n * q * (p - q) + 3 * d * (p * o.m2 - q * self.m2)
        m4 = self.m4 + o.m4 + d**4 * self.n * q * (p * p - p * q + q * q) + 6 * d * d * (p * p * o.m2 + q * q * self.m2) + 4 * d * (p * o.m3 - q * self.m3)
        return Moments(n, self.mean + d * q, m2, m3, m4, min(self.low, o.low), max(self.high, o.high))


def _numbers(column: pa.Array) -> np.ndarray:
    """The values of a column that are numbers."""
    values = pc.cast(column, pa.float64(), safe=False).drop_null().to_numpy(zero_copy_only=False)
    return values[~np.isnan(values)]


def _is_number(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_decimal(kind)


class ColumnValues:
    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for name, column in zip(batch.schema.names, batch.columns):
            if _is_number(column.type):
                yield pa.table({"column": pa.array([name] * len(column), pa.string()), "value": pc.cast(column, pa.float64(), safe=False)})


class ProfileParts:
    def __init__(self):
        self.found: dict[str, tuple[Moments, int]] = {}

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for name, column in zip(batch.schema.names, batch.columns):
            if _is_number(column.type):
                x = _numbers(column)
                before, nulls = self.found.get(name, (Moments(), 0))
                self.found[name] = before.add(Moments.of(x)), nulls + len(column) - len(x)
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        rows = [(c, m.n, nulls, m.mean, m.m2, m.m3, m.m4, m.low if m.n else None, m.high if m.n else None) for c, (m, nulls) in self.found.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 6]
        yield pa.table({f: pa.array([r[k] for r in rows], kinds[k]) for k, f in enumerate("column n nulls mean m2 m3 m4 low high".split())})


class Profile:
    """Rows of profile_parts of one column to its statistics."""

    def __init__(self):
        self.column, self.all, self.nulls = None, Moments(), 0

    def eval(self, part: Row) -> None:
        self.column, self.nulls = part["column"], self.nulls + part["nulls"]
        if part["n"]:
            self.all = self.all.add(Moments(*(part[f] for f in ("n", "mean", "m2", "m3", "m4", "low", "high"))))

    def terminate(self) -> Iterator[tuple]:
        m, n = self.all, float(self.all.n)
        if self.column is None:
            return
        variance = m.m2 / (n - 1) if n > 1 else 0.0
        skewness = n * n / ((n - 1) * (n - 2)) * (m.m3 / n) / (m.m2 / n) ** 1.5 if n > 2 and m.m2 > 0 else 0.0
        raw = (m.m4 / n) / (m.m2 / n) ** 2 if n > 3 and m.m2 > 0 else 0.0
        kurtosis = n * n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * raw - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)) if n > 3 and m.m2 > 0 else 0.0
        ends = (m.low, m.high, m.high - m.low) if m.n else (None, None, None)
        yield (self.column, m.n, self.nulls, m.mean, variance**0.5, variance, *ends, skewness, kurtosis)


class Sessionize:
    @staticmethod
    def analyze(table: AnalyzeArgument, time: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or time.value not in table.dataType.names:
            raise ValueError("sessionize takes a table and the name of one of its columns")
        if "session" in table.dataType.names:
            raise ValueError("the table already has a column session")
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField("session", T.LongType())]))

    def __init__(self):
        self.last, self.session = None, 0

    def eval(self, row: Row, time: str, gap) -> Iterator[tuple]:
        now = row[time]
        if now is not None:
            if self.last is not None and (now - self.last).total_seconds() > gap:
                self.session += 1
            self.last = now
        yield (*row, self.session if now is not None else 0)


def series_slope(t: pa.Array, v: pa.Array) -> float:
    x, y = (pc.cast(a, pa.float64(), safe=False).to_numpy(zero_copy_only=False) for a in (t, v))
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    d = x - x.mean() if len(x) else x
    return float((d * y).sum() / (d * d).sum()) if len(x) > 1 and (d * d).sum() > 0 else None


series_slope = F.arrow_udf(series_slope, T.DoubleType())  # its type hints make it an aggregate


def register(spark: SparkSession) -> None:
    """All functions of this module for the SQL of a session; doing it again changes nothing."""
    spark.udtf.register("column_values", F.arrow_udtf(ColumnValues, returnType="column string, value double"))
    spark.udtf.register("profile_parts", F.arrow_udtf(ProfileParts, returnType=_PARTS))
    spark.udtf.register("profile", F.udtf(Profile, returnType=_PROFILE))
    spark.udtf.register("sessionize", F.udtf(Sessionize))
    spark.udf.register("series_slope", series_slope)
    for head, (kind, body) in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")


def profile_table(spark: SparkSession, table: str) -> DataFrame:
    """The numeric profile of a table or view through these functions; quantiles are those of running counts."""
    register(spark)
    moments = spark.sql(f"WITH parts AS (SELECT * FROM profile_parts(TABLE({table}))) SELECT * FROM profile(TABLE(parts) PARTITION BY column)")
    values = spark.sql(f"SELECT * FROM column_values(TABLE({table}))")
    spread = ordered.quantiles(values, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    both = moments.join(spread, "column", "left").fillna(0, ["distinct"])
    return both.select("column", "count", "nulls", "distinct", "mean", "median", "stdev", "variance", "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis")
