"""Cleaning, encoding and feature engineering; every operator returns a new DataFrame."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import ordered
from gneiss.session import cut


def _stats_row(df: DataFrame, **aggregates: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))  # the right side has one row


def impute(df: DataFrame, columns: list[str], how: str = "median", constant=None) -> DataFrame:
    """Missing values by median, mean, mode (ties: the smallest value) or a constant."""
    if how == "constant":
        return df.fillna(constant, columns)
    if how == "mode":
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
        counts = pairs.where("v is not null and v <> ''").groupBy("c", "v").agg(F.count("*").alias("n"))
        best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v"))
        row = best.groupBy().agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"__{c}") for c in columns])
    else:
        found = _quantile_row(df, columns, {"__m": 0.5}) if how == "median" else df.agg(*[F.avg(stats.number(F.col(c))).alias(f"__m{k}") for k, c in enumerate(columns)])
        row = found.select(*[F.col(f"__m{k}").alias(f"__{c}") for k, c in enumerate(columns)])
    joined = df.crossJoin(F.broadcast(row))
    return joined.withColumns({c: F.when(stats.is_missing(F.col(c)), F.col(f"__{c}").try_cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns}).drop(*[f"__{c}" for c in columns])


def drop_missing(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    flags = [stats.is_missing(F.col(c)) for c in (columns or df.columns)]
    return df.where(~reduce((lambda a, b: a | b) if how == "any" else (lambda a, b: a & b), flags))


def scale(df: DataFrame, columns: list[str], how: str = "standard") -> DataFrame:
    """Adds ``<column>_scaled``: standard (population deviation), minmax, robust (median and quartiles) or log.

    One aggregate measures all columns.
    """
    bounds, new = {}, {}
    if how == "robust":
        rows = df.crossJoin(F.broadcast(_quantile_row(df, columns, {"__m": 0.5, "__a": 0.25, "__b": 0.75})))  # the right side has one row
        for k, c in enumerate(columns):
            v, spread = stats.number(F.col(c)), F.col(f"__b{k}") - F.col(f"__a{k}")
            new[f"{c}_scaled"] = F.when(spread > 0, (v - F.col(f"__m{k}")) / spread).when(v.isNotNull(), 0.0)
        return rows.withColumns(new).drop(*[f"__{x}{k}" for x in "mab" for k in range(len(columns))])
    for k, c in enumerate(columns):
        v, a, b = stats.number(F.col(c)), F.col(f"__a{k}"), F.col(f"__b{k}")
        if how == "standard":
            bounds |= {f"__a{k}": F.avg(v), f"__b{k}": F.stddev_pop(v)}
            value = F.when(b > 0, (v - a) / b).when(v.isNotNull(), 0.0)
        elif how == "minmax":
            bounds |= {f"__a{k}": F.min(v), f"__b{k}": F.max(v)}
            value = F.when(b > a, (v - a) / (b - a)).when(v.isNotNull(), 0.5)
        else:
            bounds |= {f"__a{k}": F.min(v)}
            value = F.log1p(v + F.when(a <= 0, F.abs(a) + 1).otherwise(0))
        new[f"{c}_scaled"] = value
    return _stats_row(df, **bounds).withColumns(new).drop(*bounds)


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", action: str = "cap", threshold: float | None = None) -> DataFrame:
    """Outliers by zscore (3, sample), iqr (1.5) or percentile (1 and 99), removed, capped or set to null.

    One aggregate measures all columns, but for a removal: there columns go in order,
    and the later ones see the rows that are left.
    """
    if action == "remove":
        for c in columns:
            inside, _ = _outlier_rule(c, 0)
            df = cut(_bounded(df, [c], method, threshold).where(inside).drop("__a0", "__b0"))
        return df
    rules = [(c, *_outlier_rule(c, k)) for k, c in enumerate(columns)]
    new = {c: F.when(inside, stats.number(F.col(c))).when(F.lit(action == "cap"), capped) for c, inside, capped in rules}
    return _bounded(df, columns, method, threshold).withColumns(new).drop(*[f"__{x}{k}" for x in "ab" for k in range(len(columns))])


def _quantile_row(df: DataFrame, columns: list[str], shares: dict[str, float]) -> DataFrame:
    """One row with ``<name><number of the column>`` for each share: exact quantiles of all columns by running counts."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), stats.number(F.col(c)).alias("v")) for k, c in enumerate(columns)])
    found = ordered.quantiles(df.select(F.explode(cells).alias("x")).select("x.*"), ["k"], "v", shares)
    return found.agg(*[F.max(F.when(F.col("k") == k, F.col(name))).alias(f"{name}{k}") for name in shares for k in range(len(columns))])


def _bounded(df: DataFrame, columns: list[str], method: str, threshold: float | None) -> DataFrame:
    """df with the ends of what is usual in each column, ``__a<k>`` and ``__b<k>``."""
    if method == "zscore":
        bounds = {}
        for k, c in enumerate(columns):
            v = stats.number(F.col(c))
            wide = (threshold or 3.0) * F.stddev_samp(v)
            bounds |= {f"__a{k}": F.avg(v) - wide, f"__b{k}": F.avg(v) + wide}
        return _stats_row(df, **bounds)
    shares = {"__a": 0.25, "__b": 0.75} if method == "iqr" else {"__a": 0.01, "__b": 0.99}
    row = _quantile_row(df, columns, shares)
    if method == "iqr":
        wide = {k: (threshold or 1.5) * (F.col(f"__b{k}") - F.col(f"__a{k}")) for k in range(len(columns))}
        row = row.select(*[(F.col(f"__a{k}") - w).alias(f"__a{k}") for k, w in wide.items()], *[(F.col(f"__b{k}") + w).alias(f"__b{k}") for k, w in wide.items()])
    return df.crossJoin(F.broadcast(row))  # the right side has one row


def _outlier_rule(column: str, k: int) -> tuple[Column, Column]:
    """(whether a value is inside its bounds, the value cut to them)."""
    v, low, high = stats.number(F.col(column)), F.col(f"__a{k}"), F.col(f"__b{k}")
    return F.coalesce(v.between(low, high), F.lit(True)), F.greatest(F.least(v, high), low)


def deduplicate(df: DataFrame, subset: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """keep: first, last, or none (only rows that have no equal)."""
    if keep == "none":
        return df.withColumn("__n", F.count("*").over(Window.partitionBy(*subset))).where("__n = 1").drop("__n")
    keys = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*subset).orderBy(*keys))).where("__k = 1").drop("__k")


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to the given types; what does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def coercion_report(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cells = {c: (F.count(F.col(c).try_cast(t)), F.count_if(~stats.is_missing(F.col(c)) & F.col(c).try_cast(t).isNull())) for c, t in types.items()}
    row = df.agg(*[x.alias(f"{c}__{k}") for c, pair in cells.items() for k, x in zip(("converted", "failed"), pair)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__converted").alias("converted"), F.col(f"{c}__failed").alias("failed")) for c in types])).alias("x")).select("x.*")


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Year, month, day, weekday (Monday 0), quarter, hour, and weekend, month and quarter edge flags."""
    d = F.col(column).cast("date")
    parts = {
        "year": F.year(d), "month": F.month(d), "day": F.day(d), "dayofweek": F.weekday(d), "quarter": F.quarter(d), "hour": F.hour(F.col(column).cast("timestamp")),
        "is_weekend": F.weekday(d) >= 5, "is_month_start": F.day(d) == 1, "is_month_end": F.last_day(d) == d,
        "is_quarter_start": F.trunc(d, "quarter") == d, "is_quarter_end": F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1) == d,
    }
    return df.withColumns({f"{column}_{k}": v for k, v in parts.items()})


def ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """a / b for each pair of columns; null where b is 0."""
    return df.withColumns({f"{a}_per_{b}": F.try_divide(F.col(a).cast("double"), F.col(b)) for a, b in combinations(columns, 2)})


def interactions(df: DataFrame, columns: list[str], squares: bool = False) -> DataFrame:
    """Pairwise products, and squares if asked."""
    new = {f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)}
    return df.withColumns(new | ({f"{c}^2": F.col(c) * F.col(c) for c in columns} if squares else {}))


def bucketize(df: DataFrame, column: str, bins: int = 4, how: str = "uniform", out: str = "bin") -> DataFrame:
    """Right-closed bins of equal width or of equal counts (exact quantiles)."""
    v = stats.number(F.col(column))
    if how == "uniform":
        rows = _stats_row(df, __a=F.min(v), __b=F.max(v))
        place = F.ceil((v - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins) - 1
        return rows.withColumn(out, F.when(F.col("__b") > F.col("__a"), F.greatest(place, F.lit(0))).otherwise(0).cast("int")).drop("__a", "__b")
    rows = _stats_row(df, __a=F.percentile(v, F.array(*[F.lit(k / bins) for k in range(1, bins)])), __b=F.lit(0))
    return rows.withColumn(out, reduce(lambda s, k: s + F.when(v > F.col("__a")[k], 1).otherwise(0), range(bins - 1), F.lit(0))).drop("__a", "__b")


def one_hot(df: DataFrame, column: str, values: list[str], drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each given category; the categories are the caller's, or those of a bounded dimension."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in (values[1:] if drop_first else values)})


def label_encode(df: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """Codes from 0 in order of first appearance."""
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first"))
    codes = ordered.numbered(first, [], ["__first", column], out).select(column, F.col(out).cast("int").alias(out))
    return df.join(codes, column, "left")


def ordinal_encode(df: DataFrame, column: str, order: list[str], out: str) -> DataFrame:
    codes = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return df.withColumn(out, F.element_at(codes, F.col(column)))


def target_encode(df: DataFrame, column: str, target: str, out: str) -> DataFrame:
    """Mean of the target by category: aggregated first, then joined back."""
    return df.join(df.groupBy(column).agg(F.avg(target).alias(out)), column, "left")


def sample_rows(df: DataFrame, rows: int, id_cols: list[str], seed: int = 1) -> DataFrame:
    """A random sample without replacement, the same in every run: the rows whose ids have the smallest digests."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in id_cols])), *id_cols).limit(rows)
