"""Residuals, links between columns, ranked causes, deviations from a running mean, fitness of a table for analysis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import clean, timeseries
from gneiss.operators.regress import correlation_matrix, ols
from gneiss.session import cut


def residualise(df: DataFrame, value: str, covariate: str | list[str], out: str = "residual") -> DataFrame:
    """What is left of a value after its least-squares fit on one or more covariates; slope 0 where a covariate does not vary.

    Rows that miss a value have no residual.
    """
    if not isinstance(covariate, str):
        fit = {r.term: r.coefficient for r in ols(df, value, covariate).collect()}
        line = sum((F.lit(fit[c]) * F.col(c).cast("double") for c in covariate), F.lit(fit["intercept"]))
        return df.withColumn(out, F.col(value).cast("double") - line)
    y, x = F.col(value).cast("double"), F.col(covariate).cast("double")
    whole = y.isNotNull() & x.isNotNull()
    fit = df.where(whole).agg(F.avg(y).alias("__my"), F.avg(x).alias("__mx"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("__slope"))
    return df.crossJoin(F.broadcast(fit)).withColumn(out, y - F.col("__my") - F.col("__slope") * (x - F.col("__mx"))).drop("__my", "__mx", "__slope")


def skeleton(df: DataFrame, columns: list[str], least: float = 0.3) -> DataFrame:
    """(a, b, r): undirected links of columns whose correlation is at least this strong."""
    return correlation_matrix(df, columns).where(F.abs("r") >= least).select("a", "b", "r")


def partial_links(df: DataFrame, keys: list[str], target: str, causes: list[str]) -> DataFrame:
    """(keys, cause, r, partial): correlation of each cause with the target, plain and given all other causes, over complete rows.

    One aggregate gathers the correlations of all pairs; what follows is an inverse
    of one small matrix a key.  A column that does not vary is linked with nothing.
    """
    columns = [target, *causes]
    whole = df.dropna("any", subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    found = whole.groupBy(*keys).agg(*[F.coalesce(stats.correlation(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")), F.lit(0.0)).alias(f"__r{n}") for n, (i, j) in enumerate(pairs)])

    @F.pandas_udf("array<double>")
    def given_the_others(rows: pd.Series) -> pd.Series:
        told = []
        for row in rows:
            m = np.eye(len(columns))
            for r, (i, j) in zip(row, pairs):
                m[i, j] = m[j, i] = r
            inverse = np.linalg.pinv(m)
            told.append([float(-inverse[0, k] / np.sqrt(max(inverse[0, 0] * inverse[k, k], 1e-300))) for k in range(1, len(columns))])
        return pd.Series(told)

    row = found.withColumn("__p", given_the_others(F.array(*[f"__r{n}" for n in range(len(pairs))])))
    plain = [f"__r{n}" for n, (i, j) in enumerate(pairs) if j == 0]
    cells = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(r).alias("r"), F.col("__p")[k].alias("partial")) for k, (c, r) in enumerate(zip(causes, plain))])
    return row.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")


def rank_causes(found: DataFrame, partial: str, f: str, by: list[str]) -> DataFrame:
    """Adds score (0.6 of the partial correlation, 0.4 of F up to 20 as a share) and its rank within the columns by."""
    score = 0.6 * F.abs(F.col(partial)) + 0.4 * F.least(F.col(f) / 20, F.lit(1.0))
    scored = found.withColumn("score", score)
    return scored.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(F.col("score").desc())))


def mean_deviations(df: DataFrame, series: list[str], order: str, value: str, weight: float = 0.3, threshold: float = 3.0) -> DataFrame:
    """Values, from the second on, that lie beyond so many population deviations of the series from its running mean."""
    smooth = timeseries.ewma(df, series, order, value, weight)
    spread = df.groupBy(*series).agg(F.stddev_pop(value).alias("spread"), F.min(order).alias("__first"))
    rows = smooth.join(spread, series).where(F.col(order) > F.col("__first")).where("spread > 0")
    return rows.withColumn("score", F.abs(F.col(value) - F.col("ewma")) / F.col("spread")).where(F.col("score") > threshold).drop("__first")


def readiness(df: DataFrame) -> DataFrame:
    """(rows, missing_share, duplicate_share, readiness): 100 less the penalties of what stands in the way of analysis."""
    n = len(df.columns)
    missing = sum((F.sum(stats.is_missing(F.col(c)).cast("long")) for c in df.columns), F.lit(0))
    rows = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(missing, F.lit(0)).alias("missing"))
    kinds = df.groupBy(*df.columns).agg(F.lit(1).alias("one")).agg(F.count("one").alias("kinds"))
    both = rows.crossJoin(F.broadcast(kinds))
    share = F.coalesce(F.try_divide(F.col("missing"), F.col("rows") * n), F.lit(0.0))
    copies = F.coalesce(F.try_divide(F.col("rows") - F.col("kinds"), F.col("rows")), F.lit(0.0))
    # fixed values: penalties for missing cells, copies, few rows, few columns
    lost: Column = F.when(share > 0.05, 20).otherwise(0) + F.when(copies > 0.05, 10).otherwise(0) + F.when(F.col("rows") < 30, 30).otherwise(0) + F.lit(40 if n < 2 else 0)
    return both.select("rows", share.alias("missing_share"), copies.alias("duplicate_share"), F.greatest(F.lit(0), 100 - lost).alias("readiness"))


def prepare(df: DataFrame, key: list[str], order: list[str], numeric: list[str], fill: str = "mean", transforms: dict[str, str] | None = None) -> DataFrame:
    """Duplicates of the key go, missing numbers are filled, then columns are transformed by log1p, sqrt, standard or minmax."""
    out = clean.impute(cut(clean.deduplicate(df, key, order)), numeric, fill)
    plain = {"log1p": lambda c: F.when(F.col(c) > -1, F.log1p(c)), "sqrt": lambda c: F.when(F.col(c) >= 0, F.sqrt(c))}
    by: dict[str, list[str]] = {}
    for c, how in (transforms or {}).items():
        by.setdefault(how, []).append(c)
    for how, columns in by.items():  # each step reads a table that is written, and measures all its columns at once
        out = out.withColumns({c: plain[how](c) for c in columns}) if how in plain else clean.scale(cut(out), columns, how)
    return out


def tail(df: DataFrame, order: list[str], rows: int = 100) -> DataFrame:
    """The last rows in an order, first to last."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(rows).orderBy(*order)


def holdout_fit(df: DataFrame, y: str, x: str, held: Column) -> DataFrame:
    """(n, r2, mae, baseline_mae, chosen) on the rows held out: a line fitted on the others against their mean."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), held.alias("held")).where("y is not null and x is not null")
    fit = rows.where("not held").agg(F.avg("y").alias("m"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    told = rows.where("held").crossJoin(F.broadcast(fit)).withColumn("p", F.col("a") + F.col("b") * F.col("x"))
    rest = F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
    out = told.agg(F.count("y").alias("n"), (1 - F.try_divide(rest, F.var_pop("y") * F.count("y"))).alias("r2"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("m"))).alias("baseline_mae"))
    return out.withColumn("chosen", F.when(F.col("mae") < F.col("baseline_mae"), "line").otherwise("mean"))


def alert_rules(df: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """(series, change, last_z, recent, low, high, drop, spike, outlier, shift): the rules on the end of each series.

    change is that of the last step, recent that of the last three values against
    the three before; low and high are two population deviations from the mean.
    """
    w = Window.partitionBy(*series).orderBy(F.desc(order))
    rows = df.where(F.col(value).isNotNull()).select(*series, F.col(value).cast("double").alias("__v"), F.row_number().over(w).alias("__k"))

    def mean_of(first: int, last: int) -> Column:
        return F.avg(F.when(F.col("__k").between(first, last), F.col("__v")))

    s = rows.groupBy(*series).agg(mean_of(1, 1).alias("v1"), mean_of(2, 2).alias("v2"), mean_of(1, 3).alias("late"), mean_of(4, 6).alias("early"), F.avg("__v").alias("m"), F.stddev_pop("__v").alias("sd"))
    change, recent = (F.try_divide(F.col(a) - F.col(b), F.abs(b)) for a, b in (("v1", "v2"), ("late", "early")))
    z = F.coalesce(F.try_divide(F.abs(F.col("v1") - F.col("m")), F.col("sd")), F.lit(0.0))
    # fixed values: the limits of the four rules
    rules = {"drop": change < -0.15, "spike": change > 0.25, "outlier": z > 2.5, "shift": F.abs(recent) > 0.2}
    return s.select(*series, change.alias("change"), z.alias("last_z"), recent.alias("recent"), (F.col("m") - 2 * F.col("sd")).alias("low"), (F.col("m") + 2 * F.col("sd")).alias("high"), *[F.coalesce(r, F.lit(False)).alias(n) for n, r in rules.items()])


def blend(forecasts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of forecasts; those that are null leave their weight to the others."""
    total = sum((F.when(c.isNotNull(), F.lit(weights[n])).otherwise(0.0) for n, c in forecasts.items()), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(c * weights[n], F.lit(0.0)) for n, c in forecasts.items()), F.lit(0.0)), total)
