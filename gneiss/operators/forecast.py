"""Forecasts with searched parameters, snapped seasons, bands and dates, and what they say about anomalies to come.

A series is one key of ``series``.  The parameter search fits all parameter sets of a
series at once: they are a dimension of one recursion over its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions import stats
from gneiss.operators import causes, ordered, timeseries

# fixed values: smoothing parameters that are tried, seasons that lags snap to, weights of the ensemble, band factors
ALPHAS = (0.1, 0.2, 0.3, 0.5, 0.7)
BETAS = (0.01, 0.05, 0.1, 0.2)
GAMMAS = (0.01, 0.05, 0.1, 0.2)
SEASONS = (4, 7, 12, 24, 52)
WEIGHTS = {"holt_winters": 0.5, "linear": 0.3, "drifted": 0.2}
BANDS = {"80": 1.282, "95": 1.960}


def parameter_grid(alphas: Sequence[float] = ALPHAS, betas: Sequence[float] = BETAS, gammas: Sequence[float] = GAMMAS) -> np.ndarray:
    return np.array(list(product(alphas, betas, gammas)))


def fit_all(y: np.ndarray, period: int, grid: np.ndarray, warm: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(squared errors, level, trend, seasons) of additive Holt-Winters for every row of the grid at once.

    The recursion begins after the first season.  Level and trend before it are zero,
    as the contract has it, or those of the first season where ``warm``.  Below two
    seasons the season is a third of the series, two at least.  The seasons returned
    are those of the last values, in their order.
    """
    n = len(y)
    s = period if n >= 2 * period else max(2, n // 3)
    alpha, beta, gamma = grid.T
    first = y[:s].mean()
    level = np.full(len(grid), first if warm else 0.0)
    trend = np.full(len(grid), (y[s : 2 * s].mean() - first) / s if warm else 0.0)
    seasons = np.empty((n, len(grid)))
    seasons[:s] = (y[:s] - first if abs(first) > 1e-9 else np.zeros(s))[:, None]
    errors = np.zeros(len(grid))
    for t in range(s, n):
        old = seasons[t - s]
        errors += (y[t] - (level + trend + old)) ** 2
        now = alpha * (y[t] - old) + (1 - alpha) * (level + trend)
        trend = beta * (now - level) + (1 - beta) * trend
        level = now
        seasons[t] = gamma * (y[t] - level) + (1 - gamma) * old
    return errors, level, trend, seasons


def holt_winters_search(
    df: DataFrame, series: list[str], order: str, value: str, period: int | str = 12, horizon: int = 6, grid: np.ndarray | None = None, warm: bool = False, clip: bool = True
) -> DataFrame:
    """(series, step, forecast, alpha, beta, gamma, sse, period) by the parameters of the least squared error.

    Of equal errors the first parameters count.  ``period`` is a number or a column.
    Forecasts are not below zero unless ``clip`` is off; a series of fewer than two
    seasons of two values has none.
    """
    grid = parameter_grid() if grid is None else grid
    at = F.lit(period) if isinstance(period, int) else F.col(period)
    rows = df.select(*series, F.col(order).alias("__t"), F.col(value).cast("double").alias("__y"), at.cast("int").alias("__p")).where("__y is not null")
    made = T.StructType.fromDDL("step int, forecast double, alpha double, beta double, gamma double, sse double, period int").fields
    schema = T.StructType([*[rows.schema[c] for c in series], *made])

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("__t")
        y, p = table.column("__y").to_numpy(), max(2, table.column("__p")[0].as_py() or 2)
        steps = np.arange(1, horizon + 1) if len(y) >= 4 else np.arange(0)
        columns = [pa.array([table.column(c)[0].as_py()] * len(steps), table.schema.field(c).type) for c in series]
        told = [np.empty(0)] * 7
        if len(steps):
            errors, level, trend, seasons = fit_all(y, p, grid, warm)
            best = int(errors.argmin())
            ahead = level[best] + steps * trend[best] + seasons[(len(y) - p + (steps - 1) % p) % len(y), best]
            told = [steps, np.maximum(ahead, 0.0) if clip else ahead, *(np.full(horizon, v) for v in (*grid[best], errors[best])), np.full(horizon, p)]
        columns += [pa.array(c, k) for c, k in zip(told, (pa.int32(), *[pa.float64()] * 5, pa.int32()))]
        return pa.Table.from_arrays(columns, names=[*series, *[f.name for f in made]])

    return rows.groupBy(*series).applyInArrow(search, schema)


def snapped_period(df: DataFrame, series: list[str], order: str, value: str, most: int = 52, seasons: Sequence[int] = SEASONS, short: int = 4) -> DataFrame:
    """(series, lag, period): the lag of the highest autocorrelation from 2 to a third of the series, and the usual season at most one away.

    The products of a lag are averaged over their number.  Series of fewer than 16
    values, or without variance, have the ``short`` season; of equal lags the
    smallest counts, of two seasons near it the first.
    """
    w = Window.partitionBy(*series)
    rows = df.where(F.col(value).isNotNull()).select(*series, F.col(order).alias("__t"), (F.col(value).cast("double") - F.avg(value).over(w)).alias("__d"))
    back = rows.select(*series, "__d", *[F.lag("__d", k).over(w.orderBy("__t")).alias(f"__d{k}") for k in range(2, most + 1)])
    sums = back.groupBy(*series).agg(F.count("*").alias("__n"), F.sum(F.col("__d") * F.col("__d")).alias("__c0"), *[F.sum(F.col("__d") * F.col(f"__d{k}")).alias(f"__c{k}") for k in range(2, most + 1)])
    listed = F.array(*[F.struct((F.col(f"__c{k}") / (F.col("__n") - k)).alias("acf"), F.lit(-k).alias("lag")) for k in range(2, most + 1)])
    fit = F.filter(listed, lambda x: -x["lag"] <= F.floor(F.col("__n") / 3))
    lag = F.when((F.col("__n") >= 16) & (F.col("__c0") > 0), -F.array_max(fit)["lag"])
    near = F.coalesce(*[F.when(F.abs(F.col("lag") - s) <= 1, F.lit(s)) for s in seasons], F.col("lag"), F.lit(short))
    return sums.select(*series, lag.alias("lag")).select(*series, "lag", near.alias("period"))


def line_and_seasons(df: DataFrame, series: list[str], order: str, value: str, period: int, horizon: int) -> DataFrame:
    return timeseries.linear_seasonal_forecast(df, series, order, value, period, horizon)


def mean_and_drift(df: DataFrame, series: list[str], order: str, value: str, horizon: int) -> DataFrame:
    """(series, step, drifted, base_error): the mean of the last quarter (3 to 12 values) with the average step added.

    base_error is the mean of how far the last steps, 12 at most, lie from the average step.
    """
    w = Window.partitionBy(*series)
    rows = df.where(F.col(value).isNotNull()).select(*series, F.col(order).alias("__t"), F.col(value).cast("double").alias("__y"))
    rows = rows.withColumns({"__k": F.row_number().over(w.orderBy(F.desc("__t"))), "__n": F.count("*").over(w), "__before": F.lag("__y").over(w.orderBy("__t"))})
    window = F.least(F.greatest(F.floor(F.col("__n") / 4), F.lit(3)), F.lit(12))
    ends = rows.groupBy(*series, "__n").agg(F.avg(F.when(F.col("__k") <= window, F.col("__y"))).alias("__mean"), F.max_by("__y", "__t").alias("__last"), F.min_by("__y", "__t").alias("__first"))
    ends = ends.withColumn("__drift", (F.col("__last") - F.col("__first")) / F.greatest(F.col("__n") - 1, F.lit(1)))
    steps = ordered.match(rows.where("__before is not null and __k <= 12").drop("__n"), ends.select(*series, "__drift"), series)
    errors = steps.groupBy(*series).agg(F.avg(F.abs(F.col("__y") - F.col("__before") - F.col("__drift"))).alias("base_error"))
    both = ordered.match(ends, errors, series, "left")
    out = both.select(*series, "__mean", "__drift", "base_error", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return out.select(*series, "step", (F.col("__mean") + F.col("__drift") * F.col("step")).alias("drifted"), F.coalesce("base_error", F.lit(0.0)).alias("base_error"))


def ensemble_forecast(df: DataFrame, series: list[str], order: str, value: str, period: int = 12, horizon: int = 6, weights: dict[str, float] | None = None) -> DataFrame:
    """(series, step, holt_winters, linear, drifted, forecast, lower_80, upper_80, lower_95, upper_95): three models, their weighted mean and its bands."""
    hw = holt_winters_search(df, series, order, value, period, horizon).select(*series, "step", F.col("forecast").alias("holt_winters"))
    line = line_and_seasons(df, series, order, value, period, horizon).select(*series, "step", F.col("forecast").alias("linear"))
    drift = mean_and_drift(df, series, order, value, horizon)
    both = ordered.match(ordered.match(drift, line, [*series, "step"]), hw, [*series, "step"], "left")
    models = weights or WEIGHTS
    mixed = both.withColumn("forecast", causes.blend({m: F.col(m) for m in models}, models))
    return mixed.select(*series, "step", *models, "forecast", *prediction_bands(F.col("forecast"), F.col("base_error"), F.col("step")))


def prediction_bands(forecast: Column, base_error: Column, step: Column, bands: dict[str, float] | None = None) -> list[Column]:
    """Lower and upper ends of each band, which widen with the square root of the step."""
    out = []
    for name, factor in (bands or BANDS).items():
        wide = F.lit(factor) * base_error * F.sqrt(step)
        out += [(forecast - wide).alias(f"lower_{name}"), (forecast + wide).alias(f"upper_{name}")]
    return out


def dated_forecast(df: DataFrame, series: list[str], time: str, value: str, period: int = 12, least: int = 6, most: int = 24, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.3) -> DataFrame:
    """(series, step, at, forecast, lower, upper, rising) of half as many steps as values, ``least`` to ``most``, at the distance of the first two.

    Holt-Winters from two seasons on, smoothing alone below; fewer than three values
    have no forecast.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    w = Window.partitionBy(*series).orderBy(time)
    ends = rows.select(*series, F.col(time).cast("timestamp").alias("__at"), F.row_number().over(w).alias("__k")).groupBy(*series)
    first, second = (F.max(F.when(F.col("__k") == k, F.unix_micros("__at"))) for k in (1, 2))
    ends = ends.agg(F.count("*").alias("__n"), F.max("__at").alias("__last"), (second - first).alias("__gap")).where("__n >= 3")
    steps = F.least(F.greatest(F.floor(F.col("__n") / 2), F.lit(least)), F.lit(most))
    told = timeseries.holt_winters(rows, series, time, value, period, most, alpha, beta, gamma, variant="plain")
    joined = ordered.match(told, ends, series).where(F.col("step") <= steps)
    at = F.timestamp_micros(F.unix_micros("__last") + F.col("step") * F.col("__gap"))
    out = joined.select(*series, "step", at.alias("at"), "forecast", "lower", "upper", steps.alias("__steps"))
    whole = Window.partitionBy(*series)
    rising = F.max(F.when(F.col("step") == F.col("__steps"), F.col("forecast"))).over(whole) > F.max(F.when(F.col("step") == 1, F.col("forecast"))).over(whole)
    return out.withColumn("rising", rising).drop("__steps")


def anomalies_ahead(history: DataFrame, forecast: DataFrame, series: list[str], order: str, value: str, jump: float = 0.3) -> DataFrame:
    """(series, step, outside, excludes, jumps, severity): steps of a forecast (step, forecast, lower, upper) that would be anomalies.

    outside: beyond the quartiles of the history by 1.5 of their distance (high, low);
    excludes: the whole interval lies a deviation or more from the mean (high, low);
    jumps: the forecast moves by more than ``jump`` of the step before.  Two reasons or
    more are critical.  Histories of fewer than five values tell nothing.
    """
    known = history.where(F.col(value).isNotNull())
    spread = known.groupBy(*series).agg(F.count("*").alias("__n"), F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd")).where("__n >= 5")
    quartiles = ordered.quantiles(known, series, value, {"__q1": 0.25, "__q3": 0.75}).select(*series, "__q1", "__q3")
    envelope = ordered.match(spread, quartiles, series)
    w = Window.partitionBy(*series).orderBy("step")
    steps = ordered.match(forecast.withColumn("__before", F.lag("forecast").over(w)), envelope, series)
    wide = 1.5 * (F.col("__q3") - F.col("__q1"))
    outside = F.when(F.col("forecast") > F.col("__q3") + wide, "high").when(F.col("forecast") < F.col("__q1") - wide, "low")
    excludes = F.when(F.col("lower") > F.col("__mean") + F.col("__sd"), "high").when(F.col("upper") < F.col("__mean") - F.col("__sd"), "low")
    moved = F.abs(F.col("forecast") - F.col("__before")) / F.greatest(F.abs("__before"), F.lit(0.001))
    told = steps.select(*series, "step", outside.alias("outside"), excludes.alias("excludes"), F.coalesce(moved > jump, F.lit(False)).alias("jumps"))
    reasons = F.col("outside").isNotNull().cast("int") + F.col("excludes").isNotNull().cast("int") + F.col("jumps").cast("int")
    return told.withColumn("severity", F.when(reasons >= 2, "critical").when(reasons == 1, "warning")).where("severity is not null")


def beyond_anomalies(anomalies: DataFrame, forecast: DataFrame, series: list[str], value: str) -> DataFrame:
    """Steps of a forecast whose interval lies beyond all anomalous values of the history; a series without such values has none."""
    ends = anomalies.groupBy(*series).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    return ordered.match(forecast, ends, series).where("lower > __high or upper < __low").drop("__low", "__high")


def anomaly_trend(history: DataFrame, ahead: DataFrame, forecast: DataFrame, series: list[str], value: str, threshold: float = 2.5) -> DataFrame:
    """(series, past_rate, ahead_rate, trend): shares of anomalies in the history (by z) and in the forecast."""
    spread = history.groupBy(*series).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"), F.count(value).alias("__n"))
    z = F.abs(F.col(value) - F.col("__m")) / F.col("__s")
    past = ordered.match(history, spread, series).groupBy(*series).agg((F.count_if((F.col("__s") > 0) & (z > threshold)) / F.max("__n")).alias("past_rate"))
    steps = forecast.groupBy(*series).agg(F.count("*").alias("__steps"))
    found = ahead.groupBy(*series).agg(F.count("*").alias("__found"))
    both = ordered.match(ordered.match(past, steps, series), found, series, "left")
    rate = F.coalesce("__found", F.lit(0)) / F.col("__steps")
    trend = F.when(rate > F.col("past_rate") * 1.5, "increasing").when(rate < F.col("past_rate") * 0.5, "decreasing").otherwise("stable")
    return both.select(*series, "past_rate", rate.alias("ahead_rate"), trend.alias("trend"))


def merged_anomalies(df: DataFrame, series: list[str], order: str, value: str, most: int | None = 100, z_limit: float = 3.0, mean_limit: float = 3.0) -> DataFrame:
    """(series, order, value, z_flag, iqr_flag, ewma_flag, score, severity): three detectors merged by row, the ``most`` highest scores.

    A z-score beyond z_limit counts as a third of itself, the quartile rule and the
    deviation from the running mean count one each; 2 is critical, 1 a warning.  Series
    of fewer than four values are left out; ties of scores go by series and order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*series, order, F.col(value).cast("double").alias(value))
    spread = rows.groupBy(*series).agg(F.count("*").alias("__n"), F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s")).where("__n >= 4")
    quartiles = ordered.quantiles(rows, series, value, {"__q1": 0.25, "__q3": 0.75}).select(*series, "__q1", "__q3")
    smooth = causes.mean_deviations(rows, series, order, value, 0.3, mean_limit).select(*series, order, F.lit(True).alias("ewma_flag"))
    told = ordered.match(ordered.match(ordered.match(rows, spread, series), quartiles, series), smooth, [*series, order], "left")
    z = F.when(F.col("__s") > 0, F.abs(F.col(value) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    wide = 1.5 * (F.col("__q3") - F.col("__q1"))
    outside = (F.col(value) < F.col("__q1") - wide) | (F.col(value) > F.col("__q3") + wide)
    told = told.withColumns({"__z": z, "z_flag": z > z_limit, "iqr_flag": outside, "ewma_flag": F.coalesce("ewma_flag", F.lit(False))})
    score = F.when(F.col("z_flag"), F.col("__z") / 3).otherwise(0.0) + F.col("iqr_flag").cast("int") + F.col("ewma_flag").cast("int")
    told = told.withColumn("score", score).where("score > 0").withColumn("severity", F.when(F.col("score") >= 2, "critical").when(F.col("score") >= 1, "warning").otherwise("info"))
    out = told.select(*series, order, value, "z_flag", "iqr_flag", "ewma_flag", "score", "severity")
    return out if most is None else out.orderBy(F.desc("score"), *series, order).limit(most)


def lagged_drivers(df: DataFrame, series: list[str], order: str, target: str, predictors: list[str]) -> DataFrame:
    """(series, driver, r, lag_r, slope, r2, strength, positive, leads, confidence): what moves with a column, and whether one step earlier.

    Rows need both values; lag_r is the correlation with the driver of the row before.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("driver"), F.col(p).cast("double").alias("__x")) for p in predictors])).alias("__c")
    rows = df.select(*series, F.col(order).alias("__t"), F.col(target).cast("double").alias("__y"), cells).select(*series, "__t", "__y", "__c.*").where("__x is not null and __y is not null")
    rows = rows.withColumn("__before", F.lag("__x").over(Window.partitionBy(*series, "driver").orderBy("__t")))
    found = rows.groupBy(*series, "driver").agg(
        F.coalesce(stats.correlation(F.col("__x"), F.col("__y")), F.lit(0.0)).alias("r"),
        F.coalesce(stats.correlation(F.col("__before"), F.col("__y")), F.lit(0.0)).alias("lag_r"),
        F.coalesce(F.regr_slope("__y", "__x"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_r2("__y", "__x"), F.lit(0.0)).alias("r2"),
    )
    size = F.abs("r")
    # fixed values: limits of strength, weights of confidence
    strength = F.when(size > 0.7, "strong").when(size > 0.4, "moderate").when(size > 0.2, "weak").otherwise("negligible")
    confidence = F.least(F.lit(0.95), 0.4 + size * 0.5 + F.abs(F.col("lag_r") - F.col("r")) * 0.1)
    return found.withColumns({"strength": strength, "positive": F.col("r") > 0, "leads": F.col("lag_r") > F.col("r"), "confidence": confidence})
