"""Windows, smoothing and forecasts over ordered series.

A series is one key of ``series``; rows of different series are processed in
parallel.  Recursions run once per series over its ordered values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.operators import ordered
from gneiss.session import cut


def _over(series: list[str], order: str):
    return Window.partitionBy(*series).orderBy(order)


def moving_average(df: DataFrame, series: list[str], order: str, value: str, window: int = 7, out: str = "moving_average") -> DataFrame:
    """Trailing mean; frames at the start are shorter."""
    return df.withColumn(out, F.avg(value).over(_over(series, order).rowsBetween(-(window - 1), 0)))


def lags(df: DataFrame, series: list[str], order: str, value: str, steps: list[int]) -> DataFrame:
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(_over(series, order)) for k in steps})


def fill(df: DataFrame, series: list[str], order: str, value: str, how: str = "forward", out: str = "filled") -> DataFrame:
    """forward, backward, or interpolate (linear inside by position, last value after, null before the first)."""
    w = _over(series, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    last, nxt = F.last(value, True).over(before), F.first(value, True).over(after)
    if how == "forward":
        return df.withColumn(out, last)
    if how == "backward":
        return df.withColumn(out, nxt)
    df = df.withColumn("__k", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.col("__k"))
    low, high = F.last(known, True).over(before), F.first(known, True).over(after)
    slope = (nxt - last) / (high - low)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(high.isNull(), last).otherwise(last + slope * (F.col("__k") - low))).drop("__k")


def changes(df: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """Difference and percent change to the row before; null where that is missing or near zero."""
    before = F.lag(value).over(_over(series, order))
    pct = F.when(F.abs(before) > 1e-9, (F.col(value) - before) / F.abs(before) * 100)
    return df.withColumns({"diff": F.col(value) - before, "pct_change": pct})


def ewma(df: DataFrame, series: list[str], order: str, value: str, weight: float = 0.3, out: str = "ewma") -> DataFrame:
    """e0 = x0, then weight * x + (1 - weight) * e, of the rows that have a value.

    A series is folded range by range: each range starts from zero, and what its
    first row would have carried in is added once the ends of the ranges before are
    known, as the recursion is linear.  So a long series is not the work of one task.
    """
    rows = df.select(*series, order, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    dealt = cut(rows.repartitionByRange(*series, order).withColumn("__range", F.spark_partition_id()))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        start = np.concatenate([[0.0], table.column(value).to_numpy()])
        local = pd.Series(start).ewm(alpha=weight, adjust=False).mean().to_numpy()[1:]
        return table.append_column("__local", pa.array(local)).append_column("__k", pa.array(np.arange(1, len(local) + 1)))

    local = cut(dealt.groupBy(*series, "__range").applyInArrow(fold, T.StructType([*dealt.schema.fields, T.StructField("__local", T.DoubleType()), T.StructField("__k", T.LongType())])))
    ends = local.groupBy(*series, "__range").agg(F.max_by("__local", "__k").alias("__end"), F.max("__k").alias("__n"), F.min_by(value, "__k").alias("__first"))

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("__range")
        held, carried = table.column("__first")[0].as_py(), []
        for end, n in zip(table.column("__end").to_pylist(), table.column("__n").to_pylist()):
            carried.append(held)
            held = end + (1 - weight) ** n * held
        return table.drop_columns(["__end", "__n", "__first"]).append_column("__carry", pa.array(carried, pa.float64()))

    into = ends.groupBy(*series).applyInArrow(carry, T.StructType([*[ends.schema[c] for c in (*series, "__range")], T.StructField("__carry", T.DoubleType())]))
    joined = ordered.match(local, into, [*series, "__range"])
    return joined.select(*series, order, value, (F.col("__local") + F.pow(F.lit(1 - weight), F.col("__k")) * F.col("__carry")).alias(out))


def autocorrelation(df: DataFrame, series: list[str], order: str, value: str, most: int | None = 20) -> DataFrame:
    """Lags 0 to ``most``: sum of products of deviations over n times the population variance.

    Without ``most`` the lags of a series of n rows end at n / 2, at 48 at most.  All
    lags come from one sorted window.
    """
    highest = 48 if most is None else most
    w = Window.partitionBy(*series)
    rows = df.select(*series, F.col(order).alias("__t"), (F.col(value) - F.avg(value).over(w)).alias("d"))
    back = rows.select(*series, "d", *[F.lag("d", k).over(_over(series, "__t")).alias(f"d{k}") for k in range(1, highest + 1)]).withColumn("d0", F.col("d"))
    sums = back.groupBy(*series).agg(F.count("*").alias("n"), *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(highest + 1)])
    last = F.lit(highest) if most is not None else F.least(F.lit(highest), F.floor(F.col("n") / 2).cast("int"))
    lags = F.posexplode(F.array(*[f"c{k}" for k in range(highest + 1)])).alias("lag", "c")
    found = sums.select(*series, "n", "c0", last.alias("last"), lags).where("lag <= last and lag < n")
    return found.select(*series, "lag", F.when(F.col("c0") > 0, F.col("c") / F.col("c0")).otherwise(0.0).alias("acf"))


def seasonality(acf: DataFrame, series: list[str], least: float = 0.2, default: int = 12) -> DataFrame:
    """The lag of the highest local peak of the autocorrelation above ``least``, else the default."""
    w = _over(series, "lag")
    peaks = acf.withColumns({"before": F.lag("acf").over(w), "after": F.lead("acf").over(w)})
    top = F.max_by("lag", F.when((F.col("lag") > 0) & (F.col("acf") > least) & (F.col("acf") > F.col("before")) & (F.col("acf") > F.col("after")), F.col("acf")))
    return peaks.groupBy(*series).agg(F.coalesce(top, F.lit(default)).alias("period"))


def unit_root(df: DataFrame, series: list[str], order: str, value: str, critical: float = 2.86) -> DataFrame:
    """Simplified test: slope of the difference on the level over the regression's standard error."""
    w = _over(series, order)
    rows = df.select(*series, (F.col(value) - F.lag(value).over(w)).alias("dy"), F.lag(value).over(w).alias("y")).where("dy is not null and y is not null")
    s = rows.groupBy(*series).agg(F.count("*").alias("n"), F.regr_slope("dy", "y").alias("slope"), F.regr_syy("dy", "y").alias("syy"), F.regr_sxy("dy", "y").alias("sxy"))
    se = F.sqrt(F.greatest((F.col("syy") - F.col("slope") * F.col("sxy")), F.lit(0.0)) / (F.col("n") - 2))
    stat = F.when((se > 0) & (F.col("n") >= 9), F.col("slope") / se).otherwise(0.0)  # ten values have nine differences
    return s.select(*series, stat.alias("statistic"), (F.abs(stat) > critical).alias("stationary"))


def _smooth(y: np.ndarray, alpha: float) -> np.ndarray:
    level, out = y[0], []
    for v in y:
        level = alpha * v + (1 - alpha) * level
        out.append(level)
    return np.array(out)


def _seasonal(y: np.ndarray, period: int, alpha: float, beta: float, gamma: float, updated: bool) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Additive Holt-Winters; the fit uses level and trend before each value, and with ``updated`` the season after it."""
    if updated:
        level, trend = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
    else:
        level, trend = y[0], y[:period].mean() - y[0]
    season = y[:period] - y[:period].mean()
    fitted = np.zeros(len(y))
    for t, v in enumerate(y):
        k, before, slope, old = t % period, level, trend, season[t % period]
        level = alpha * (v - old) + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        season[k] = gamma * (v - level) + (1 - gamma) * old
        fitted[t] = before + slope + (season[k] if updated else old)
    return fitted, level, trend, season


def holt_winters(
    df: DataFrame, series: list[str], order: str, value: str, period: int = 12, horizon: int = 6, alpha: float = 0.2, beta: float = 0.1, gamma: float = 0.3, variant: str = "updated"
) -> DataFrame:
    """(series, step, forecast, lower, upper, rmse) for ``horizon`` steps; smoothing alone below two periods.

    Bounds are forecast +- 1.96 s sqrt(step), where s is the rmse of the fit or, in
    the plain variant, the sample deviation of its residuals.  Smoothing alone is
    fitted after each value in the updated variant and before it in the plain one.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in series)
    schema = f"{fields}{', ' if series else ''}step int, forecast double, lower double, upper double, rmse double"

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].dropna().to_numpy(float)
        steps = np.arange(1, horizon + 1)
        if not len(y):
            return pd.DataFrame({}, columns=[*series, "step", "forecast", "lower", "upper", "rmse"])
        if len(y) < 2 * period:
            smooth = _smooth(y, alpha)
            fitted, ahead = smooth if variant == "updated" else np.concatenate([[y[0]], smooth[:-1]]), np.full(horizon, smooth[-1])
        else:
            fitted, level, trend, season = _seasonal(y, period, alpha, beta, gamma, variant == "updated")
            ahead = level + steps * trend + season[(len(y) + steps - 1) % period]
        rmse = float(np.sqrt(np.mean((y - fitted) ** 2)))
        spread = rmse if variant == "updated" else float(np.std(y - fitted, ddof=1)) if len(y) > 1 else 0.0
        wide = 1.96 * spread * np.sqrt(steps)
        out = pd.DataFrame({"step": steps, "forecast": ahead, "lower": ahead - wide, "upper": ahead + wide, "rmse": rmse})
        for name, part in zip(series, key):
            out.insert(0, name, part)
        return out[[*series, "step", "forecast", "lower", "upper", "rmse"]]

    return df.select(*series, order, value).groupBy(*series).applyInPandas(fit, schema)


def ar1_forecast(df: DataFrame, series: list[str], order: str, value: str, horizon: int = 6) -> DataFrame:
    """AR(1) on first differences by least squares, summed up again: closed form, no recursion over rows."""
    w = _over(series, order)
    d = df.select(*series, F.col(order).alias("__t"), F.col(value).cast("double").alias("y")).withColumn("d", F.col("y") - F.lag("y").over(w_of(series)))
    d = d.withColumn("before", F.lag("d").over(w_of(series)))
    fit = d.groupBy(*series).agg(
        F.coalesce(F.regr_slope("d", "before"), F.lit(0.0)).alias("phi"), F.coalesce(F.regr_intercept("d", "before"), F.lit(0.0)).alias("c"), F.max_by("y", "__t").alias("last"), F.max_by("d", "__t").alias("d0"),
    )
    steps = F.sequence(F.lit(1), F.lit(horizon))
    moves = F.aggregate(steps, F.array(F.coalesce("d0", F.lit(0.0))), lambda seen, _: F.concat(seen, F.array(F.col("c") + F.col("phi") * F.element_at(seen, -1))))
    out = fit.select(*series, "last", F.posexplode(F.slice(moves, 2, horizon)).alias("k", "move"))
    total = F.sum("move").over(Window.partitionBy(*series).orderBy("k"))
    return out.select(*series, (F.col("k") + 1).alias("step"), (F.col("last") + total).alias("forecast"))


def w_of(series: list[str]):
    return Window.partitionBy(*series).orderBy("__t")


def drift_forecast(df: DataFrame, series: list[str], order: str, value: str, window: int = 7, horizon: int = 6) -> DataFrame:
    """Flat mean of the last ``window`` values, and that mean with the average step added."""
    rows = df.withColumn("__k", F.row_number().over(Window.partitionBy(*series).orderBy(F.desc(order))))
    base = rows.groupBy(*series).agg(F.avg(F.when(F.col("__k") <= window, F.col(value))).alias("flat"), ((F.max_by(value, order) - F.min_by(value, order)) / (F.count("*") - 1)).alias("drift"))
    out = base.select(*series, "flat", "drift", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return out.select(*series, "step", "flat", (F.col("flat") + F.coalesce("drift", F.lit(0.0)) * F.col("step")).alias("drifted"))


def linear_seasonal_forecast(df: DataFrame, series: list[str], order: str, value: str, period: int = 12, horizon: int = 6) -> DataFrame:
    """A least-squares line over position plus the mean residual of each phase."""
    t = df.select(*series, (F.row_number().over(_over(series, order)) - 1).alias("t"), F.col(value).cast("double").alias("y"))
    line = t.groupBy(*series).agg(F.regr_slope("y", "t").alias("b"), F.regr_intercept("y", "t").alias("a"), F.count("*").alias("n"))
    joined = t.join(line, series) if series else t.crossJoin(line)  # line has one row
    phase = joined.groupBy(*series, (F.col("t") % period).alias("phase")).agg(F.avg(F.col("y") - F.col("a") - F.col("b") * F.col("t")).alias("s"))
    ahead = line.select(*series, "a", "b", "n", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).withColumn("t", F.col("n") + F.col("step") - 1)
    ahead = ahead.withColumn("phase", F.col("t") % period)
    return ahead.join(phase, [*series, "phase"], "left").select(*series, "step", (F.col("a") + F.col("b") * F.col("t") + F.coalesce("s", F.lit(0.0))).alias("forecast"))


def holdout_errors(df: DataFrame, series: list[str], order: str, value: str, share: float = 0.2, window: int = 7) -> DataFrame:
    """RMSE and MAPE over the last share of each series, of the flat mean before it and of a least-squares line."""
    w = Window.partitionBy(*series)
    rows = df.select(*series, F.col(value).cast("double").alias("y"), F.row_number().over(_over(series, order)).alias("t"), F.count("*").over(w).alias("n"))
    cut = F.floor(F.col("n") * (1 - share))
    train, test = rows.where(F.col("t") <= cut), rows.where(F.col("t") > cut)
    fit = train.groupBy(*series).agg(F.avg(F.when(F.col("t") > cut - window, F.col("y"))).alias("flat"), F.regr_slope("y", "t").alias("b"), F.regr_intercept("y", "t").alias("a"))
    both = test.join(fit, series) if series else test.crossJoin(fit)  # fit has one row
    models = F.array(F.struct(F.lit("flat").alias("model"), F.col("flat").alias("p")), F.struct(F.lit("linear").alias("model"), (F.col("a") + F.col("b") * F.col("t")).alias("p")))
    told = both.select(*series, "y", F.explode(models).alias("m")).select(*series, "y", "m.model", "m.p")
    miss = F.col("y") - F.col("p")
    return told.groupBy(*series, "model").agg(F.sqrt(F.avg(miss * miss)).alias("rmse"), (F.avg(F.abs(miss / F.when(F.col("y") != 0, F.col("y")))) * 100).alias("mape"))


def series_summary(df: DataFrame, series: list[str], order: str, value: str) -> DataFrame:
    """Ends, days, points, extremes, mean, and direction with percent change from first to last."""
    out = df.groupBy(*series).agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(value).alias("points"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"),
    )
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100)
    return out.withColumns({"days": F.date_diff("end", "start"), "change_pct": change, "direction": F.when(F.col("last") > F.col("first"), "up").when(F.col("last") < F.col("first"), "down").otherwise("flat")})
