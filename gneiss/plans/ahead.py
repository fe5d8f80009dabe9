"""Queries of searched forecasts, seasons, bands, anomalies to come and lagged drivers, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import forecast
from gneiss.plans.catalog import query
from gneiss.plans.reference import _EWMA, _MONTHLY, _monthly
from gneiss.session import read_table

_S = ["o_orderstatus"]


def _values(numbers) -> str:
    return ", ".join(f"({v})" for v in numbers)


#: Level and trend start at zero and the recursion after the first season (period 12), for every parameter set.
_SEARCH = f"""g AS (SELECT a, b, c FROM (VALUES {_values(forecast.ALPHAS)}) x(a), (VALUES {_values(forecast.BETAS)}) y(b), (VALUES {_values(forecast.GAMMAS)}) z(c)),
y AS (SELECT o_orderstatus, list(total ORDER BY month) AS y FROM {_MONTHLY} GROUP BY 1),
r(o_orderstatus, y, a, b, c, t, level, trend, seasons, sse) AS (
  SELECT o_orderstatus, y, a::DOUBLE, b::DOUBLE, c::DOUBLE, 12, 0::DOUBLE, 0::DOUBLE, list_transform(y[1:12], lambda x: x - list_avg(y[1:12])), 0::DOUBLE FROM y, g
  UNION ALL
  SELECT o_orderstatus, y, a, b, c, t + 1, nl, b * (nl - level) + (1 - b) * trend, list_concat(seasons[2:12], [c * (v - nl) + (1 - c) * s]), sse + (v - level - trend - s) * (v - level - trend - s)
  FROM (SELECT *, y[t + 1] AS v, seasons[1] AS s, a * (y[t + 1] - seasons[1]) + (1 - a) * (level + trend) AS nl FROM r WHERE t < len(y))
), fits AS (SELECT * FROM r WHERE t = len(y)),
won AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY sse, a, b, c) = 1)"""


@query("search_monthly", f"""WITH RECURSIVE {_SEARCH}
SELECT o_orderstatus, k::INTEGER AS step, round(greatest(level + k * trend + seasons[k], 0), 2) AS forecast, a AS alpha, b AS beta, c AS gamma, round(sqrt(sse), 2) AS root_sse, 12 AS period FROM won, range(1, 7) h(k)""")
def search_monthly(spark, d):
    r = forecast.holt_winters_search(_monthly(spark, d), _S, "month", "total")
    return r.select("o_orderstatus", "step", F.round("forecast", 2).alias("forecast"), "alpha", "beta", "gamma", F.round(F.sqrt("sse"), 2).alias("root_sse"), "period")


@query("snapped_period_monthly", f"""WITH m AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) AS t, total - avg(total) OVER (PARTITION BY o_orderstatus) AS d, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {_MONTHLY}),
a AS (SELECT x.o_orderstatus, k, sum(x.d * z.d) / (x.n - k) AS acf FROM m x JOIN range(2, 53) l(k) ON k <= floor(x.n / 3) JOIN m z ON z.o_orderstatus = x.o_orderstatus AND z.t = x.t - k GROUP BY x.o_orderstatus, k, x.n),
b AS (SELECT o_orderstatus, k::INTEGER AS lag FROM a QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY acf DESC, k) = 1)
SELECT o_orderstatus, lag, (CASE WHEN abs(lag - 4) <= 1 THEN 4 WHEN abs(lag - 7) <= 1 THEN 7 WHEN abs(lag - 12) <= 1 THEN 12 WHEN abs(lag - 24) <= 1 THEN 24 WHEN abs(lag - 52) <= 1 THEN 52 ELSE lag END)::INTEGER AS period FROM b""")
def snapped_period_monthly(spark, d):
    return forecast.snapped_period(_monthly(spark, d), _S, "month", "total")


_DRIFT = f"""k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month DESC) AS k, lag(total) OVER (PARTITION BY o_orderstatus ORDER BY month) AS before, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) - 1 AS t, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {_MONTHLY}),
e AS (SELECT o_orderstatus, n, avg(total) FILTER (k <= least(greatest(n // 4, 3), 12)) AS mean, (arg_max(total, month) - arg_min(total, month)) / (n - 1) AS drift, regr_slope(total, t) AS slope, regr_intercept(total, t) AS base FROM k GROUP BY 1, 2),
q AS (SELECT k.o_orderstatus, avg(abs(total - before - drift)) AS err FROM k JOIN e USING (o_orderstatus) WHERE before IS NOT NULL AND k <= 12 GROUP BY 1),
p AS (SELECT k.o_orderstatus, t % 12 AS phase, avg(total - base - slope * t) AS s FROM k JOIN e USING (o_orderstatus) GROUP BY ALL)"""


@query("ensemble_monthly", f"""WITH RECURSIVE {_SEARCH}, {_DRIFT},
f AS (SELECT e.o_orderstatus, h.step, err, greatest(level + h.step * trend + seasons[h.step], 0) AS holt_winters, base + slope * (n + h.step - 1) + s AS linear, mean + drift * h.step AS drifted
  FROM e JOIN q USING (o_orderstatus) JOIN won USING (o_orderstatus) CROSS JOIN range(1, 7) h(step) JOIN p ON p.o_orderstatus = e.o_orderstatus AND p.phase = (n + h.step - 1) % 12),
x AS (SELECT *, 0.5 * holt_winters + 0.3 * linear + 0.2 * drifted AS forecast FROM f)
SELECT o_orderstatus, step::INTEGER AS step, round(holt_winters, 2) AS holt_winters, round(linear, 2) AS linear, round(drifted, 2) AS drifted, round(forecast, 2) AS forecast,
  round(forecast - 1.282 * err * sqrt(step), 2) AS lower_80, round(forecast + 1.282 * err * sqrt(step), 2) AS upper_80, round(forecast - 1.96 * err * sqrt(step), 2) AS lower_95, round(forecast + 1.96 * err * sqrt(step), 2) AS upper_95 FROM x""")
def ensemble_monthly(spark, d):
    r = forecast.ensemble_forecast(_monthly(spark, d), _S, "month", "total")
    return r.withColumns({c: F.round(c, 2) for c, kind in r.dtypes if kind == "double"})


#: Additive Holt-Winters from the first value on, with parameters 0.3, 0.1, 0.3 and period 12, half as many steps as months.
_PLAIN = f"""y AS (SELECT o_orderstatus, list(total ORDER BY month) AS y, max(month) AS last, len(list(total)) AS n FROM {_MONTHLY} GROUP BY 1),
r(o_orderstatus, y, t, level, trend, seasons, v, f) AS (
  SELECT o_orderstatus, y, 0, y[1], list_avg(y[1:12]) - y[1], list_transform(y[1:12], lambda x: x - list_avg(y[1:12])), NULL::DOUBLE, NULL::DOUBLE FROM y
  UNION ALL
  SELECT o_orderstatus, y, t + 1, nl, 0.1 * (nl - level) + 0.9 * trend, list_concat(seasons[2:12], [0.3 * (v - nl) + 0.7 * s]), v, level + trend + s
  FROM (SELECT *, y[t + 1] AS v2, seasons[1] AS s, 0.3 * (y[t + 1] - seasons[1]) + 0.7 * (level + trend) AS nl, y[t + 1] AS w FROM r WHERE t < len(y)) AS z(o_orderstatus, y, t, level, trend, seasons, v0, f0, v, s, nl, w)
), w AS (SELECT o_orderstatus, stddev_samp(v - f) AS spread, arg_max(level, t) AS level, arg_max(trend, t) AS trend, arg_max(seasons, t) AS seasons FROM r WHERE t > 0 GROUP BY 1),
f AS (SELECT w.o_orderstatus, h.k::INTEGER AS step, y.last, y.y, level + k * trend + seasons[(k - 1) % 12 + 1] AS forecast, 1.96 * spread * sqrt(k) AS wide
  FROM w JOIN y USING (o_orderstatus) CROSS JOIN range(1, 25) h(k) WHERE k <= least(greatest(n // 2, 6), 24))"""


@query("dated_forecast_monthly", f"""WITH RECURSIVE {_PLAIN}, g AS (SELECT o_orderstatus, date_diff('day', min(month), (list(month ORDER BY month))[2]) AS gap FROM {_MONTHLY} GROUP BY 1)
SELECT o_orderstatus, step, (last + (step * gap)::INTEGER)::DATE AS day, round(forecast, 2) AS forecast, round(forecast - wide, 2) AS lower, round(forecast + wide, 2) AS upper,
  arg_max(forecast, step) OVER (PARTITION BY o_orderstatus) > arg_min(forecast, step) OVER (PARTITION BY o_orderstatus) AS rising FROM f JOIN g USING (o_orderstatus)""")
def dated_forecast_monthly(spark, d):
    r = forecast.dated_forecast(_monthly(spark, d), _S, "month", "total")
    return r.select("o_orderstatus", "step", F.to_date("at").alias("day"), *[F.round(c, 2).alias(c) for c in ("forecast", "lower", "upper")], "rising")


def _plain_forecast(spark, d):
    m = _monthly(spark, d)
    return m, forecast.dated_forecast(m, _S, "month", "total")


_AHEAD = f"""h AS (SELECT o_orderstatus, avg(total) AS mean, stddev_samp(total) AS sd, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM {_MONTHLY} GROUP BY 1),
j AS (SELECT *, CASE WHEN forecast > q3 + 1.5 * (q3 - q1) THEN 'high' WHEN forecast < q1 - 1.5 * (q3 - q1) THEN 'low' END AS outside,
  CASE WHEN forecast - wide > mean + sd THEN 'high' WHEN forecast + wide < mean - sd THEN 'low' END AS excludes,
  coalesce(abs(forecast - lag(forecast) OVER (PARTITION BY o_orderstatus ORDER BY step)) / greatest(abs(lag(forecast) OVER (PARTITION BY o_orderstatus ORDER BY step)), 0.001) > 0.02, false) AS jumps FROM f JOIN h USING (o_orderstatus)),
found AS (SELECT o_orderstatus, step, outside, excludes, jumps, CASE (outside IS NOT NULL)::INT + (excludes IS NOT NULL)::INT + jumps::INT WHEN 0 THEN NULL WHEN 1 THEN 'warning' ELSE 'critical' END AS severity FROM j)"""


@query("anomalies_ahead_monthly", f"WITH RECURSIVE {_PLAIN}, {_AHEAD} SELECT * FROM found WHERE severity IS NOT NULL")
def anomalies_ahead_monthly(spark, d):
    """Steps that move by more than 2 percent count as jumps here, so that the table has cases at every size."""
    m, f = _plain_forecast(spark, d)
    return forecast.anomalies_ahead(m, f, _S, "month", "total", jump=0.02)


@query("anomaly_trend_monthly", f"""WITH RECURSIVE {_PLAIN}, {_AHEAD},
past AS (SELECT o_orderstatus, count_if(abs(total - mean) / sd > 1.5) / count(*) AS past_rate FROM {_MONTHLY} JOIN h USING (o_orderstatus) GROUP BY 1),
later AS (SELECT o_orderstatus, count(severity) / count(*) AS ahead_rate FROM found GROUP BY 1)
SELECT o_orderstatus, round(past_rate, 6) AS past_rate, round(ahead_rate, 6) AS ahead_rate, CASE WHEN ahead_rate > past_rate * 1.5 THEN 'increasing' WHEN ahead_rate < past_rate * 0.5 THEN 'decreasing' ELSE 'stable' END AS trend FROM past JOIN later USING (o_orderstatus)""")
def anomaly_trend_monthly(spark, d):
    m, f = _plain_forecast(spark, d)
    r = forecast.anomaly_trend(m, forecast.anomalies_ahead(m, f, _S, "month", "total", jump=0.02), f, _S, "total", threshold=1.5)
    return r.withColumns({c: F.round(c, 6) for c in ("past_rate", "ahead_rate")})


@query("beyond_anomalies_monthly", f"""WITH RECURSIVE {_PLAIN}, h AS (SELECT o_orderstatus, avg(total) - stddev_samp(total) AS low FROM {_MONTHLY} GROUP BY 1),
a AS (SELECT o_orderstatus, min(total) AS least, max(total) AS most FROM {_MONTHLY} JOIN h USING (o_orderstatus) WHERE total < low GROUP BY 1)
SELECT o_orderstatus, step, round(forecast, 2) AS forecast FROM f JOIN a USING (o_orderstatus) WHERE forecast - wide / 8 > most OR forecast + wide / 8 < least""")
def beyond_anomalies_monthly(spark, d):
    """Months a deviation below the mean as anomalies; steps whose interval, an eighth as wide, lies beyond them."""
    m, f = _plain_forecast(spark, d)
    limit = m.groupBy(*_S).agg((F.avg("total") - F.stddev_samp("total")).alias("low"))
    f = f.withColumns({"lower": F.col("forecast") - (F.col("forecast") - F.col("lower")) / 8, "upper": F.col("forecast") + (F.col("upper") - F.col("forecast")) / 8})
    r = forecast.beyond_anomalies(m.join(limit, _S).where("total < low"), f, _S, "total")
    return r.select("o_orderstatus", "step", F.round("forecast", 2).alias("forecast"))


@query("merged_anomalies_monthly", f"""WITH RECURSIVE {_EWMA}, h AS (SELECT o_orderstatus, avg(total) AS mean, stddev_samp(total) AS sd, stddev_pop(total) AS spread, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM {_MONTHLY} GROUP BY 1),
z AS (SELECT o_orderstatus, month, total, abs(total - mean) / sd > 1.5 AS z_flag, total NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS iqr_flag, k > 1 AND abs(total - ewma) / spread > 1.5 AS ewma_flag, abs(total - mean) / sd / 3 AS third FROM e JOIN h USING (o_orderstatus)),
s AS (SELECT *, CASE WHEN z_flag THEN third ELSE 0 END + iqr_flag::INT + ewma_flag::INT AS score FROM z)
SELECT o_orderstatus, month, z_flag, iqr_flag, ewma_flag, round(score, 5) AS score, CASE WHEN score >= 2 THEN 'critical' WHEN score >= 1 THEN 'warning' ELSE 'info' END AS severity FROM s WHERE score > 0""")
def merged_anomalies_monthly(spark, d):
    r = forecast.merged_anomalies(_monthly(spark, d), _S, "month", "total", most=None, z_limit=1.5, mean_limit=1.5)
    return r.drop("total").withColumn("score", F.round("score", 5))


@query("lagged_drivers_monthly", """WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total, count(*) AS n, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY ALL),
c AS (SELECT o_orderpriority, month, total AS y, unnest([{'driver': 'n', 'x': n::DOUBLE}, {'driver': 'buyers', 'x': buyers::DOUBLE}], recursive := true) FROM m),
l AS (SELECT *, lag(x) OVER (PARTITION BY o_orderpriority, driver ORDER BY month) AS before FROM c),
s AS (SELECT o_orderpriority, driver, corr(x, y) AS r, corr(before, y) AS lag_r, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM l GROUP BY ALL)
SELECT o_orderpriority, driver, round(r, 6) AS r, round(lag_r, 6) AS lag_r, round(slope, 3) AS slope, round(r2, 6) AS r2, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' WHEN abs(r) > 0.2 THEN 'weak' ELSE 'negligible' END AS strength,
  r > 0 AS positive, lag_r > r AS leads, round(least(0.95, 0.4 + abs(r) * 0.5 + abs(lag_r - r) * 0.1), 6) AS confidence FROM s""")
def lagged_drivers_monthly(spark, d):
    o = read_table(spark, d, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("month"))
    m = o.agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("buyers"))
    r = forecast.lagged_drivers(m, ["o_orderpriority"], "month", "total", ["n", "buyers"])
    return r.withColumns({c: F.round(c, 3 if c == "slope" else 6) for c in ("r", "lag_r", "slope", "r2", "confidence")})
