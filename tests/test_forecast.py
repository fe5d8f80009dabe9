import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from gneiss.operators import forecast, timeseries


def single_fit(y, alpha, beta, gamma, s, warm=False):
    """One parameter set by plain lists."""
    n = len(y)
    s = s if n >= 2 * s else max(2, n // 3)
    first = sum(y[:s]) / s
    level, trend = (first, (sum(y[s : 2 * s]) / len(y[s : 2 * s]) - first) / s) if warm else (0.0, 0.0)
    seasons = [v - first for v in y[:s]]
    sse = 0.0
    for t in range(s, n):
        sse += (y[t] - level - trend - seasons[t - s]) ** 2
        now = alpha * (y[t] - seasons[t - s]) + (1 - alpha) * (level + trend)
        trend = beta * (now - level) + (1 - beta) * trend
        level = now
        seasons.append(gamma * (y[t] - now) + (1 - gamma) * seasons[t - s])
    return sse, level, trend, seasons


def waves(n, seed, period=12):
    r = random.Random(seed)
    return [100 + t / 3 + 20 * math.sin(2 * math.pi * t / period) + r.gauss(0, 3) for t in range(n)]


SERIES = {"long": waves(90, 1), "short": waves(20, 2), "week": waves(70, 3, 7), "low": [5 - t / 4 for t in range(30)], None: waves(40, 5), "four": [1.0, 2.0, 4.0, 3.0], "three": [1.0, 2.0, 3.0]}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t, v) for k, vs in SERIES.items() for t, v in enumerate(vs)] + [("long", 99, None)]
    return spark.createDataFrame(rows, "k string, t int, v double").repartition(5)


@pytest.mark.parametrize("warm", [False, True])
def test_search_equals_eighty_single_fits(table, warm):
    got = {}
    for r in forecast.holt_winters_search(table, ["k"], "t", "v", horizon=15, warm=warm).collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == set(SERIES) - {"three"}
    for k, rows in got.items():
        y = SERIES[k]
        fits = [(single_fit(y, a, b, c, 12, warm), (a, b, c)) for a in forecast.ALPHAS for b in forecast.BETAS for c in forecast.GAMMAS]
        (sse, level, trend, seasons), best = min(fits, key=lambda f: f[0][0])
        for r in rows:
            assert (r.alpha, r.beta, r.gamma) == best and r.sse == pytest.approx(sse) and r.period == 12
            want = level + r.step * trend + seasons[(len(y) - 12 + (r.step - 1) % 12) % len(y)]
            assert r.forecast == pytest.approx(max(0.0, want), abs=1e-9)
        assert sorted(r.step for r in rows) == list(range(1, 16))
    assert any(r.forecast == 0 for r in got["low"])


def test_search_with_a_period_column_and_without_clip(table):
    period = forecast.snapped_period(table, ["k"], "t", "v")
    known = {r.k: r for r in period.collect()}
    assert known["long"].period == 12 and known["week"].period == 7
    assert known["four"].period == 4 and known["four"].lag is None
    joined = table.join(period.select("k", "period"), "k")
    r = forecast.holt_winters_search(joined, ["k"], "t", "v", "period", horizon=1, clip=False).where("k = 'week'").first()
    y = SERIES["week"]
    assert r.period == 7 and r.sse == pytest.approx(min(single_fit(y, a, b, c, 7)[0] for a in forecast.ALPHAS for b in forecast.BETAS for c in forecast.GAMMAS))


def test_snapped_period_by_brute_force(table):
    for r in forecast.snapped_period(table, ["k"], "t", "v").collect():
        y = SERIES[r.k]
        n = len(y)
        if n < 16:
            assert r.period == 4
            continue
        m = sum(y) / n
        acf = {k: sum((y[t] - m) * (y[t - k] - m) for t in range(k, n)) / (n - k) for k in range(2, min(n // 3, 52) + 1)}
        lag = min(acf, key=lambda k: (-acf[k], k))
        assert r.lag == lag and r.period == next((s for s in (4, 7, 12, 24, 52) if abs(lag - s) <= 1), lag)


def test_ensemble_bands(table):
    rows = [r for r in forecast.ensemble_forecast(table, ["k"], "t", "v").collect() if r.k == "long"]
    y = SERIES["long"]
    drift = (y[-1] - y[0]) / (len(y) - 1)
    err = sum(abs(y[-i] - y[-i - 1] - drift) for i in range(1, 13)) / 12
    for r in rows:
        assert r.drifted == pytest.approx(sum(y[-12:]) / 12 + drift * r.step)
        assert r.forecast == pytest.approx(0.5 * r.holt_winters + 0.3 * r.linear + 0.2 * r.drifted)
        assert r.upper_80 - r.forecast == pytest.approx(1.282 * err * math.sqrt(r.step))
        assert r.forecast - r.lower_95 == pytest.approx(1.96 * err * math.sqrt(r.step))


def test_dates_follow_the_first_gap(spark):
    rows = [("a", date(2024, 1, 1) + timedelta(days=3 * k), float(k)) for k in range(10)] + [("b", date(2024, 1, 1), 1.0), ("b", date(2024, 1, 2), 2.0)]
    got = forecast.dated_forecast(spark.createDataFrame(rows, "k string, day date, v double"), ["k"], "day", "v").orderBy("step").collect()
    assert [r.k for r in got] == ["a"] * 6 and [str(r.at.date()) for r in got][:2] == ["2024-01-31", "2024-02-03"]


def test_planted_anomalies_ahead(spark):
    history = spark.createDataFrame([("a", k, 10.0 + k % 3) for k in range(30)] + [("b", k, 1.0) for k in range(4)], "k string, t int, v double")
    steps = [("a", 1, 11.0, 10.0, 12.0), ("a", 2, 40.0, 35.0, 45.0), ("a", 3, 39.0, 9.0, 60.0), ("a", 4, 5.0, 4.0, 6.0), ("a", 5, 5.5, 5.0, 30.0), ("b", 1, 99.0, 98.0, 100.0)]
    ahead = spark.createDataFrame(steps, "k string, step int, forecast double, lower double, upper double")
    found = forecast.anomalies_ahead(history, ahead, ["k"], "t", "v")
    got = {r.step: (r.outside, r.excludes, r.jumps, r.severity) for r in found.collect()}
    assert got == {2: ("high", "high", True, "critical"), 3: ("high", None, False, "warning"), 4: ("low", "low", True, "critical"), 5: ("low", None, False, "warning")}
    trend = {r.k: r for r in forecast.anomaly_trend(history, found, ahead, ["k"], "v").collect()}
    assert (trend["a"].past_rate, trend["a"].ahead_rate, trend["a"].trend) == (0.0, 0.8, "increasing")
    assert trend["b"].trend == "stable"
    beyond = forecast.beyond_anomalies(spark.createDataFrame([("a", 20.0), ("a", 30.0)], "k string, v double"), ahead, ["k"], "v")
    assert sorted((r.k, r.step) for r in beyond.collect()) == [("a", 1), ("a", 2), ("a", 4)]


def test_planted_rows_of_three_detectors(spark):
    values = [10.0, 11.0] * 20
    values[30] = 60.0
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + [("b", k, 5.0) for k in range(3)] + [("flat", k, 2.0) for k in range(9)], "k string, t int, v double")
    got = forecast.merged_anomalies(df, ["k"], "t", "v").collect()
    assert [(r.k, r.t) for r in got] == [("a", 30)]
    m, s = np.mean(values), np.std(values, ddof=1)
    assert got[0].score == pytest.approx((60 - m) / s / 3 + 2) and got[0].severity == "critical"


def test_a_driver_one_step_ahead(spark):
    r = random.Random(3)
    x = [r.random() for _ in range(60)]
    rows = [("s", t, 2 * x[t - 1] if t else 0.0, x[t], 5.0) for t in range(60)]
    got = {q.driver: q for q in forecast.lagged_drivers(spark.createDataFrame(rows, "k string, t int, y double, x double, c double"), ["k"], "t", "y", ["x", "c"]).collect()}
    assert got["x"].lag_r == pytest.approx(1.0) and got["x"].leads and got["x"].strength in ("negligible", "weak")
    assert got["c"].r == 0 and got["c"].slope == 0 and got["c"].strength == "negligible"
    assert got["x"].confidence == pytest.approx(min(0.95, 0.4 + abs(got["x"].r) * 0.5 + abs(1 - got["x"].r) * 0.1))


def test_running_mean_over_many_ranges(spark):
    r = random.Random(4)
    values = [r.uniform(-5, 5) for _ in range(5000)]
    rows = [("hot", k, v) for k, v in enumerate(values)] + [(None, 1, 3.0), (None, 2, 5.0), ("hole", 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(q.k, q.t): q.ewma for q in timeseries.ewma(df, ["k"], "t", "v", 0.2).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    e = values[0]
    for k, v in enumerate(values):
        e = v if k == 0 else 0.2 * v + 0.8 * e
        assert got["hot", k] == pytest.approx(e, abs=1e-9)
    assert got[None, 2] == pytest.approx(3.4) and len(got) == 5002
