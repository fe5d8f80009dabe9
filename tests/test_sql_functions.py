import numpy as np
import pytest
from pyspark.errors import PySparkException

from gneiss.functions import sql
from gneiss.operators import profile


@pytest.fixture(scope="module", autouse=True)
def functions(spark):
    sql.register(spark)


def test_moments_add_up():
    x = np.random.default_rng(1).gamma(2.0, size=1000)
    for cut in (0, 1, 2, 500, 999, 1000):
        both = sql.Moments.of(x[:cut]).add(sql.Moments.of(x[cut:]))
        whole = sql.Moments.of(x)
        for f in sql.Moments.__slots__:
            assert getattr(both, f) == pytest.approx(getattr(whole, f), rel=1e-9)


def test_profile_equals_the_operator(spark):
    rows = [(k, float(k % 7) if k % 5 else None, "x", 1.5) for k in range(500)] + [(7, float("nan"), None, 1.5)]
    df = spark.createDataFrame(rows, "i int, x double, s string, c double").repartition(5)
    df.createOrReplaceTempView("some_rows")
    want = {r.column: r for r in profile.numeric_profile(df, digits=9).collect()}
    got = {r.column: r for r in sql.profile_table(spark, "some_rows").collect()}
    assert set(got) == set(want) == {"i", "x", "c"}
    for c in want:
        for f in want[c].asDict():
            assert got[c][f] == (want[c][f] if isinstance(want[c][f], (str, int)) else pytest.approx(want[c][f], abs=1e-6)), (c, f)
    assert got["x"].nulls == 101


def test_profile_of_nothing(spark):
    spark.createDataFrame([], "a int, s string").createOrReplaceTempView("no_rows")
    spark.createDataFrame([("x",)], "s string").createOrReplaceTempView("no_numbers")
    assert sql.profile_table(spark, "no_rows").collect() == [] and sql.profile_table(spark, "no_numbers").collect() == []


def test_sessionize_takes_any_table(spark):
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00', 1), ('a', timestamp'2024-01-01 00:00:10', 2), ('a', timestamp'2024-01-01 00:00:21', 3), ('a', null, 4), ('b', timestamp'2024-01-01 00:00:00', 5) t(k, at, n)").createOrReplaceTempView("visits")
    out = spark.sql("SELECT * FROM sessionize(TABLE(visits) PARTITION BY k ORDER BY at, time => 'at', gap => 10)")
    assert out.columns == ["k", "at", "n", "session"]
    assert sorted((r.n, r.session) for r in out.collect()) == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 0)]
    with pytest.raises(PySparkException, match="name of one of its columns"):
        spark.sql("SELECT * FROM sessionize(TABLE(visits) PARTITION BY k ORDER BY at, time => 'nope', gap => 10)")
    with pytest.raises(PySparkException, match="already has a column session"):
        spark.sql("SELECT * FROM sessionize(TABLE(SELECT *, 1 AS session FROM visits) PARTITION BY k ORDER BY at, time => 'at', gap => 10)")


def test_bodies_and_aggregate(spark):
    row = spark.sql("SELECT percent_change(3, 2) AS up, percent_change(1, 0) AS none, grade_of(85) AS g, adjusted_skewness(2, 1, 1) AS s, adjusted_kurtosis(3, 1, 1) AS k").first()
    assert tuple(row) == (0.5, None, "B", 0.0, 0.0)
    slopes = spark.sql("SELECT g, series_slope(t, v) AS s FROM VALUES ('a', 1, 2.0), ('a', 2, 4.0), ('a', 3, null), ('b', 1, 1.0) x(g, t, v) GROUP BY g").collect()
    assert {r.g: r.s for r in slopes} == {"a": 2.0, "b": None}
    x = np.random.default_rng(2).gamma(2.0, size=200)
    m = sql.Moments.of(x)
    n = len(x)
    z = (x - x.mean()) / x.std()
    got = spark.sql(f"SELECT adjusted_skewness({n}, double('{m.m2}'), double('{m.m3}')) AS s, adjusted_kurtosis({n}, double('{m.m2}'), double('{m.m4}')) AS k").first()
    assert got.s == pytest.approx(n / ((n - 1) * (n - 2)) * (z**3).sum())
    assert got.k == pytest.approx(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
