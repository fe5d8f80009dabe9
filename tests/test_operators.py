import math

import pytest
from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import clean, detect, graph, ml, profile, quality, regress, report, synthetic, text, timeseries
from gneiss.operators.relational import Query
from gneiss.plans import reference


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1.0, "A", "2023-01-01", 1), (2.0, "B", "2023-01-02", 2), (None, "A", "2023-01-03", 3), (4.0, None, "2023-01-04", 4), (5.0, "C", "2023-01-05", 5), (100.0, "B", "2023-01-06", 6)]
    return spark.createDataFrame(rows, "num double, cat string, day string, id int")


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_drop_and_impute(frame):
    assert clean.drop_missing(frame, ["num", "cat"]).count() == 4
    assert column(clean.impute(frame, ["num"]), "num")[2] == 4.0
    assert column(clean.impute(frame, ["num"], "mean"), "num")[2] == pytest.approx(22.4)
    assert column(clean.impute(frame, ["cat"], "mode"), "cat")[3] == "A"
    assert column(clean.impute(frame, ["num"], "constant", 7.0), "num")[2] == 7.0


def test_outliers_and_scaling(frame):
    assert 100.0 not in column(clean.outliers(frame, ["num"], "iqr", "remove"), "num")
    assert max(v for v in column(clean.outliers(frame, ["num"], "iqr", "cap"), "num") if v is not None) < 100
    assert column(clean.scale(frame, ["num"], "minmax"), "num_scaled")[0] == 0
    one = frame.withColumn("num", F.lit(3.0))
    assert set(column(clean.scale(one, ["num"], "minmax"), "num_scaled")) == {0.5}
    assert set(column(clean.scale(one, ["num"], "standard"), "num_scaled")) == {0.0}


def test_encoders(frame):
    assert column(clean.label_encode(frame, "cat", "id", "code"), "code") == [0, 1, 0, None, 2, 1]
    assert column(clean.ordinal_encode(frame, "cat", ["C", "B", "A"], "code"), "code")[:2] == [2, 1]
    assert column(clean.one_hot(frame, "cat", ["A", "B", "C"], True), "cat_B") == [0, 1, 0, 0, 0, 1]


def test_fill_and_lags(frame):
    df = frame.withColumn("s", F.lit(1))
    assert column(timeseries.fill(df, ["s"], "id", "num"), "filled")[2] == 2.0
    assert column(timeseries.fill(df, ["s"], "id", "num", "backward"), "filled")[2] == 4.0
    assert column(timeseries.fill(df, ["s"], "id", "num", "interpolate"), "filled")[2] == 3.0


def test_adjusted_moments(spark):
    v = [1.0, 2.0, 4.0, 8.0, 16.0, 3.0]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    n, m = len(v), sum(v) / len(v)
    sd = math.sqrt(sum((x - m) ** 2 for x in v) / n)
    z3, z4 = (sum(((x - m) / sd) ** p for x in v) for p in (3, 4))
    row = df.agg(stats.skewness(F.col("x")), stats.kurtosis(F.col("x"))).first()
    assert row[0] == pytest.approx(n / ((n - 1) * (n - 2)) * z3)
    assert row[1] == pytest.approx(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * z4 - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    empty = df.limit(0).agg(stats.mean(F.col("x")), stats.stdev(F.col("x")), stats.skewness(F.col("x"))).first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_inference_edges(spark):
    df = spark.createDataFrame([("1", None, "2024-01-01", "yes"), ("2", None, "2024-01-02", "no"), ("x", "", "2024-01-03", "yes")], "a string, b string, c string, d string")
    kinds = {r.column: r.type for r in profile.infer_schema(df).collect()}
    assert kinds == {"a": "text", "b": "boolean", "c": "datetime", "d": "boolean"}
    strict = {r.column: r.type for r in profile.infer_schema(df, rules="strict").collect()}
    assert strict["b"] == "empty" and strict["c"] == "datetime"


def test_query_rejects_cross_join_with_condition(frame):
    with pytest.raises(ValueError):
        Query(frame).join(frame, "true", "cross")
    with pytest.raises(ValueError):
        Query(frame).join(frame, None, "inner")


def test_least_squares_and_test_statistics(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("y", 3 + 2 * F.col("x") - F.col("z"))
    got = {r.term: r.coefficient for r in regress.ols(df, "y", ["x", "z"]).collect()}
    assert got == pytest.approx({"intercept": 3, "x": 2, "z": -1})
    two = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", float(v)) for v in (2, 4, 6, 9)], "g string, v double")
    row = regress.welch_test(two, "v", "g", "a", "b").first()
    assert row.t == pytest.approx(-1.6906, abs=1e-3) and 0.1 < row.p_value < 0.2
    assert regress._t_tail(2.0, 10) == pytest.approx(0.07339, abs=1e-4)


def test_forecasts(spark):
    df = spark.range(48).select(F.lit("s").alias("k"), F.col("id").alias("t"), (10 + F.col("id") + 5 * F.sin(F.col("id") * math.pi / 6)).alias("y"))
    for variant in ("updated", "plain"):
        rows = timeseries.holt_winters(df, ["k"], "t", "y", 12, 12, variant=variant).orderBy("step").collect()
        assert len(rows) == 12 and rows[0].lower < rows[0].forecast < rows[0].upper and abs(rows[11].forecast - 69) < 12
    line = timeseries.linear_seasonal_forecast(df, ["k"], "t", "y").orderBy("step").collect()
    assert abs(line[0].forecast - 58) < 4
    assert timeseries.seasonality(timeseries.autocorrelation(df.withColumn("y", F.sin(F.col("t") * math.pi / 6)), ["k"], "t", "y"), ["k"]).first().period == 12


def test_long_seasons_are_seen(spark, monkeypatch):
    year = spark.range(120).select(F.lit("s").alias("o_orderstatus"), F.col("id").alias("month"), F.sin(F.col("id") * math.pi / 12).alias("total"))
    both = year.union(year.where("month < 60").withColumns({"o_orderstatus": F.lit("short"), "total": F.sin(F.col("month") * math.pi / 6)}))
    monkeypatch.setattr(reference, "_monthly", lambda spark, d: both)
    assert {r.o_orderstatus: r.period for r in reference.seasonality_monthly(spark, "").collect()} == {"s": 24, "short": 12}
    lags = timeseries.autocorrelation(both, ["o_orderstatus"], "month", "total", most=None).groupBy("o_orderstatus").agg(F.max("lag").alias("m")).collect()
    assert {r.o_orderstatus: r.m for r in lags} == {"s": 48, "short": 30}


def test_masks_and_sentiment(spark):
    df = spark.createDataFrame([(1, "ann@mail.org", "Not good, terrible"), (2, "x@y.z", "great great win"), (3, None, None)], "id int, mail string, body string")
    assert column(df.select("id", text.mask(F.col("mail"), "email").alias("m")), "m")[0] == "a***@mail.org"
    assert column(text.sentiment(df, "body", ["id"]), "label") == ["negative", "positive", "neutral"]
    assert column(text.sentiment_negated(df, "body", ["id"]), "label")[1:] == ["positive", "neutral"]


def test_dbscan_and_graph(spark):
    pts = [(k, 0.1 * k, 0.0) for k in range(10)] + [(20 + k, 9.0, 0.1 * k) for k in range(6)] + [(99, 50.0, 50.0)]
    got = {r.id: r.cluster for r in ml.dbscan(spark.createDataFrame(pts, "id int, x double, y double"), "id", ["x", "y"], 0.25, 3).collect()}
    assert {got[k] for k in range(10)} == {0} and {got[k] for k in range(20, 26)} == {20} and got[99] is None
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string")
    assert {r.node: r.hops for r in graph.distances(edges, "a").collect()} == {"a": 0, "b": 1, "c": 2}


def test_anomalies_and_reports(spark, frame):
    assert column(detect.iqr(frame, "num"), "id") == [6]
    assert column(detect.modified_zscore(frame, "num"), "id") == [6]
    found = detect.merge_by_row([frame.select("id", F.lit(1.0).alias("score"), F.lit("a").alias("reason")), frame.select("id", F.lit(2.0).alias("score"), F.lit("b").alias("reason"))], "id")
    assert found.orderBy("id").first()[1:] == (2.0, "a,b")
    assert report.ask(frame, "how many rows?").first().answer == 6
    assert quality.detect_domain(["order_price"]) == "finance/sales"
    made = synthetic.synthesize(frame, ["num"], ["cat"], 50)
    assert made.count() == 50 and {r.cat for r in made.collect()} <= {"A", "B", "C"}
