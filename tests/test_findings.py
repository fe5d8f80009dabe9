import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gneiss.functions import arrays
from gneiss.operators import findings
from gneiss.plans import catalog, told  # noqa: F401  (registers its queries)

FOUND = "title string, impact string, confidence double, category string"


def test_relevant_findings(spark):
    long = "the same forty letters of a title come first and then "
    rows = [
        ("Overview", "low", 0.9, "overview"),
        ("weak but high", "high", 0.1, "detail"),
        ("middling", "medium", 0.7, "detail"),
        ("sure", "medium", 0.71, "detail"),
        ("low and sure", "low", 0.86, "detail"),
        ("odd", "unknown", 0.99, "detail"),
        ("no confidence", "low", None, "detail"),
        (long + "a", "high", 0.5, "detail"),
        (long.upper() + "b", "high", 0.6, "detail"),
    ]
    got = [(r.place, r.title) for r in findings.relevant_findings(spark.createDataFrame(rows, FOUND)).orderBy("place").collect()]
    assert got == [(1, long.upper() + "b"), (2, "weak but high"), (3, "sure"), (4, "low and sure"), (5, "odd")]
    assert findings.relevant_findings(spark.createDataFrame(rows, FOUND), most=2).count() == 2
    only = findings.relevant_findings(spark.createDataFrame(rows[:1], FOUND)).collect()
    assert [r.title for r in only] == ["Overview"]
    assert findings.relevant_findings(spark.createDataFrame([], FOUND)).collect() == []


def test_review(spark):
    runs = spark.createDataFrame([("success",)] * 3 + [("failed",)], "status string")
    rows = [("Sales increase", "high", 0.2, "x"), ("Costs go down", "high", 0.9, "x"), ("Plain", "low", 0.1, "x")]
    r = findings.review(spark.createDataFrame(rows, FOUND), runs).first()
    assert (r.weak, r.contradictions, r.success_rate, r.score) == (2, 1, 0.75, 60.0)
    none = findings.review(spark.createDataFrame([], FOUND), runs.where("false")).first()
    assert (none.weak, none.contradictions, none.success_rate, none.score) == (0, 0, 0.0, 0.0)


def test_columns_side_by_side(spark):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id int, v string").repartition(3)
    b = spark.createDataFrame([(9, "x"), (8, "y")], "k int, V string").repartition(2)
    out = findings.concat_columns(a, b, ["id"], ["k"])
    assert out.columns == ["id", "v", "k", "V_right"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 8, "y"), (2, "b", 9, "x"), (3, "c", None, None)]


def test_plans_of_small_tables(spark):
    cards = spark.createDataFrame([("a", "numeric", 10)], "column string, type string, rows long")
    none = spark.createDataFrame([], "column string")
    assert [tuple(r) for r in findings.analysis_plan(cards, none).collect()] == [(1, "Descriptive Statistics", "targeted")]


def test_personal_columns(spark):
    rows = [("a@b.co", "12", "2020-01-02", None)] * 3 + [("x", "13", "x", "y")] * 5
    got = {(r.column, r.method): (r.kind, r.share) for r in findings.personal_columns(spark.createDataFrame(rows, "contact string, zipcode string, day string, u string")).collect()}
    assert got == {("contact", "pattern"): ("email", 0.375), ("zipcode", "name"): ("address", None), ("day", "pattern"): ("date_of_birth", 0.375)}
    assert findings.personal_columns(spark.createDataFrame([], "email string")).collect() == []


def test_market_measures(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([10.0, 11.0, 0.0, 5.0, 100.0])] + [("b", 0, 1.0), (None, 0, 2.0), (None, 1, 4.0)], "k string, t int, v double")
    moves = {r.k: r for r in findings.rate_moves(df, ["k"], "t", "v").collect()}
    assert set(moves) == {"a", None} and moves["a"].change_pct == pytest.approx(900) and moves["a"].assessment == "high_volatility"
    steps = [0.1, -1.0, 19.0]  # there is no change from 0
    assert moves["a"].yearly_pct == pytest.approx(100 * math.sqrt(sum(s * s for s in steps) / 3 * 252))
    bench = {r.k: r for r in findings.against_benchmark(df, ["k"], "v", 10.0, 1.5).collect()}
    assert bench["a"].vs_benchmark_pct == pytest.approx((25.2 / 10 - 1) * 100) and bench["a"].anomalies == 1 and bench["b"].anomalies == 0
    days = spark.sql("SELECT 'x' AS k, date'2024-01-05' AS d, 1.0D AS v UNION ALL SELECT 'x', date'2023-01-05', 3.0D UNION ALL SELECT 'x', date'2024-02-01', 2.0D UNION ALL SELECT 'x', date'2024-03-01', 5.0D UNION ALL SELECT 'x', null, 9.0D")
    got = {r.month: (r.mean, r.seasonal, r.peak, r.low) for r in findings.calendar_pattern(days, ["k"], "d", "v").collect()}
    assert got == {1: (2.0, True, False, True), 2: (2.0, True, False, False), 3: (5.0, True, True, False)}


def test_arrays(spark):
    df = spark.sql("SELECT array(1, 2, 3, 4) AS a, array(array(1), null, array(2, 3)) AS n, array('x', 'y') AS b, cast(null AS array<int>) AS none, array(1, null) AS holes")
    a = F.col("a")
    row = df.select(
        arrays.slice_of(a, 1).alias("rest"), arrays.slice_of(a, -2).alias("end"), arrays.slice_of(a, 1, -1).alias("inner"), arrays.slice_of(a, 3, 1).alias("empty"), arrays.slice_of(a, -9, 99).alias("all"),
        arrays.flat(F.col("n")).alias("flat"), arrays.zipped(a, F.col("b")).alias("pairs"), arrays.includes(a, F.lit(3)).alias("has"), arrays.includes(a, F.lit(None)).alias("null_in"),
        arrays.includes(F.col("holes"), F.lit(None)).alias("null_there"), arrays.includes(F.col("none"), F.lit(1)).alias("unknown"),
    ).first()
    assert (row.rest, row.end, row.inner, row.empty, row.all, row.flat) == ([2, 3, 4], [3, 4], [2, 3], [], [1, 2, 3, 4], [1, 2, 3])
    assert [tuple(p) for p in row.pairs] == [(1, "x"), (2, "y")]
    assert (row.has, row.null_in, row.null_there, row.unknown) == (True, False, True, None)


def test_array_rules_of_null_labels_null_and_short_vectors_and_small_negatives(spark, tmp_path):
    rows = [(1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], None), (2, None, 1), (3, [], 3), (4, [0.5], 1), (5, [None, None, 1.0, None, 2.0, None], 2), (6, [-0.000001, -0.015625, -0.000001], 4), (7, None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    query, sql = catalog.QUERIES["array_rules_embeddings"], catalog.ORACLES["array_rules_embeddings"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(sql).fetchall()))  # repr tells zero from minus zero
