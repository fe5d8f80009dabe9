from gneiss.operators import causes, joins
from pyspark.sql import functions as F


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None), (6, "a", 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("a", 5, 30), ("b", 10, 40), ("a", None, 50)], "k string, t int, v int")
    got = {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {1: 30, 2: None, 3: None, 4: None, 5: None, 6: 30}
    assert joins.asof_join(left.limit(0), right, ["k"], "t", ["v"]).count() == 0


def test_range_join(spark):
    points = spark.createDataFrame([(1, -3.0), (2, 0.0), (3, 10.0), (4, None)], "id int, p double")
    ranges = spark.createDataFrame([("x", -5.0, 0.0), ("y", 0.0, 25.0), ("z", 9.0, 8.0), ("n", None, 1.0)], "name string, low double, high double")
    got = sorted((r.id, r.name) for r in joins.range_join(points, ranges, "p", "low", "high", 4.0).collect())
    assert got == [(1, "x"), (2, "x"), (2, "y"), (3, "y")]


def test_blend_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(causes.blend({"a": F.col("a"), "b": F.col("b")}, {"a": 0.5, "b": 1.5})).collect()]
    assert got == [2.5, 3.0, None]


def test_a_bucket_of_many_pairs_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(joins, "_PAIRS", 500)
    p = spark.range(300).selectExpr("id AS p", "CAST(id % 10 AS DOUBLE) AS x")
    q = spark.range(40).selectExpr("id AS q", "CAST(id % 7 AS DOUBLE) AS low", "CAST(id % 7 + 3 AS DOUBLE) AS high")
    found = joins.range_join(p, q, "x", "low", "high", 100.0)  # one bucket holds all
    got = sorted((r.p, r.q) for r in found.collect())
    assert got == sorted((a, b) for a in range(300) for b in range(40) if b % 7 <= a % 10 <= b % 7 + 3)
    held = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(held) > 8 and max(held) < len(got) / 4
