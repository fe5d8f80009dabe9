import math
import random

import numpy as np
import pytest

from gneiss.operators import graph, ordered, profile
from gneiss.session import shared_dir


def table(spark):
    r = random.Random(5)
    rows = [("hot", float(r.randint(0, 50))) for _ in range(3000)] + [("b", float(k)) for k in range(7)] + [(None, 1.5), (None, 2.5), ("one", 4.0), ("none", None), ("none", math.nan), ("b", None)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(6)


def groups(rows):
    out = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            out.setdefault(k, []).append(v)
    return out


def test_quantiles(spark):
    rows, df = table(spark)
    got = {r.k: r for r in ordered.quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5, "top": 1.0, "odd": 0.137}).collect()}
    want = groups(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k].size, got[k].distinct, got[k].low, got[k].high) == (len(v), len(set(v)), min(v), max(v))
        for name, q in (("q1", 25), ("median", 50), ("top", 100), ("odd", 13.7)):
            assert got[k][name] == pytest.approx(np.percentile(v, q))


def test_quantiles_of_a_whole_table_and_of_nothing(spark):
    rows, df = table(spark)
    values = [v for vs in groups(rows).values() for v in vs]
    assert ordered.quantiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(np.median(values))
    assert ordered.quantiles(df.where("false"), ["k"], "v", {"m": 0.5}).collect() == []


def test_average_ranks(spark):
    rows, df = table(spark)
    got = {(r.k, r.v): (r.n, r.mean_rank) for r in ordered.average_ranks(df, ["k"], "v").collect()}
    for k, vs in groups(rows).items():
        for v in set(vs):
            places = [i + 1 for i, x in enumerate(sorted(vs)) if x == v]
            assert got[k, v] == (len(places), pytest.approx(sum(places) / len(places)))


def test_spearman(spark):
    r = random.Random(2)
    rows = [("a", float(x), float(x // 3 + r.randint(0, 4))) for x in range(200)] + [("flat", 1.0, float(x)) for x in range(5)] + [(None, 1.0, 2.0), (None, 2.0, 1.0), ("a", None, 3.0)]
    got = {x.k: x.rho for x in ordered.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}

    def ranks(values):
        return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]

    whole = [q for q in rows if q[0] == "a" and q[1] is not None]
    assert got["a"] == pytest.approx(np.corrcoef(ranks([q[1] for q in whole]), ranks([q[2] for q in whole]))[0, 1])
    assert got["flat"] == 0.0 and got[None] == pytest.approx(-1.0)


def test_no_range_holds_a_hot_group(spark):
    df = spark.range(20_000).selectExpr("'one' AS k", "CAST(id AS DOUBLE) AS v").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = ordered.running_counts(df, ["k"], "v")
        plan = counts._jdf.queryExecution().toString() if hasattr(counts, "_jdf") else ""
        assert "rangepartitioning" not in plan  # the ranges are a table by now
        assert [r.before for r in counts.orderBy("v").limit(3).collect()] == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_equal_plain_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gneiss.operators import windows

    r = random.Random(9)
    rows = [(k, r.choice(["a", "b", None]), r.choice([None, *range(40)])) for k in range(400)] + [(400, "alone", 3), (401, "nulls", None), (402, "nulls", None)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    w = Window.partitionBy("g").orderBy("v")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w), "nth_value": F.nth_value("v", 2).over(whole)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = windows.ranks(df, ["g"], "v")
        assert sorted(got.columns) == sorted([*want.columns, "ntile"])
        assert {r.id: (r["rank"], r.dense_rank, r.percent_rank, r.cume_dist, r.nth_value) for r in got.collect()} == {r.id: (r["rank"], r.dense_rank, r.percent_rank, r.cume_dist, r.nth_value) for r in want.collect()}
        sizes = {(r.g, r.ntile): r.n for r in got.groupBy("g", "ntile").agg(F.count("*").alias("n")).collect()}
        plain = df.withColumn("ntile", F.ntile(4).over(w)).groupBy("g", "ntile").agg(F.count("*").alias("n"))
        assert sizes == {(r.g, r.ntile): r.n for r in plain.collect()}
        assert windows.ranks(df, [], "id").where("rank = 403").first().cume_dist == 1.0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_box_stats_of_repeated_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 1, 1, 2, 9)] + [("b", None)], "g string, v double")
    assert [tuple(r) for r in profile.box_stats(df, "g", "v").collect()] == [("a", 1.0, 1.0, 1.0, 2.0, 9.0)]


def test_distances_have_no_end(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 1) for k in range(30)], "src string, dst string, weight int")
    got = {r.node: r.hops for r in graph.distances(chain, "n0").collect()}
    assert got == {f"n{k}": k for k in range(31)}
    assert graph.distances(chain, "elsewhere").collect() == []


def test_labels_settle(spark):
    def clique(names):
        return [(a, b, 1) for a in names for b in names if a < b]

    edges = spark.createDataFrame(clique("abcde") + clique("vwxyz") + [("e", "v", 1)], "src string, dst string, weight int")
    found = {r.node: r.community for r in graph.label_propagation(edges).collect()}
    assert len({found[n] for n in "abcde"}) == len({found[n] for n in "vwxyz"}) == 1 and found["a"] != found["z"]
    star = spark.createDataFrame([("hub", f"leaf{k}", 1) for k in range(9)], "src string, dst string, weight int")
    assert len({r.community for r in graph.label_propagation(star).collect()}) == 1


def test_shared_folder_is_refused_on_clusters(spark):
    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://far:7077"}.get(name, default)

    class Far:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Far())
