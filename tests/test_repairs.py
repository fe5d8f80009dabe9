"""Cases that earlier versions of the operators got wrong, and interfaces without a query of their own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import causes, clean, detect, joins, quality, regress, synthetic, text, windows
from gneiss.operators.relational import Query
from gneiss.sources import readers, writers


def scans(df):
    """Scans of tables in the plan as Spark explains it."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    plan = out.getvalue().split("== Initial Plan ==")[0]
    return sum(plan.split("\n\n")[0].count(x) for x in ("Scan parquet", "Scan ExistingRDD", "LocalTableScan"))


ROWS = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", None, 4)]


def test_groupings_without_an_aggregate(spark):
    df = spark.createDataFrame(ROWS, "g string, h string, v int")
    cube = Query(df).cube("g", "h").to_df()
    assert sorted(map(repr, (tuple(r) for r in cube.collect()))) == sorted(map(repr, (tuple(r) for r in df.cube("g", "h").agg(F.count("*").alias("n")).drop("n").collect())))
    assert Query(df).rollup("g", "h").to_df().count() == df.rollup("g", "h").count().count()
    sets = Query(df).grouping_sets([["g"], ["h"]]).to_df()
    assert sorted((r.g or "-", r.h or "-") for r in sets.collect()) == sorted([("a", "-"), ("b", "-"), ("-", "x"), ("-", "y"), ("-", "-")])
    assert Query(df).group_by("g").to_df().count() == 2


def test_select_beside_aggregates(spark):
    df = spark.createDataFrame(ROWS, "g string, h string, v int")
    out = Query(df).select("g").aggregate("sum", "v", "total").group_by("g", "h").to_df()
    assert out.columns == ["g", "total"] and out.count() == 4
    with pytest.raises(Exception, match="v"):
        Query(df).select("v").aggregate("count", "*", "n").group_by("g").to_df()


def test_residuals_of_several_covariates(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = 1 + x @ [2, -3] + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = [r.residual for r in causes.residualise(df, "y", ["a", "b"]).orderBy("y").collect() if r.residual is not None]
    design = np.c_[np.ones(80), x]
    want = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert got == pytest.approx(want[np.argsort(y)].tolist())


def test_partial_links(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=200)
    a, b = z + rng.normal(size=200) * 0.3, z + rng.normal(size=200) * 0.3
    y = 2 * a + rng.normal(size=200)
    df = spark.createDataFrame([("k", *map(float, r), 1.0) for r in zip(y, a, b)], "k string, y double, a double, b double, c double")
    got = {r.cause: r for r in causes.partial_links(df, ["k"], "y", ["a", "b", "c"]).collect()}

    def rest(v, *xs):
        m = np.c_[np.ones(200), *xs]
        return v - m @ np.linalg.lstsq(m, v, rcond=None)[0]

    assert got["a"].partial == pytest.approx(np.corrcoef(rest(y, b), rest(a, b))[0, 1])
    assert got["b"].partial == pytest.approx(np.corrcoef(rest(y, a), rest(b, a))[0, 1])
    assert got["a"].r == pytest.approx(np.corrcoef(y, a)[0, 1]) and got["c"].r == got["c"].partial == 0


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, 5.0)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in regress.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "c"): 1.0}


def numbers(spark, n=60):
    r = random.Random(2)
    return spark.createDataFrame([(k, f"k{k % 7}", *[r.gauss(0, 1) for _ in range(4)]) for k in range(n)] + [(n, "k0", 50.0, 50.0, 50.0, 50.0)], "id int, g string, a double, b double, c double, d double")


def test_plans_do_not_grow_with_the_columns(spark):
    df = numbers(spark)
    columns = ["a", "b", "c", "d"]
    found = []
    for k in (1, 4):
        prepared = causes.prepare(df, ["id"], ["id"], columns, transforms=dict.fromkeys(columns[:k], "standard"))
        removed = clean.outliers(df, columns[:k], "zscore", "remove")
        scaled = clean.scale(df, columns[:k], "robust")
        found.append((scans(prepared), scans(removed), scans(scaled)))
    assert found[0] == found[1] and max(found[0]) <= 3
    assert scans(detect.modified_zscore(df, "a")) == 1


def test_outliers_by_order_of_columns(spark):
    df = numbers(spark)
    left = clean.outliers(df, ["a", "b", "c", "d"], "zscore", "remove")
    rows = df.toPandas()
    for c in "abcd":
        rows = rows[(rows[c] - rows[c].mean()).abs() <= 3 * rows[c].std(ddof=1)]
    assert sorted(r.id for r in left.collect()) == sorted(rows.id)
    q1, q3 = df.toPandas().a.quantile([0.25, 0.75])
    capped = clean.outliers(df, ["a"], "iqr", "cap").agg(F.max("a").alias("m")).first().m
    assert capped == pytest.approx(q3 + 1.5 * (q3 - q1))
    scaled = clean.scale(df, ["a"], "robust").where("id = 60").first().a_scaled
    assert scaled == pytest.approx((50 - df.toPandas().a.median()) / (q3 - q1))
    assert [r.id for r in detect.modified_zscore(df, "a").collect()] == [60] and 60 in {r.id for r in detect.iqr(df, "a").collect()}
    assert detect.iqr(df.where("false"), "a").collect() == [] and detect.modified_zscore(df.where("false"), "a").collect() == []


def test_asof_of_one_long_key(spark):
    r = random.Random(6)
    left = [("hot", r.randint(0, 5000), k) for k in range(1500)] + [("x", 5, -1), (None, 5, -2), ("hot", None, -3)]
    right = [("hot", r.randint(0, 5000), float(k)) for k in range(700)] + [("x", 6, 1.0), (None, 1, 9.0), ("hot", None, 2.0)]
    a, b = spark.createDataFrame(left, "k string, t int, id int").repartition(5), spark.createDataFrame(right, "k string, t int, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {q.id: q.v for q in joins.asof_join(a, b, ["k"], "t", ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(left)
    for k, t, i in left:
        known = [(s, v) for q, s, v in right if k is not None and q == k and t is not None and s is not None and s <= t]
        assert got[i] == (max(known)[1] if known else None)


def test_ranges_of_all_lengths(spark):
    r = random.Random(8)
    points = [(k, r.uniform(-1000, 1000)) for k in range(300)] + [(300, None)]
    ranges = [(k, lo, lo + r.choice([0.0, 0.5, 3, 40, 900, 1e7])) for k, lo in enumerate(r.uniform(-1000, 1000) for _ in range(80))] + [(80, 5.0, 4.0), (81, -1e9, 1e9)]
    p, q = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, low double, high double")
    joined = joins.range_join(p, q, "x", "low", "high", 1.0)
    assert joined.columns == ["p", "x", "r", "low", "high"]
    got = sorted((z.p, z.r) for z in joined.collect())
    assert got == sorted((a, b) for a, x in points for b, lo, hi in ranges if x is not None and lo <= x <= hi)
    assert joins.range_join(p, q.where("false"), "x", "low", "high", 1.0).collect() == []


def test_cards_and_targets(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "yes", "x", None, 3.0), ("2", "2024-02-01", "no", "", None, 3.0), ("3", "2024-03-01", "yes", "y", None, 3.0)], "n string, d string, b string, c string, e string, price double")
    got = {r.column: (r.type, r.missing, r.distinct) for r in windows.column_cards(df, df.columns).collect()}
    assert got == {"n": ("numeric", 0, 3), "d": ("datetime", 0, 3), "b": ("boolean", 0, 2), "c": ("categorical", 1, 2), "e": ("empty", 3, 0), "price": ("numeric", 0, 1)}
    assert [tuple(r)[:2] for r in windows.target_column(df, ["n", "price"]).collect()] == [("n", "deviation")]  # price does not vary
    varied = df.withColumn("price", F.col("n").cast("double"))
    assert [tuple(r)[:2] for r in windows.target_column(varied, ["n", "price"]).collect()] == [("price", "name")]
    assert windows.target_column(df, ["price"]).collect() == []


def test_catalog(spark, tmp_path):
    writers.create_dataset(spark, "kept_here", "it's a \\ test")
    try:
        assert spark.sql("DESCRIBE SCHEMA kept_here").where("info_name = 'Comment'").first().info_value == "it's a \\ test"
        df = spark.createDataFrame([(1, "a")], "id bigint, word string")
        writers.save_table(df, "kept_here.words")
        writers.save_table(df, "kept_here.words", "append")
        assert spark.table("kept_here.words").count() == 2
        writers.save_table(df, "kept_here.words", "truncate")
        assert spark.table("kept_here.words").count() == 1
        with pytest.raises(Exception, match="ALREADY_EXISTS"):
            writers.save_table(df, "kept_here.words")
        assert [tuple(r) for r in writers.list_tables(spark, "kept_here").collect()] == [("kept_here", "words")]
        assert [(r.name, r.type) for r in writers.table_columns(spark, "kept_here.words").collect()] == [("id", "bigint"), ("word", "string")]
    finally:
        writers.drop_dataset(spark, "kept_here", contents=True)
    assert not spark.catalog.databaseExists("kept_here")


def test_files_and_estimates(spark, tmp_path):
    for name in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / name).write_text("x\n1\n")
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.list_files(spark, str(tmp_path), "*.csv").collect()) == ["a.csv", "b.csv"]
    small, large = spark.range(10), spark.range(10_000_000)
    assert 0 < readers.estimate_bytes(small) < readers.estimate_bytes(large)


def test_texts_and_made_up_values(spark):
    row = spark.createDataFrame([("  Hello, World_1! ",)], "t string").select(text.normalize_text(F.col("t")).alias("t")).first()
    assert row.t == "hello world_1"
    df = spark.createDataFrame([(1, 2)], "o_ID int, Total int")
    assert quality.find_columns(df, "id$|key") == ["o_ID"]
    fits = {"email": r"user\d+@example\.com", "phone": r"\+1-555-\d{3}-\d{4}", "ssn": r"900-\d{2}-\d{4}", "name": r"Person \d+", "ip": r"10\.\d+\.\d+\.1"}
    made = spark.range(20).select(*[synthetic.fake_value(k, F.col("id")).rlike(f"^{p}$").alias(k) for k, p in fits.items()])
    assert all(all(r) for r in made.collect())
    once, again = (spark.range(5).select(synthetic.fake_value("email", F.col("id")).alias("e")).collect() for _ in range(2))
    assert once == again and len({r.e for r in once}) == 5


def test_a_database_is_read_in_ranges(spark):
    """Derby comes with Spark; a database in the memory of the JVM stands for any that speaks JDBC."""
    url = "jdbc:derby:memory:gneiss;create=true"
    rows = [(k, f"name {k}", k / 4, None if k % 5 else 1) for k in range(50)]
    spark.createDataFrame(rows, "id int, word string, price double, gap int").write.format("jdbc").options(url=url, dbtable="things").mode("overwrite").save()
    query = 'SELECT "id", "word", "price", "gap" FROM things WHERE "id" >= 10'
    whole = readers.read_jdbc(spark, url, query)
    assert whole.dtypes == [("id", "int"), ("word", "string"), ("price", "double"), ("gap", "int")]
    assert sorted(map(tuple, whole.collect()), key=lambda r: r[0]) == rows[10:]
    split = readers.read_jdbc(spark, url, query, split=("id", 20, 40, 4))
    assert split.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, split.collect()), key=lambda r: r[0]) == rows[10:]
    assert sorted(map(tuple, readers.read_jdbc(spark, url, query, split=("gap", 0, 9, 3)).collect()), key=lambda r: r[0]) == rows[10:]
    assert readers.read(spark, url, "jdbc", query="SELECT COUNT(*) AS n FROM things").first()[0] == 50


def test_questions_about_stored_results(spark):
    from gneiss.operators import report

    table = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.7)], "row int, score double")
    results = {"anomalies": (table, [F.desc("score")], 2), "size": (table.selectExpr("count(*) AS rows"), [], None)}
    asked = {"Any outliers?": "anomalies", "Please summarize": "overview", "What should I do?": "recommendations", "How many rows": "size", "What is the trend?": "forecast", "What drives it? The driver!": "causes", "missing cells": "quality", "key findings": "findings", "hello": None}
    assert {q: report.result_intent(q) for q in asked} == asked
    assert [r.row for r in report.ask_results(results, "Any outliers?").collect()] == [2, 3]
    assert report.ask_results(results, "how many rows?").first().rows == 3
    assert sorted(map(tuple, report.ask_results(results, "hello").collect())) == [("anomalies", "row,score"), ("size", "rows")]
    assert report.ask_results(results, "the forecast?").count() == 2
