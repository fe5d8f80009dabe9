"""Queries of saved models, model choice and Shapley values, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import models
from gneiss.plans.catalog import query
from gneiss.session import new_folder, read_table


@query("model_scored_orders", """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS rows FROM lineitem)
SELECT o_orderkey, round(a + b * sum(l_quantity), 2) AS prediction, 1 AS model_version FROM orders JOIN lineitem ON l_orderkey = o_orderkey, f GROUP BY o_orderkey, a, b""")
def model_scored_orders(spark, d):
    """A line fitted on lines, saved, and applied to the quantities of whole orders from file to file."""
    li = read_table(spark, d, "lineitem")
    folder = new_folder(spark, "models")
    models.save(spark, models.fit_linear(li, "l_extendedprice", ["l_quantity"]), folder, "price")
    li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("l_quantity")).join(read_table(spark, d, "orders").select("o_orderkey"), "o_orderkey").write.parquet(f"{folder}/rows")
    models.batch_predict(spark, folder, "price", f"{folder}/rows", f"{folder}/scored")
    return spark.read.parquet(f"{folder}/scored").select("o_orderkey", F.round("prediction", 2).alias("prediction"), "model_version")


@query("model_choice_lineitem", """WITH r AS (SELECT l_extendedprice AS y, l_quantity AS x, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS k, count(*) OVER () AS n FROM lineitem),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM r WHERE k < floor(n * 0.8)),
e AS (SELECT unnest([{'model': 'linear', 'p': a + b * x}, {'model': 'mean', 'p': m}], recursive := true), y FROM r, f WHERE k >= floor(n * 0.8)),
s AS (SELECT model, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, avg(abs(y - p)) AS mae FROM e GROUP BY 1)
SELECT model, round(r2, 6) AS r2, round(mae, 3) AS mae, CASE WHEN model = 'mean' THEN 'baseline' WHEN r2 > 0.7 THEN 'strong' WHEN r2 > 0.4 THEN 'acceptable' ELSE 'weak' END AS verdict, r2 = max(r2) OVER () AS chosen FROM s""")
def model_choice_lineitem(spark, d):
    r = models.choose_model(read_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_orderkey", "l_linenumber"])
    return r.withColumns({"r2": F.round("r2", 6), "mae": F.round("mae", 3)})


@query("shapley_part", """WITH s AS (SELECT covar_pop(p_retailprice, p_size) AS y1, covar_pop(p_retailprice, p_partkey) AS y2, var_pop(p_size) AS a, var_pop(p_partkey) AS b, covar_pop(p_size, p_partkey) AS c, avg(p_size) AS m1, avg(p_partkey) AS m2, avg(p_retailprice) AS base FROM part)
SELECT p_partkey, round((y1 * b - y2 * c) / (a * b - c * c) * (p_size - m1), 3) AS by_size, round((y2 * a - y1 * c) / (a * b - c * c) * (p_partkey - m2), 3) AS by_key, round(base, 3) AS base FROM part, s""")
def shapley_part(spark, d):
    """Against the mean row of the table as background."""
    p = read_table(spark, d, "part")
    model = models.fit_linear(p, "p_retailprice", ["p_size", "p_partkey"])
    told = models.shapley_values(p.select("p_partkey", "p_size"), model, p.agg(F.avg("p_size").alias("p_size"), F.avg("p_partkey").alias("p_partkey")))
    return told.select("p_partkey", F.round(F.col("shapley")[0], 3).alias("by_size"), F.round(F.col("shapley")[1], 3).alias("by_key"), F.round("base", 3).alias("base"))
