"""Queries of set operations, grouping sets, ranking windows, resampling and series measures, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import vectors
from gneiss.operators import timeseries, windows
from gneiss.operators.relational import Query
from gneiss.plans.catalog import query
from gneiss.plans.reference import _MONTHLY, _monthly
from gneiss.session import read_table

_SETS = {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "except": "EXCEPT"}


def _set_query(how: str, word: str) -> None:
    @query(f"relational_{how}", f"SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 {word} SELECT s_nationkey FROM supplier")
    def run(spark, d):
        left = Query(read_table(spark, d, "customer")).select_as("c_nationkey", "nation").where("c_acctbal > 5000")
        right = Query(read_table(spark, d, "supplier")).select_as("s_nationkey", "nation")
        made = {"union": left.union, "union_all": lambda o: left.union(o, distinct=False), "intersect": left.intersect, "except": left.difference}
        return made[how](right).to_df()


for _how, _word in _SETS.items():
    _set_query(_how, _word)


def _grouped(name: str, clause: str, build) -> None:
    @query(f"relational_{name}", f"SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY {clause}")
    def run(spark, d):
        q = build(Query(read_table(spark, d, "lineitem"))).aggregate("count", "*", "n").aggregate("sum", "l_quantity", "quantity")
        return q.to_df().select("l_returnflag", "l_linestatus", "n", F.round("quantity", 2).alias("quantity"))


_grouped("cube", "CUBE (l_returnflag, l_linestatus)", lambda q: q.cube("l_returnflag", "l_linestatus"))
_grouped("rollup", "ROLLUP (l_returnflag, l_linestatus)", lambda q: q.rollup("l_returnflag", "l_linestatus"))
_grouped("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())", lambda q: q.grouping_sets([["l_returnflag"], ["l_linestatus"], []]))


@query("relational_or_prefix", "SELECT p_partkey FROM part WHERE (p_size > 45 OR p_retailprice < 950) AND starts_with(p_brand, 'Brand#1') AND contains(p_name, 'a')")
def relational_or_prefix(spark, d):
    q = Query(read_table(spark, d, "part")).select("p_partkey").where_any("p_size > 45", "p_retailprice < 950")
    return q.where_prefix("p_brand", "Brand#1").where_contains("p_name", "a").to_df()


@query("ranks_customer", """SELECT c_custkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER w AS ntile, round(percent_rank() OVER w, 6) AS percent_rank,
round(cume_dist() OVER w, 6) AS cume_dist, nth_value(c_custkey, 2) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth_value
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)""")
def ranks_customer(spark, d):
    r = windows.ranks(read_table(spark, d, "customer"), ["c_mktsegment"], "c_custkey")
    return r.select("c_custkey", "rank", "dense_rank", "ntile", F.round("percent_rank", 6).alias("percent_rank"), F.round("cume_dist", 6).alias("cume_dist"), "nth_value")


@query("range_sum_part", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS near FROM part")
def range_sum_part(spark, d):
    return windows.range_sum(read_table(spark, d, "part"), ["p_brand"], "p_size", "p_size", 5, 2, "near").select("p_partkey", "near")


@query("rolling_daily", """WITH d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS mean FROM orders GROUP BY ALL),
c AS (SELECT o_orderpriority, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
f AS (SELECT c.o_orderpriority, c.day, d.mean FROM c LEFT JOIN d USING (o_orderpriority, day))
SELECT o_orderpriority, day, round(CASE WHEN count(mean) OVER w = 7 THEN avg(mean) OVER w END, 3) AS rolling_mean, round(CASE WHEN count(mean) OVER w = 7 THEN stddev_samp(mean) OVER w END, 3) AS rolling_std
FROM f WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_daily(spark, d):
    r = windows.daily_rolling(read_table(spark, d, "orders"), ["o_orderpriority"], "o_orderdate", "o_totalprice")
    return r.select("o_orderpriority", "day", F.round("rolling_mean", 3).alias("rolling_mean"), F.round("rolling_std", 3).alias("rolling_std"))


@query("volatility_monthly", f"""WITH r AS (SELECT o_orderstatus, total / lag(total) OVER (PARTITION BY o_orderstatus ORDER BY month) - 1 AS r FROM {_MONTHLY})
SELECT o_orderstatus, round(sqrt(avg(r * r)) * sqrt(252), 6) AS volatility FROM r GROUP BY 1""")
def volatility_monthly(spark, d):
    return windows.volatility(_monthly(spark, d), ["o_orderstatus"], "month", "total").withColumn("volatility", F.round("volatility", 6))


_HALVES = f"""WITH k AS (SELECT o_orderstatus, total, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {_MONTHLY}),
h AS (SELECT o_orderstatus, avg(total) FILTER (k <= floor(n / 2)) AS early, avg(total) FILTER (k > floor(n / 2)) AS late FROM k GROUP BY 1)"""


@query("trend_direction_monthly", _HALVES + " SELECT o_orderstatus, CASE WHEN (late - early) / abs(early) > 0.1 THEN 'up' WHEN (late - early) / abs(early) < -0.1 THEN 'down' ELSE 'stable' END AS direction FROM h")
def trend_direction_monthly(spark, d):
    return windows.trend_direction(_monthly(spark, d), ["o_orderstatus"], "month", "total").select("o_orderstatus", "direction")


@query("regime_changes_monthly", f"""WITH s AS (SELECT o_orderstatus, month, abs(total - lag(total) OVER w) / greatest(abs(lag(total) OVER w), 0.001) AS s FROM {_MONTHLY} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month))
SELECT o_orderstatus, month, round(s, 6) AS step_share FROM s WHERE s > 0.3""")
def regime_changes_monthly(spark, d):
    r = windows.regime_changes(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    return r.select("o_orderstatus", "month", F.round("step_share", 6).alias("step_share"))


@query("alerts_monthly", f"""WITH e AS (SELECT o_orderstatus, arg_min(total, month) AS a, arg_max(total, month) AS b FROM {_MONTHLY} GROUP BY 1)
SELECT o_orderstatus, round(b / a - 1, 6) AS change, abs(b / a - 1) > 0.2 AS alert FROM e""")
def alerts_monthly(spark, d):
    return windows.alerts(_monthly(spark, d), ["o_orderstatus"], "month", "total").select("o_orderstatus", F.round("change", 6).alias("change"), "alert")


@query("percentile_band_customers", "SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 90 WHEN c_acctbal >= 7000 THEN 75 WHEN c_acctbal >= 4500 THEN 50 WHEN c_acctbal >= 1500 THEN 25 ELSE 0 END AS band FROM customer")
def percentile_band_customers(spark, d):
    band = windows.percentile_band(F.col("c_acctbal"), {25: 1500, 50: 4500, 75: 7000, 90: 9000})
    return read_table(spark, d, "customer").select("c_custkey", band.alias("band"))


_CARDS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("column_cards_orders", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(TRY_CAST({c}::VARCHAR AS DOUBLE)) > 0.85 * count({c}) THEN 'numeric' WHEN count(TRY_CAST({c}::VARCHAR AS DATE)) > 0.7 * count({c}) THEN 'datetime' ELSE 'categorical' END AS type, count(*) AS rows, count_if({c} IS NULL OR {c}::VARCHAR = '') AS missing, count_if({c} IS NULL OR {c}::VARCHAR = '') * 100.0 / count(*) AS missing_pct, count(DISTINCT {c}) AS "distinct" FROM orders""" for c in _CARDS))
def column_cards_orders(spark, d):
    return windows.column_cards(read_table(spark, d, "orders"), _CARDS)


@query("group_variance_orders", """WITH p AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS ss FROM orders GROUP BY 1)
SELECT count(*) AS k, sum(n)::BIGINT AS n, round(((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 4) AS f FROM p""")
def group_variance_orders(spark, d):
    return windows.group_variance(read_table(spark, d, "orders"), "o_orderpriority", "o_totalprice").withColumn("f", F.round("f", 4))


@query("target_column_lineitem", """WITH d AS (SELECT unnest([{'column': 'l_quantity', 's': stddev_samp(l_quantity)}, {'column': 'l_extendedprice', 's': stddev_samp(l_extendedprice)}, {'column': 'l_discount', 's': stddev_samp(l_discount)}], recursive := true) FROM lineitem)
SELECT "column", 'name' AS reason, round(s, 4) AS deviation FROM d WHERE "column" LIKE '%price%' AND s > 0""")
def target_column_lineitem(spark, d):
    r = windows.target_column(read_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return r.withColumn("deviation", F.round("deviation", 4))


@query("target_column_widest", """WITH d AS (SELECT unnest([{'column': 'l_quantity', 's': stddev_samp(l_quantity)}, {'column': 'l_tax', 's': stddev_samp(l_tax)}, {'column': 'l_discount', 's': stddev_samp(l_discount)}], recursive := true) FROM lineitem)
SELECT arg_max("column", s) AS "column", 'deviation' AS reason, round(max(s), 4) AS deviation FROM d""")
def target_column_widest(spark, d):
    r = windows.target_column(read_table(spark, d, "lineitem"), ["l_tax", "l_quantity", "l_discount"])
    return r.withColumn("deviation", F.round("deviation", 4))


@query("vector_products", """WITH o AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT label, arg_min(e, vec_id) AS g FROM o GROUP BY 1)
SELECT vec_id, round(list_dot_product(e, g), 6) AS dot, round(list_distance(e, g), 6) AS distance, round(list_dot_product(e, g) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(g, g))), 6) AS cosine FROM o JOIN f USING (label)""")
def vector_products(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    first = e.groupBy("label").agg(F.min_by("e", "vec_id").alias("g"))
    made = {"dot": vectors.dot, "distance": vectors.euclidean, "cosine": vectors.cosine}
    return e.join(first, "label").select("vec_id", *[F.round(f(F.col("e"), F.col("g")), 6).alias(name) for name, f in made.items()])


@query("criteria_lineitem", """WITH s AS (SELECT count(*)::DOUBLE AS n, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS rss FROM lineitem)
SELECT round(n * ln(rss / n) + 4, 3) AS aic, round(n * ln(rss / n) + 2 * ln(n), 3) AS bic FROM s""")
def criteria_lineitem(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    s = read_table(spark, d, "lineitem").agg(F.count("*").cast("double").alias("n"), (F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)).alias("rss"))
    return s.select(F.round(vectors.aic(F.col("n"), F.col("rss"), 2), 3).alias("aic"), F.round(vectors.bic(F.col("n"), F.col("rss"), 2), 3).alias("bic"))


def _holt_winters_sql(variant: str) -> str:
    """Additive Holt-Winters as a recursion over the rows of each series (period 12, six steps)."""
    updated = variant == "updated"
    level = "first12" if updated else "y[1]"
    trend = "(next12 - first12) / 12" if updated else "first12 - y[1]"
    spread = "sqrt(avg((v - f) * (v - f)))" if updated else "stddev_samp(v - f)"
    season = "0.3 * (v - nl) + 0.7 * s" if updated else "s"
    return f"""WITH RECURSIVE y AS (SELECT o_orderstatus, list(total ORDER BY month) AS y FROM {_MONTHLY} GROUP BY 1),
b AS (SELECT *, list_avg(y[1:12]) AS first12, list_avg(y[13:24]) AS next12 FROM y),
r(o_orderstatus, y, t, level, trend, seasons, v, f) AS (
  SELECT o_orderstatus, y, 0, {level}, {trend}, list_transform(y[1:12], lambda x: x - first12), NULL::DOUBLE, NULL::DOUBLE FROM b
  UNION ALL
  SELECT o_orderstatus, y, t + 1, nl, 0.1 * (nl - level) + 0.9 * trend,
    list_concat(seasons[2:12], [0.3 * (v - nl) + 0.7 * s]), v, level + trend + ({season})
  FROM (SELECT o_orderstatus, y, t, level, trend, seasons, y[t + 1] AS v, seasons[1] AS s, 0.2 * (y[t + 1] - seasons[1]) + 0.8 * (level + trend) AS nl FROM r WHERE t < len(y))
), e AS (SELECT o_orderstatus, {spread} AS spread, sqrt(avg((v - f) * (v - f))) AS rmse, arg_max(level, t) AS level, arg_max(trend, t) AS trend, arg_max(seasons, t) AS seasons FROM r WHERE t > 0 GROUP BY 1)
SELECT o_orderstatus, CAST(k AS INTEGER) AS step, round(level + k * trend + seasons[k], 2) AS forecast, round(level + k * trend + seasons[k] - 1.96 * spread * sqrt(k), 2) AS lower,
  round(level + k * trend + seasons[k] + 1.96 * spread * sqrt(k), 2) AS upper, round(rmse, 2) AS rmse FROM e, generate_series(1, 6) AS g(k)"""


def _holt_winters_query(variant: str) -> None:
    @query(f"holt_winters_{variant}", _holt_winters_sql(variant))
    def run(spark, d):
        r = timeseries.holt_winters(_monthly(spark, d), ["o_orderstatus"], "month", "total", variant=variant)
        return r.withColumns({c: F.round(c, 2) for c in ("forecast", "lower", "upper", "rmse")})


for _variant in ("updated", "plain"):
    _holt_winters_query(_variant)
