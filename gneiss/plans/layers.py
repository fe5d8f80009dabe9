"""Queries of ordered and range joins, residuals, causes and fitness, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import causes, joins, regress, timeseries
from gneiss.plans.catalog import query
from gneiss.plans.reference import _EWMA, _MONTHLY, _monthly
from gneiss.session import read_table
from gneiss.streaming import events


@query("asof_orders", """WITH r AS (SELECT o_custkey, o_orderdate, max(o_totalprice) AS paid FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), l AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, paid FROM l ASOF LEFT JOIN r ON l.o_custkey = r.o_custkey AND l.o_orderdate >= r.o_orderdate""")
def asof_orders(spark, d):
    o = read_table(spark, d, "orders")
    left = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate")
    right = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", F.col("o_totalprice").alias("paid"))
    return joins.asof_join(left, right, ["o_custkey"], "o_orderdate", ["paid"]).select("o_orderkey", "paid")


@query("range_join_accounts", """SELECT s_suppkey, c_custkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 25 AND s_acctbal + 25""")
def range_join_accounts(spark, d):
    points = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    ranges = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25).alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return joins.range_join(points, ranges, "c_acctbal", "low", "high", 50).select("s_suppkey", "c_custkey")


@query("contradictions_parts", """WITH b AS (SELECT p_brand, corr(p_retailprice, p_partkey) AS r, regr_slope(p_retailprice, p_size) AS slope FROM part GROUP BY 1)
SELECT p_brand, round(r, 6) AS r, round(slope, 6) AS slope FROM b WHERE r > 0 AND slope < 0""")
def contradictions_parts(spark, d):
    p = read_table(spark, d, "part").groupBy("p_brand")
    found = joins.contradictions(p.agg(stats.correlation(F.col("p_retailprice"), F.col("p_partkey")).alias("r")), p.agg(F.regr_slope("p_retailprice", "p_size").alias("slope")), "p_brand", "r", "slope", 0.0)
    return found.select("p_brand", F.round("r", 6).alias("r"), F.round("slope", 6).alias("slope"))


@query("residual_part", """WITH s AS (SELECT avg(p_retailprice) AS my, avg(p_size) AS mx, regr_slope(p_retailprice, p_size) AS b FROM part)
SELECT p_partkey, round(p_retailprice - my - b * (p_size - mx), 4) AS residual FROM part, s""")
def residual_part(spark, d):
    return causes.residualise(read_table(spark, d, "part"), "p_retailprice", "p_size").select("p_partkey", F.round("residual", 4).alias("residual"))


_LINKED = ["total", "n", "days"]
_MONTHS = "(SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total, count(*) AS n, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY ALL)"


@query("skeleton_monthly", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {_MONTHS}" for k, a in enumerate(_LINKED) for b in _LINKED[k + 1 :]) + ") WHERE abs(r) >= 0.3")
def skeleton_monthly(spark, d):
    m = read_table(spark, d, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "month"))
    return causes.skeleton(m.agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.count_distinct("o_orderdate").alias("days")), _LINKED)


_CAUSES = ("n", "buyers")
_SUMS = ", ".join(f"covar_pop({a}, {b}) * count(*) AS {a}{b}" for a, b in ("yy", "uu", "vv", "yu", "yv", "uv"))


@query("causes_monthly", f"""WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, sum(o_totalprice)::DOUBLE AS total, count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS buyers FROM orders GROUP BY ALL),
c AS (SELECT o_orderstatus, month, total, unnest([{{'cause': 'n', 'v': n}}, {{'cause': 'buyers', 'v': buyers}}], recursive := true) FROM m),
w AS (SELECT o_orderstatus, corr(total, n) AS tn, corr(total, buyers) AS tb, corr(n, buyers) AS nb FROM m GROUP BY 1),
p AS (SELECT o_orderstatus, 'n' AS cause, (tn - tb * nb) / sqrt((1 - tb * tb) * (1 - nb * nb)) AS r FROM w UNION ALL SELECT o_orderstatus, 'buyers', (tb - tn * nb) / sqrt((1 - tn * tn) * (1 - nb * nb)) FROM w),
l AS (SELECT o_orderstatus, cause, total AS y, lag(total) OVER w AS u, lag(v) OVER w AS v FROM c WINDOW w AS (PARTITION BY o_orderstatus, cause ORDER BY month)),
s AS (SELECT o_orderstatus, cause, count(*) AS k, {_SUMS} FROM l WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
e AS (SELECT *, uu * vv - uv * uv AS det FROM s), g AS (SELECT *, yy - (yu * vv - yv * uv) / det * yu - (yv * uu - yu * uv) / det * yv AS rest FROM e),
f AS (SELECT o_orderstatus, cause, CASE WHEN rest > 0 AND k >= 4 THEN ((yy - yu * yu / uu) - rest) / (rest / (k - 3)) ELSE 0 END AS f FROM g)
SELECT o_orderstatus, cause, round(0.6 * abs(r) + 0.4 * least(f / 20, 1), 5) AS score, rank() OVER (PARTITION BY o_orderstatus ORDER BY 0.6 * abs(r) + 0.4 * least(f / 20, 1) DESC)::INTEGER AS place FROM p JOIN f USING (o_orderstatus, cause)""")
def causes_monthly(spark, d):
    o = read_table(spark, d, "orders")
    m = o.groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").cast("double").alias("total"), F.count("*").cast("double").alias("n"), F.count_distinct("o_custkey").cast("double").alias("buyers"))
    cells = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(c).alias("v")) for c in _CAUSES])
    long = m.select("o_orderstatus", "month", "total", F.explode(cells).alias("x")).select("o_orderstatus", "month", "total", "x.*")
    keys = ["o_orderstatus", "cause"]
    f = regress.granger(long, keys, "month", "v", "total").select(*keys, "f")
    found = causes.partial_links(m, ["o_orderstatus"], "total", list(_CAUSES)).join(f, keys)
    return causes.rank_causes(found, "partial", "f", ["o_orderstatus"]).select(*keys, F.round("score", 5).alias("score"), "place")


@query("mean_deviations_monthly", f"""WITH RECURSIVE {_EWMA}, s AS (SELECT o_orderstatus, stddev_pop(total) AS spread FROM {_MONTHLY} GROUP BY 1)
SELECT o_orderstatus, month, round(abs(total - ewma) / spread, 6) AS score FROM e JOIN s USING (o_orderstatus) WHERE k > 1 AND abs(total - ewma) / spread > 1.5""")
def mean_deviations_monthly(spark, d):
    r = causes.mean_deviations(_monthly(spark, d), ["o_orderstatus"], "month", "total", threshold=1.5)
    return r.select("o_orderstatus", "month", F.round("score", 6).alias("score"))


@query("readiness_orders", """WITH o AS (SELECT o_custkey, o_orderstatus FROM orders), c AS (SELECT count(*) AS rows, count_if(o_custkey IS NULL) + count_if(o_orderstatus IS NULL OR o_orderstatus = '') AS missing FROM o),
k AS (SELECT count(*) AS kinds FROM (SELECT DISTINCT * FROM o)), s AS (SELECT rows, missing / (2.0 * rows) AS m, (rows - kinds)::DOUBLE / rows AS u FROM c, k)
SELECT rows, round(m, 6) AS missing_share, round(u, 6) AS duplicate_share, 100 - CASE WHEN m > 0.05 THEN 20 ELSE 0 END - CASE WHEN u > 0.05 THEN 10 ELSE 0 END - CASE WHEN rows < 30 THEN 30 ELSE 0 END AS readiness FROM s""")
def readiness_orders(spark, d):
    r = causes.readiness(read_table(spark, d, "orders").select("o_custkey", "o_orderstatus"))
    return r.select("rows", F.round("missing_share", 6).alias("missing_share"), F.round("duplicate_share", 6).alias("duplicate_share"), "readiness")


@query("prepare_orders", """WITH f AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
SELECT o_custkey, o_orderkey, round(ln(1 + price), 6) AS log_price FROM f""")
def prepare_orders(spark, d):
    o = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("log_price"))
    return causes.prepare(o, ["o_custkey"], ["o_orderkey"], ["log_price"], transforms={"log_price": "log1p"}).withColumn("log_price", F.round("log_price", 6))


@query("tail_orders", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def tail_orders(spark, d):
    return causes.tail(read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


@query("metric_series_events", """SELECT 'value' AS name, '{"type":"' || event_type || '","user":"' || user_id % 5 || '"}' AS tags, count(value) AS points, arg_min(value, ts) AS first, arg_max(value, ts) AS last, min(value) AS low, max(value) AS high
FROM events WHERE value IS NOT NULL GROUP BY event_type, user_id % 5""")
def metric_series_events(spark, d):
    tags = F.create_map(F.lit("user"), (F.col("user_id") % 5).cast("string"), F.lit("type"), F.col("event_type"))
    e = read_table(spark, d, "events").where("value is not null").select(F.lit("value").alias("name"), tags.alias("tags"), "ts", "value")
    return events.metric_series(e, "name", "tags", "ts", "value")


@query("select_events_last", "SELECT event_id FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC LIMIT 50")
def select_events_last(spark, d):
    return events.select_events(read_table(spark, d, "events"), "ts", {"event_type": "error"}, "2024-01-03", "2024-01-20", 50).select("event_id")


@query("holdout_fit_lineitem", """WITH t AS (SELECT avg(l_extendedprice) AS m, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem WHERE l_orderkey % 5 <> 4),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p, m FROM lineitem, t WHERE l_orderkey % 5 = 4),
s AS (SELECT count(*) AS n, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae, avg(abs(y - m)) AS baseline_mae FROM p)
SELECT n, round(r2, 6) AS r2, round(mae, 3) AS mae, round(baseline_mae, 3) AS baseline_mae, CASE WHEN mae < baseline_mae THEN 'line' ELSE 'mean' END AS chosen FROM s""")
def holdout_fit_lineitem(spark, d):
    r = causes.holdout_fit(read_table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", F.col("l_orderkey") % 5 == 4)
    return r.withColumns({"r2": F.round("r2", 6), "mae": F.round("mae", 3), "baseline_mae": F.round("baseline_mae", 3)})


@query("alert_rules_monthly", f"""WITH k AS (SELECT o_orderstatus, total AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month DESC) AS k FROM {_MONTHLY}),
s AS (SELECT o_orderstatus, max(v) FILTER (k = 1) AS v1, max(v) FILTER (k = 2) AS v2, avg(v) FILTER (k <= 3) AS late, avg(v) FILTER (k BETWEEN 4 AND 6) AS early, avg(v) AS m, stddev_pop(v) AS sd FROM k GROUP BY 1),
c AS (SELECT *, (v1 - v2) / abs(v2) AS change, abs(v1 - m) / sd AS z, (late - early) / abs(early) AS recent FROM s)
SELECT o_orderstatus, round(change, 5) AS change, round(z, 5) AS last_z, round(recent, 5) AS recent, round(m - 2 * sd, 2) AS low, round(m + 2 * sd, 2) AS high, change < -0.15 AS "drop", change > 0.25 AS spike, z > 2.5 AS outlier, abs(recent) > 0.2 AS shift FROM c""")
def alert_rules_monthly(spark, d):
    r = causes.alert_rules(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    return r.withColumns({c: F.round(c, 5) for c in ("change", "last_z", "recent")} | {c: F.round(c, 2) for c in ("low", "high")})


@query("blend_monthly", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month DESC) AS k FROM {_MONTHLY}),
b AS (SELECT o_orderstatus, avg(total) FILTER (k <= 7) AS flat, (arg_max(total, month) - arg_min(total, month)) / (count(*) - 1) AS drift FROM r GROUP BY 1)
SELECT o_orderstatus, s.step::INTEGER AS step, round((0.3 * flat + 0.2 * (flat + drift * s.step)) / 0.5, 2) AS forecast FROM b, range(1, 7) s(step)""")
def blend_monthly(spark, d):
    r = timeseries.drift_forecast(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    mixed = causes.blend({"flat": F.col("flat"), "drifted": F.col("drifted")}, {"flat": 0.3, "drifted": 0.2})
    return r.select("o_orderstatus", "step", F.round(mixed, 2).alias("forecast"))
