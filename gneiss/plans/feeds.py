"""Queries of paged sources, SQL functions and streams with callbacks, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import sql
from gneiss.plans import layers  # noqa: F401  (registers the oracle of the alert rules)
from gneiss.plans.catalog import ORACLES, query
from gneiss.plans.reference import _profile_sql
from gneiss.session import new_folder, read_table
from gneiss.sources import paged
from gneiss.streaming import alerts, delivery

_CUSTOMER = "c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment"


def _pages(spark, df, layout: str, **options: str) -> str:
    """A table as the pages of a response."""
    path = new_folder(spark, "pages")
    paged.write_pages(df, path, layout, **options)
    return path


@query("sheet_customer", f"SELECT {_CUSTOMER} FROM customer")
def sheet_customer(spark, d):
    path = _pages(spark, read_table(spark, d, "customer"), "values", rowsPerPage="500")
    return paged.read_sheet(spark, path)


@query("warehouse_part", "SELECT p_brand, count(*) AS n, min(p_size)::BIGINT AS least, round(sum(p_retailprice), 2) AS total, count_if(p_size > 25) AS large FROM part GROUP BY 1")
def warehouse_part(spark, d):
    part = read_table(spark, d, "part").withColumn("large", F.col("p_size") > 25)
    rows = paged.read_warehouse(spark, _pages(spark, part, "fields", rowsPerPage="500"))
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_size").alias("least"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.count_if("large").alias("large"))


@query("rest_order_lines", "SELECT l_orderkey AS okey, count(*) AS n, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def rest_order_lines(spark, d):
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("okey"))
    nested = lines.agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))).alias("lines"))
    rows = paged.read_rest(spark, _pages(spark, nested, "records", rows="data.orders", rowsPerPage="2000"), "data.orders")
    flat = rows.select("okey", F.explode("lines").alias("x")).select("okey", "x.*")
    return flat.groupBy("okey").agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("quantity"), F.count_distinct("part").alias("parts"))


@query("paged_links_orders", "SELECT 0 AS missing, count(*) AS rows FROM orders")
def paged_links_orders(spark, d):
    path = _pages(spark, read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "fields", rowsPerPage="3000")
    missing = paged.missing_pages(spark, path).agg(F.count("*").cast("int").alias("missing"))
    return missing.crossJoin(paged.read_warehouse(spark, path).agg(F.count("*").alias("rows")))  # a row each


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("sql_profile_lineitem", _profile_sql("lineitem", _NUM))
def sql_profile_lineitem(spark, d):
    read_table(spark, d, "lineitem").select(*_NUM, "l_returnflag").createOrReplaceTempView("gneiss_lines")
    r = sql.profile_table(spark, "gneiss_lines")
    return r.withColumns({c: F.round(c, 3) for c, kind in r.dtypes if kind == "double"})


@query("sql_sessions_events", """WITH g AS (SELECT user_id, event_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) > 43200000000, false)::INT AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, (sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM g""")
def sql_sessions_events(spark, d):
    sql.register(spark)
    read_table(spark, d, "events").select("user_id", "event_id", "ts").createOrReplaceTempView("gneiss_events")
    return spark.sql(
        "SELECT user_id, event_id, session FROM sessionize(TABLE(gneiss_events) PARTITION BY user_id ORDER BY (ts, event_id), time => 'ts', gap => 43200)"
    )


@query("sql_rules_customer", """WITH s AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS mean FROM customer GROUP BY ALL), t AS (SELECT c_mktsegment, avg(c_acctbal) AS whole FROM customer GROUP BY 1)
SELECT c_mktsegment, c_nationkey, round((mean - whole) / abs(whole), 6) AS change, CASE WHEN mean / 60 >= 90 THEN 'A' WHEN mean / 60 >= 80 THEN 'B' WHEN mean / 60 >= 70 THEN 'C' WHEN mean / 60 >= 60 THEN 'D' ELSE 'F' END AS grade FROM s JOIN t USING (c_mktsegment)""")
def sql_rules_customer(spark, d):
    sql.register(spark)
    read_table(spark, d, "customer").createOrReplaceTempView("gneiss_customer")
    return spark.sql("""WITH s AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS mean FROM gneiss_customer GROUP BY ALL), t AS (SELECT c_mktsegment, avg(c_acctbal) AS whole FROM gneiss_customer GROUP BY ALL)
    SELECT c_mktsegment, c_nationkey, round(percent_change(mean, whole), 6) AS change, grade_of(mean / 60) AS grade FROM s JOIN t USING (c_mktsegment)""")


@query("sql_slopes_orders", """WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL)
SELECT o_orderpriority, round(regr_slope(total, (year(month) * 12 + month(month))::DOUBLE), 3) AS slope FROM m GROUP BY 1""")
def sql_slopes_orders(spark, d):
    sql.register(spark)
    read_table(spark, d, "orders").createOrReplaceTempView("gneiss_orders")
    return spark.sql("""WITH m AS (SELECT o_orderpriority, year(o_orderdate) * 12 + month(o_orderdate) AS month, sum(o_totalprice) AS total FROM gneiss_orders GROUP BY ALL),
    s AS (SELECT o_orderpriority, series_slope(month, total) AS slope FROM m GROUP BY o_orderpriority)
    SELECT o_orderpriority, round(slope, 3) AS slope FROM s""")


def _timed_pages(spark, df, time: str) -> str:
    """A table as pages in the order of a time, as they would arrive."""
    return _pages(spark, df.repartitionByRange(time).sortWithinPartitions(time), "fields", rowsPerPage="4000")


@query("delivered_events", "SELECT event_id, user_id, round(2 * value, 4) AS doubled FROM events WHERE event_type = 'purchase'")
def delivered_events(spark, d):
    """Events as messages, every tenth twice, to a callback that keeps purchases."""
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("sent"))
    path = _timed_pages(spark, e.union(e.where("event_id % 10 = 0")), "sent")
    messages = paged.stream_pages(spark, path, "fields", pagesPerTrigger="3", mostTriggers="12").withColumn("at", F.to_timestamp("sent"))
    folder = new_folder(spark, "delivered")

    def callback(batch, batch_id):
        return batch.where("event_type = 'purchase'").select("event_id", "user_id", F.round(2 * F.col("value"), 4).alias("doubled"))

    delivery.pull(delivery.once(messages, ["event_id"], "at", "2 days"), callback, folder)
    return delivery.delivered(spark, folder, "event_id long, user_id long, doubled double").drop("batch")


@query("alerts_stream_orders", ORACLES["alert_rules_monthly"])
def alerts_stream_orders(spark, d):
    """The orders of the monthly series as a stream in the order of their dates."""
    o = read_table(spark, d, "orders").select("o_orderstatus", F.col("o_orderdate").cast("string").alias("day"), "o_totalprice")
    stream = paged.stream_pages(spark, _timed_pages(spark, o, "day"), "fields", pagesPerTrigger="4", mostTriggers="12").withColumn("at", F.to_timestamp("day"))
    folder = new_folder(spark, "alerts")
    found = alerts.alert_stream(stream, "o_orderstatus", "at", "o_totalprice", late="40 days")
    delivery.pull(found, lambda batch, n: batch, folder, "update")
    r = delivery.latest(delivery.delivered(spark, folder, ", ".join(f"`{c}` {k}" for c, k in found.dtypes)), ["o_orderstatus"])
    return r.withColumns({c: F.round(c, 5) for c in ("change", "last_z", "recent")} | {c: F.round(c, 2) for c in ("low", "high")})
