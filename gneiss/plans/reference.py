"""Queries over the driver tables for the engine's own operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.functions import stats
from gneiss.operators import clean, detect, graph, ml, profile, quality, regress, report, synthetic, text, timeseries
from gneiss.operators.relational import Query
from gneiss.plans.catalog import query
from gneiss.session import read_table
from gneiss.streaming import events as stream


def _profile_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", count(v)::BIGINT AS count, count_if(v IS NULL)::BIGINT AS nulls, count(DISTINCT v)::BIGINT AS "distinct",
      round(avg(v), 3) AS mean, round(median(v), 3) AS median, round(stddev_samp(v), 3) AS stdev, round(var_samp(v), 3) AS variance,
      round(min(v), 3) AS min, round(max(v), 3) AS max, round(max(v) - min(v), 3) AS "range",
      round(quantile_cont(v, 0.25), 3) AS q1, round(quantile_cont(v, 0.75), 3) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 3) AS iqr,
      round(CASE WHEN stddev_pop(v) > 0 THEN skewness(v) / (sqrt(count(v)::DOUBLE * (count(v) - 1)) / (count(v) - 2)) * count(v)::DOUBLE * count(v) / ((count(v) - 1)::DOUBLE * (count(v) - 2)) ELSE 0 END, 3) AS skewness,
      round(CASE WHEN stddev_pop(v) > 0 THEN (kurtosis_pop(v) + 3) * count(v)::DOUBLE * count(v) * (count(v) + 1) / ((count(v) - 1)::DOUBLE * (count(v) - 2) * (count(v) - 3)) - 3.0 * (count(v) - 1)::DOUBLE * (count(v) - 1) / ((count(v) - 2)::DOUBLE * (count(v) - 3)) ELSE 0 END, 3) AS kurtosis
    FROM (SELECT {c}::DOUBLE AS v FROM {t})"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_lineitem", _profile_sql("lineitem", _NUM))
def profile_lineitem(spark, d):
    return profile.numeric_profile(read_table(spark, d, "lineitem"), _NUM, digits=3)


@query("profile_orders", _profile_sql("orders", ["o_totalprice"]))
def profile_orders(spark, d):
    return profile.numeric_profile(read_table(spark, d, "orders"), ["o_totalprice"], digits=3)


def _long(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM {table}" for c in columns)


_CAT = ["l_returnflag", "l_linestatus"]


@query("top_values_lineitem", f"""
WITH c AS (SELECT "column", value, count(*) AS n FROM ({_long("lineitem", _CAT)}) WHERE value <> '' GROUP BY ALL)
SELECT "column", value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY "column"), 4)::DOUBLE AS pct, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value)::INTEGER AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 10""")
def top_values_lineitem(spark, d):
    return profile.top_values(read_table(spark, d, "lineitem"), _CAT)


@query("entropy_orders", f"""
WITH c AS (SELECT "column", value, count(*) AS n FROM ({_long("orders", ["o_orderstatus", "o_orderpriority"])}) GROUP BY ALL)
SELECT "column", count(*) AS "distinct", round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY "column")::DOUBLE AS t FROM c) GROUP BY "column\"""")
def entropy_orders(spark, d):
    return profile.column_entropy(read_table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def _gappy(df):
    return df.withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "price")


_GAPPY = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders)"


@query("missing_orders", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({c} IS NULL)::BIGINT AS missing, round(count_if({c} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS missing_pct, count_if({c} IS NULL) * 100.0 / count(*) > 50 AS critical FROM {_GAPPY}" for c in ["o_orderkey", "o_orderstatus", "price"]))
def missing_orders(spark, d):
    return profile.missing_values(_gappy(read_table(spark, d, "orders")), ["o_orderkey", "o_orderstatus", "price"])


@query("cardinality_part", f"""SELECT "column", count(*) AS "distinct", round(count(*) / sum(n)::DOUBLE, 6) AS ratio, count(*) = sum(n) AS is_key, count(*) < 20 AND count(*) / sum(n)::DOUBLE < 0.05 AS is_low
FROM (SELECT "column", value, count(*) AS n FROM ({_long("part", ["p_partkey", "p_brand", "p_type", "p_size"])}) GROUP BY ALL) GROUP BY "column\"""")
def cardinality_part(spark, d):
    return profile.cardinality(read_table(spark, d, "part"), ["p_partkey", "p_brand", "p_type", "p_size"])


@query("duplicates_part", """WITH r AS (SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 10 = 0), g AS (SELECT count(*) AS n FROM r GROUP BY p_partkey, p_name)
SELECT sum(n)::BIGINT AS rows, count_if(n > 1)::BIGINT AS groups, sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1) * 100.0 / sum(n), 4)::DOUBLE AS rate_pct FROM g""")
def duplicates_part(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name")
    return profile.duplicate_summary(p.union(p.where("p_partkey % 10 = 0")))


@query("schema_customer", """SELECT * FROM (VALUES ('c_custkey', 'numeric', 0::BIGINT), ('c_mktsegment', 'categorical', 0::BIGINT), ('balance', 'numeric', 0::BIGINT)) t("column", type, null_count)
JOIN (SELECT 'c_custkey' AS "column", count(DISTINCT c_custkey) AS unique_count FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'balance', count(DISTINCT CASE WHEN c_custkey % 8 = 0 THEN 'n/a' ELSE c_acctbal::VARCHAR END) FROM customer) USING ("column")""")
def schema_customer(spark, d):
    c = read_table(spark, d, "customer").withColumn("balance", F.when(F.col("c_custkey") % 8 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")))
    return profile.infer_schema(c, ["c_custkey", "c_mktsegment", "balance"])


@query("quality_orders", f"""WITH o AS (SELECT * FROM {_GAPPY}), g AS (SELECT count(*) AS n FROM o GROUP BY ALL), s AS (SELECT sum(n) AS rows, sum(n - 1) AS dup FROM (SELECT count(*) AS n FROM o GROUP BY o_orderkey, o_custkey, o_orderstatus, o_orderdate, price)),
m AS (SELECT count_if(price IS NULL) AS miss FROM o), f AS (SELECT rows, 100 - miss * 100.0 / (rows * 5) AS c, 100 - dup * 100.0 / rows AS u FROM s, m)
SELECT rows::BIGINT AS rows, round(c, 4)::DOUBLE AS completeness, round(u, 4)::DOUBLE AS uniqueness, round((c + u + 200) / 4, 1)::DOUBLE AS score, CASE WHEN (c + u + 200) / 4 >= 90 THEN 'A' ELSE 'B' END AS grade FROM f""")
def quality_orders(spark, d):
    return profile.quality_score(_gappy(read_table(spark, d, "orders")))


@query("text_lengths_part", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS avg, max(length({c}))::DOUBLE AS max, min(length({c}))::DOUBLE AS min, median(length({c})) AS median FROM part" for c in ["p_name", "p_type"]))
def text_lengths_part(spark, d):
    return profile.text_lengths(read_table(spark, d, "part"), ["p_name", "p_type"])


@query("histogram_price", """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem)
SELECT least(floor((l_extendedprice - lo) / w), 9)::INTEGER AS bin, round(lo + least(floor((l_extendedprice - lo) / w), 9) * w, 6) AS low, round(lo + (least(floor((l_extendedprice - lo) / w), 9) + 1) * w, 6) AS high, count(*) AS n FROM lineitem, e GROUP BY ALL""")
def histogram_price(spark, d):
    return profile.histogram(read_table(spark, d, "lineitem"), "l_extendedprice")


@query("box_price_by_flag", """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, min(v) AS min, max(CASE WHEN k = floor(n * 0.25) THEN v END) AS q1, max(CASE WHEN k = floor(n * 0.5) THEN v END) AS median, max(CASE WHEN k = floor(n * 0.75) THEN v END) AS q3, max(v) AS max FROM r GROUP BY 1""")
def box_price_by_flag(spark, d):
    return profile.box_stats(read_table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("pivot_status", """SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1""")
def pivot_status(spark, d):
    return profile.pivot_matrix(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.round(F.avg("l_quantity"), 6))


@query("relational_join_group", """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 200000 GROUP BY n_name HAVING count(*) > 3""")
def relational_join_group(spark, d):
    o, c, n = (read_table(spark, d, t) for t in ("orders", "customer", "nation"))
    q = Query(o).join(c, "o_custkey = c_custkey").join(n, "c_nationkey = n_nationkey").where_in("o_orderstatus", ["O", "F"]).where_between("o_totalprice", 1000, 200000)
    q = q.group_by("n_name").aggregate("count", "*", "orders").aggregate("sum", "o_totalprice", "total").having("orders > 3")
    return q.to_df().withColumn("total", F.round("total", 2))


for _how, _sql in {
    "left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey",
    "right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey",
    "full": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey",
    "left_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    "left_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
}.items():

    def _joined(spark, d, how=_how):
        c = read_table(spark, d, "customer")
        c = c.where("c_acctbal > 5000") if how in ("right", "full") else c
        q = Query(c).join(read_table(spark, d, "orders").where("o_totalprice > 150000"), "c_custkey = o_custkey", how)
        return q.select("c_custkey", *([] if "_" in how else ["o_orderkey"])).to_df()

    query(f"relational_{_how}_join", _sql)(_joined)


@query("relational_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def relational_cross_join(spark, d):
    return Query(read_table(spark, d, "region")).join(read_table(spark, d, "nation"), None, "cross").select("r_name", "n_name").to_df()


@query("relational_order_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def relational_order_offset(spark, d):
    return Query(read_table(spark, d, "orders")).select("o_orderkey", "o_totalprice").order_by("o_totalprice", True).order_by("o_orderkey").limit(20).offset(5).to_df()


@query("column_stats_supplier", "SELECT count(*) AS rows, count(s_acctbal) AS present, count(DISTINCT s_nationkey) AS nations, min(s_acctbal) AS low, max(s_acctbal) AS high, round(avg(s_acctbal), 6) AS mean, round(stddev_samp(s_acctbal), 6) AS deviation FROM supplier")
def column_stats_supplier(spark, d):
    q = Query(read_table(spark, d, "supplier")).aggregate("count", "*", "rows").aggregate("count", "s_acctbal", "present").aggregate("count_distinct", "s_nationkey", "nations")
    q = q.aggregate("min", "s_acctbal", "low").aggregate("max", "s_acctbal", "high").aggregate("avg", "s_acctbal", "mean").aggregate("stddev", "s_acctbal", "deviation")
    return q.to_df().withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("rollup_lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lineitem(spark, d):
    return read_table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("impute_median_orders", f"SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM {_GAPPY})), 6) AS price FROM {_GAPPY}")
def impute_median_orders(spark, d):
    return clean.impute(_gappy(read_table(spark, d, "orders")), ["price"]).select("o_orderkey", F.round("price", 6).alias("price"))


@query("impute_mode_orders", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS p FROM orders)
SELECT o_orderkey, coalesce(p, (SELECT p FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)) AS p FROM o""")
def impute_mode_orders(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("p"))
    return clean.impute(o, ["p"], "mode")


for _how, _sql in {
    "standard": "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()",
    "minmax": "(l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ())",
    "robust": "(l_quantity - median(l_quantity) OVER ()) / (quantile_cont(l_quantity, 0.75) OVER () - quantile_cont(l_quantity, 0.25) OVER ())",
}.items():

    def _scaled(spark, d, how=_how):
        rows = clean.scale(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], how)
        return rows.select("l_orderkey", "l_linenumber", F.round("l_quantity_scaled", 6).alias("scaled"))

    query(f"scale_{_how}", f"SELECT l_orderkey, l_linenumber, round({_sql}, 6) AS scaled FROM lineitem")(_scaled)


@query("outliers_cap_iqr", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT o_orderkey, round(greatest(least(o_totalprice, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS price FROM orders, q""")
def outliers_cap_iqr(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return clean.outliers(o, ["price"]).withColumn("price", F.round("price", 6))


@query("outliers_remove_z", """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS price FROM orders), s AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM o)
SELECT o_orderkey FROM o, s WHERE price BETWEEN m - 3 * s AND m + 3 * s""")
def outliers_remove_z(spark, d):
    o = read_table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice")))
    return clean.outliers(o, ["price"], "zscore", "remove").select("o_orderkey")


@query("dedupe_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedupe_keep_last(spark, d):
    return clean.deduplicate(read_table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "last")


@query("dedupe_keep_none", "SELECT min(o_custkey) AS o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def dedupe_keep_none(spark, d):
    return clean.deduplicate(read_table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "none")


@query("coercion_customer", """SELECT 'balance' AS "column", count(TRY_CAST(b AS DOUBLE)) AS converted, count_if(TRY_CAST(b AS DOUBLE) IS NULL)::BIGINT AS failed FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE c_acctbal::VARCHAR END AS b FROM customer)""")
def coercion_customer(spark, d):
    c = read_table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"))
    return clean.coercion_report(c, {"balance": "double"})


@query("date_parts_orders", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, (isodow(o_orderdate) - 1)::INTEGER AS dow, quarter(o_orderdate)::INTEGER AS q, isodow(o_orderdate) >= 6 AS weekend,
last_day(o_orderdate) = o_orderdate::DATE AS month_end, date_trunc('quarter', o_orderdate)::DATE = o_orderdate::DATE AS quarter_start FROM orders""")
def date_parts_orders(spark, d):
    p = clean.date_parts(read_table(spark, d, "orders"), "o_orderdate")
    c = {"y": "year", "m": "month", "dow": "dayofweek", "q": "quarter", "weekend": "is_weekend", "month_end": "is_month_end", "quarter_start": "is_quarter_start"}
    return p.select("o_orderkey", *[F.col(f"o_orderdate_{v}").alias(k) for k, v in c.items()])


@query("features_lineitem", "SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_tax, 0), 6) AS ratio, round(l_quantity * l_tax, 6) AS product FROM lineitem")
def features_lineitem(spark, d):
    r = clean.interactions(clean.ratios(read_table(spark, d, "lineitem"), ["l_quantity", "l_tax"]), ["l_quantity", "l_tax"])
    return r.select("l_orderkey", "l_linenumber", F.round("l_quantity_per_l_tax", 6).alias("ratio"), F.round("`l_quantity*l_tax`", 6).alias("product"))


@query("bins_quantile", """WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS e FROM part)
SELECT p_partkey, ((p_retailprice > e[1])::INTEGER + (p_retailprice > e[2])::INTEGER + (p_retailprice > e[3])::INTEGER)::INTEGER AS bin FROM part, q""")
def bins_quantile(spark, d):
    return clean.bucketize(read_table(spark, d, "part"), "p_retailprice", 4, "quantile").select("p_partkey", "bin")


@query("bins_uniform", """WITH q AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)
SELECT p_partkey, greatest(ceil((p_retailprice - a) / (b - a) * 4) - 1, 0)::INTEGER AS bin FROM part, q""")
def bins_uniform(spark, d):
    return clean.bucketize(read_table(spark, d, "part"), "p_retailprice", 4).select("p_partkey", "bin")


@query("encode_one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS f, (o_orderstatus = 'O')::INTEGER AS o, (o_orderstatus = 'P')::INTEGER AS p FROM orders")
def encode_one_hot(spark, d):
    r = clean.one_hot(read_table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"])
    return r.select("o_orderkey", *[F.col(f"o_orderstatus_{v}").alias(v.lower()) for v in "FOP"])


@query("encode_label", """WITH f AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey, code::INTEGER AS code FROM orders JOIN f USING (o_orderpriority)""")
def encode_label(spark, d):
    return clean.label_encode(read_table(spark, d, "orders"), "o_orderpriority", "o_orderkey", "code").select("o_orderkey", "code")


@query("encode_target", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS mean FROM orders")
def encode_target(spark, d):
    return clean.target_encode(read_table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "mean").select("o_orderkey", F.round("mean", 4).alias("mean"))


def _daily(spark, d):
    o = read_table(spark, d, "orders")
    return o.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))


_DAILY = "(SELECT o_orderstatus, o_orderdate::DATE AS day, sum(o_totalprice) AS total FROM orders GROUP BY ALL)"
_W = "OVER (PARTITION BY o_orderstatus ORDER BY day"


@query("moving_average_daily", f"SELECT o_orderstatus, day, round(avg(total) {_W} ROWS 6 PRECEDING), 4) AS ma FROM {_DAILY}")
def moving_average_daily(spark, d):
    return timeseries.moving_average(_daily(spark, d), ["o_orderstatus"], "day", "total").select("o_orderstatus", "day", F.round("moving_average", 4).alias("ma"))


@query("lags_daily", f"SELECT o_orderstatus, day, round(lag(total, 1) {_W}), 4) AS lag1, round(lag(total, 7) {_W}), 4) AS lag7 FROM {_DAILY}")
def lags_daily(spark, d):
    r = timeseries.lags(_daily(spark, d), ["o_orderstatus"], "day", "total", [1, 7])
    return r.select("o_orderstatus", "day", F.round("total_lag1", 4).alias("lag1"), F.round("total_lag7", 4).alias("lag7"))


@query("changes_daily", f"SELECT o_orderstatus, day, round(total - lag(total) {_W}), 4) AS diff, round((total - lag(total) {_W})) / abs(lag(total) {_W})) * 100, 4) AS pct FROM {_DAILY}")
def changes_daily(spark, d):
    r = timeseries.changes(_daily(spark, d), ["o_orderstatus"], "day", "total")
    return r.select("o_orderstatus", "day", F.round("diff", 4).alias("diff"), F.round("pct_change", 4).alias("pct"))


_HOLES = f"(SELECT o_orderstatus, day, CASE WHEN day(day) % 5 <> 0 THEN total END AS total FROM {_DAILY})"


@query("fill_forward_daily", f"SELECT o_orderstatus, day, round(last_value(total IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING), 4) AS filled FROM {_HOLES}")
def fill_forward_daily(spark, d):
    r = _daily(spark, d).withColumn("total", F.when(F.dayofmonth("day") % 5 != 0, F.col("total")))
    return timeseries.fill(r, ["o_orderstatus"], "day", "total").select("o_orderstatus", "day", F.round("filled", 4).alias("filled"))


@query("interpolate_daily", f"""WITH k AS (SELECT *, row_number() {_W}) AS k FROM {_HOLES}), n AS (SELECT *, CASE WHEN total IS NOT NULL THEN k END AS kk FROM k), e AS (
SELECT *, last_value(total IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS a, first_value(total IGNORE NULLS) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
last_value(kk IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS ka, first_value(kk IGNORE NULLS) {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM n)
SELECT o_orderstatus, day, round(CASE WHEN total IS NOT NULL THEN total WHEN kb IS NULL THEN a ELSE a + (b - a) / (kb - ka) * (k - ka) END, 4) AS filled FROM e""")
def interpolate_daily(spark, d):
    r = _daily(spark, d).withColumn("total", F.when(F.dayofmonth("day") % 5 != 0, F.col("total")))
    return timeseries.fill(r, ["o_orderstatus"], "day", "total", "interpolate").select("o_orderstatus", "day", F.round("filled", 4).alias("filled"))


_MONTHLY = "(SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS total FROM orders GROUP BY ALL)"


def _monthly(spark, d):
    o = read_table(spark, d, "orders")
    return o.groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"))


_EWMA = f"""k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) AS k FROM {_MONTHLY}),
e AS (SELECT o_orderstatus, month, total, k, total AS ewma FROM k WHERE k = 1 UNION ALL SELECT k.o_orderstatus, k.month, k.total, k.k, 0.3 * k.total + 0.7 * e.ewma FROM k JOIN e ON k.o_orderstatus = e.o_orderstatus AND k.k = e.k + 1)"""


@query("ewma_monthly", f"WITH RECURSIVE {_EWMA} SELECT o_orderstatus, month, round(ewma, 4) AS ewma FROM e")
def ewma_monthly(spark, d):
    return timeseries.ewma(_monthly(spark, d), ["o_orderstatus"], "month", "total").select("o_orderstatus", "month", F.round("ewma", 4).alias("ewma"))


@query("autocorrelation_monthly", f"""WITH r AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) AS t, total - avg(total) OVER (PARTITION BY o_orderstatus) AS d FROM {_MONTHLY})
SELECT a.o_orderstatus, (a.t - b.t)::INTEGER AS lag, round(sum(a.d * b.d) / any_value(c.c0), 6) AS acf FROM r a JOIN r b ON a.o_orderstatus = b.o_orderstatus AND a.t - b.t BETWEEN 0 AND 20
JOIN (SELECT o_orderstatus, sum(d * d) AS c0 FROM r GROUP BY 1) c ON a.o_orderstatus = c.o_orderstatus GROUP BY ALL""")
def autocorrelation_monthly(spark, d):
    return timeseries.autocorrelation(_monthly(spark, d), ["o_orderstatus"], "month", "total").withColumn("acf", F.round("acf", 6))


@query("seasonality_monthly")
def seasonality_monthly(spark, d):
    return timeseries.seasonality(timeseries.autocorrelation(_monthly(spark, d), ["o_orderstatus"], "month", "total", most=None), ["o_orderstatus"])


@query("unit_root_monthly", f"""WITH r AS (SELECT o_orderstatus, total - lag(total) OVER w AS dy, lag(total) OVER w AS y FROM {_MONTHLY} WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)), s AS (
SELECT o_orderstatus, count(*) AS n, regr_slope(dy, y) AS b, regr_syy(dy, y) AS syy, regr_sxy(dy, y) AS sxy FROM r WHERE dy IS NOT NULL GROUP BY 1)
SELECT o_orderstatus, round(b / sqrt((syy - b * sxy) / (n - 2)) * 1e6, 3) AS statistic_e6, abs(b / sqrt((syy - b * sxy) / (n - 2))) > 2.86 AS stationary FROM s""")
def unit_root_monthly(spark, d):
    r = timeseries.unit_root(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    return r.select("o_orderstatus", F.round(F.col("statistic") * 1e6, 3).alias("statistic_e6"), "stationary")


@query("holt_winters_monthly")
def holt_winters_monthly(spark, d):
    r = timeseries.holt_winters(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    return r.withColumns({c: F.round(c, 2) for c in ("forecast", "lower", "upper", "rmse")})


@query("ar1_monthly")
def ar1_monthly(spark, d):
    return timeseries.ar1_forecast(_monthly(spark, d), ["o_orderstatus"], "month", "total").withColumn("forecast", F.round("forecast", 2))


@query("drift_monthly", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month DESC) AS k FROM {_MONTHLY}), b AS (
SELECT o_orderstatus, avg(total) FILTER (k <= 7) AS flat, (arg_max(total, month) - arg_min(total, month)) / (count(*) - 1) AS drift FROM r GROUP BY 1)
SELECT o_orderstatus, s.step::INTEGER AS step, round(flat, 2) AS flat, round(flat + drift * s.step, 2) AS drifted FROM b, range(1, 7) s(step)""")
def drift_monthly(spark, d):
    r = timeseries.drift_forecast(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    return r.select("o_orderstatus", "step", F.round("flat", 2).alias("flat"), F.round("drifted", 2).alias("drifted"))


@query("linear_seasonal_monthly")
def linear_seasonal_monthly(spark, d):
    return timeseries.linear_seasonal_forecast(_monthly(spark, d), ["o_orderstatus"], "month", "total").withColumn("forecast", F.round("forecast", 2))


_SPIKED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS price FROM orders)"


def _spiked(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") * 10).otherwise(F.col("o_totalprice")).alias("price"))


@query("anomaly_zscore", f"WITH s AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM {_SPIKED}) SELECT o_orderkey, round((price - m) / s, 6) AS z FROM {_SPIKED}, s WHERE abs((price - m) / s) > 3")
def anomaly_zscore(spark, d):
    return detect.zscore(_spiked(spark, d), "price").select("o_orderkey", F.round("z", 6).alias("z"))


@query("anomaly_iqr", f"""WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM {_SPIKED})
SELECT o_orderkey, CASE WHEN price < a - 1.5 * (b - a) THEN 'low' ELSE 'high' END AS side FROM {_SPIKED}, q WHERE price NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def anomaly_iqr(spark, d):
    return detect.iqr(_spiked(spark, d), "price").select("o_orderkey", "side")


@query("anomaly_mad", f"""WITH m AS (SELECT median(price) AS m FROM {_SPIKED}), a AS (SELECT median(abs(price - m)) AS mad FROM {_SPIKED}, m)
SELECT o_orderkey, round(0.6745 * abs(price - m) / mad, 6) AS modified_z FROM {_SPIKED}, m, a WHERE 0.6745 * abs(price - m) / mad > 3.5""")
def anomaly_mad(spark, d):
    return detect.modified_zscore(_spiked(spark, d), "price").select("o_orderkey", F.round("modified_z", 6).alias("modified_z"))


@query("anomaly_ensemble", f"""WITH RECURSIVE {_EWMA}, q AS (SELECT o_orderstatus, count(*) AS n, avg(total) AS m, stddev_pop(total) AS s, quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b, stddev_samp(ewma) AS es FROM e GROUP BY 1),
f AS (SELECT e.o_orderstatus, month, abs(total - m) / s > 3 AS z_flag, total < a - 1.5 * (b - a) OR total > b + 1.5 * (b - a) AS iqr_flag, abs(total - ewma) > 3 * es AS ewma_flag FROM e JOIN q USING (o_orderstatus) WHERE n >= 4)
SELECT *, (z_flag::INTEGER + iqr_flag::INTEGER + ewma_flag::INTEGER)::INTEGER AS votes, CASE z_flag::INTEGER + iqr_flag::INTEGER + ewma_flag::INTEGER WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS severity FROM f WHERE z_flag OR iqr_flag OR ewma_flag""")
def anomaly_ensemble(spark, d):
    return detect.ensemble(_monthly(spark, d), ["o_orderstatus"], "month", "total").drop("total")


@query("spikes_daily", f"SELECT * FROM (SELECT o_orderstatus, day, round((total - lag(total) {_W})) / abs(lag(total) {_W})) * 100, 4) AS pct_change FROM {_DAILY}) WHERE abs(pct_change) > 50")
def spikes_daily(spark, d):
    return detect.spikes(_daily(spark, d), ["o_orderstatus"], "day", "total").select("o_orderstatus", "day", F.round("pct_change", 4).alias("pct_change"))


@query("fraud_events", """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), g AS (SELECT *, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events, s),
r AS (SELECT event_id, value > m + 3 * s AS a, hour(ts) < 6 OR hour(ts) > 22 AS b, coalesce(gap > 0 AND gap < 60000, false) AS c FROM g)
SELECT event_id, concat_ws(',', CASE WHEN a THEN 'high_amount' END, CASE WHEN b THEN 'off_hours' END, CASE WHEN c THEN 'rapid_succession' END) AS rules, ((a::INTEGER + b::INTEGER + c::INTEGER) * 30)::INTEGER AS risk_score FROM r WHERE a OR b OR c""")
def fraud_events(spark, d):
    return detect.fraud_rules(read_table(spark, d, "events"), "event_id", "value", "ts", ["user_id"])


_PAIRS = [(a, b) for n, a in enumerate(_NUM) for b in _NUM[n + 1 :]]


@query("correlation_lineitem", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, CASE WHEN abs(corr({a}, {b})) > 0.7 THEN 'strong' WHEN abs(corr({a}, {b})) > 0.4 THEN 'moderate' WHEN abs(corr({a}, {b})) > 0.3 THEN 'weak' ELSE 'none' END AS strength, abs(corr({a}, {b})) > 0.8 AS collinear FROM lineitem" for a, b in _PAIRS))
def correlation_lineitem(spark, d):
    return regress.correlation_matrix(read_table(spark, d, "lineitem"), _NUM)


@query("spearman_by_flag", """WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT g AS l_returnflag, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman_by_flag(spark, d):
    return regress.spearman(read_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


@query("ols_simple", """SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS std_error FROM lineitem""")
def ols_simple(spark, d):
    r = regress.simple_ols(read_table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return r.withColumns({c: F.round(c, 6 if c == "r2" else 4) for c in ("slope", "intercept", "r2", "std_error")})


@query("ols_multiple")
def ols_multiple(spark, d):
    r = regress.ols(read_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return r.withColumns({"coefficient": F.round("coefficient", 2), "r2": F.round("r2", 6)})


@query("linear_shap")
def linear_shap(spark, d):
    r = regress.linear_shap(read_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return r.withColumn("importance", F.round("importance", 2))


@query("welch_test_status", """WITH s AS (SELECT count(*) FILTER (o_orderstatus = 'O') AS n0, count(*) FILTER (o_orderstatus = 'F') AS n1, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS m0, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS m1,
var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS v0, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS v1 FROM orders)
SELECT round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) AS t, n0 + n1 - 2 AS df, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS cohen_d, CASE WHEN abs((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))) >= 0.8 THEN 'large'
WHEN abs((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))) >= 0.5 THEN 'medium' WHEN abs((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect FROM s""")
def welch_test_status(spark, d):
    r = regress.welch_test(read_table(spark, d, "orders"), "o_totalprice", "o_orderstatus", "O", "F")
    return r.select(F.round("t", 6).alias("t"), "df", F.round("cohen_d", 6).alias("cohen_d"), "effect")


@query("granger_monthly")
def granger_monthly(spark, d):
    o = read_table(spark, d, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"))
    return regress.granger(o, ["o_orderstatus"], "month", "n", "total").withColumn("f", F.round("f", 6))


@query("what_if_lineitem", " UNION ALL ".join(f"SELECT '{c}' AS cause, round(regr_slope(l_extendedprice, {c}) * avg({c}) * 0.1, 4) AS effect, round(regr_slope(l_extendedprice, {c}) * avg({c}) * 0.1 / avg(l_extendedprice) * 100, 6) AS effect_pct FROM lineitem" for c in ("l_quantity", "l_discount")))
def what_if_lineitem(spark, d):
    r = regress.what_if(read_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return r.select("cause", F.round("effect", 4).alias("effect"), F.round("effect_pct", 6).alias("effect_pct"))


@query("partial_correlations")
def partial_correlations(spark, d):
    return regress.partial_correlations(read_table(spark, d, "lineitem"), _NUM).withColumn("partial", F.round("partial", 5))


@query("sentiment_conversations")
def sentiment_conversations(spark, d):
    return text.sentiment(read_table(spark, d, "conversations"), "text", ["conv_id", "turn"])


_LIST = {"p": text.POSITIVE, "n": text.NEGATIVE}


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query("emotions_conversations", " UNION ALL ".join(f"SELECT '{e}' AS emotion, count_if(w IN {_in(ws)})::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM conversations)" for e, ws in text.EMOTIONS.items()))
def emotions_conversations(spark, d):
    return text.emotion_counts(read_table(spark, d, "conversations"), "text")


@query("keywords_parts", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '\\s+')) AS w FROM part) WHERE length(w) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def keywords_parts(spark, d):
    return text.keywords(read_table(spark, d, "part"), "p_name")


_PII = {k: text.PII_PATTERNS[k] for k in ("email", "ssn", "ip", "passport")}


@query("pii_documents", " UNION ALL ".join(f"SELECT 'text' AS \"column\", '{k}' AS kind, count_if(regexp_matches(text, '{p}'))::BIGINT AS matches, count(*) AS rows, count_if(regexp_matches(text, '{p}')) > 0.1 * count(*) AS found FROM documents" for k, p in _PII.items()))
def pii_documents(spark, d):
    return text.pii_matches(read_table(spark, d, "documents"), ["text"], _PII)


@query("pii_risk_documents")
def pii_risk_documents(spark, d):
    return text.pii_risk(text.pii_matches(read_table(spark, d, "documents"), ["text"]))


@query("mask_customer", "SELECT c_custkey, left(c_name, 1) || '***' AS masked FROM customer")
def mask_customer(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", text.mask(F.col("c_name"), "name").alias("masked"))


@query("text_features_part", r"""SELECT p_partkey, length(p_name)::BIGINT AS length, len(regexp_split_to_array(trim(p_name), '\s+'))::BIGINT AS word_count, len(regexp_extract_all(p_name, '[A-Z]'))::BIGINT AS upper, len(regexp_extract_all(p_name, '[a-z]'))::BIGINT AS lower,
len(regexp_extract_all(p_name, '[0-9]'))::BIGINT AS digit, len(regexp_extract_all(p_name, '[^A-Za-z0-9\s]'))::BIGINT AS special FROM part""")
def text_features_part(spark, d):
    return text.text_features(read_table(spark, d, "part"), "p_name", ["p_partkey"])


def _edges(spark, d):
    return graph.bipartite_edges(read_table(spark, d, "events"), "user_id", "event_type")


@query("graph_degrees", """WITH e AS (SELECT DISTINCT 'user_id:' || user_id AS s, 'event_type:' || event_type AS t FROM events) SELECT node, count(*) AS degree FROM (SELECT s AS node FROM e UNION ALL SELECT t FROM e) GROUP BY 1""")
def graph_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query("graph_density", """WITH e AS (SELECT DISTINCT user_id AS s, event_type AS t FROM events), c AS (SELECT count(DISTINCT s) + count(DISTINCT t) AS nodes, count(*) AS edges FROM e) SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 9)::DOUBLE AS density FROM c""")
def graph_density(spark, d):
    return graph.density(_edges(spark, d)).withColumn("density", F.round("density", 9))


@query("graph_distances", """WITH RECURSIVE e AS (SELECT DISTINCT 'user_id:' || user_id AS s, 'event_type:' || event_type AS t FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL), around AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
b(node, hops) USING KEY (node) AS (SELECT 'event_type:purchase', 0 UNION SELECT x.t, b.hops + 1 FROM b JOIN around x ON x.s = b.node WHERE x.t NOT IN (SELECT node FROM recurring.b))
SELECT node, hops FROM b""")
def graph_distances(spark, d):
    return graph.distances(_edges(spark, d), "event_type:purchase")


@query("graph_communities")
def graph_communities(spark, d):
    return graph.label_propagation(_edges(spark, d))


@query("value_share_segment", "SELECT coalesce(c_mktsegment, 'Unknown') AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_share_segment(spark, d):
    return report.value_share(read_table(spark, d, "customer"), "c_mktsegment")


@query("monthly_averages_orders", """SELECT month(o_orderdate)::INTEGER AS month, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n, abs(avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders)) > (SELECT abs(avg(o_totalprice)) FROM orders) * 0.15 AS seasonal FROM orders GROUP BY 1""")
def monthly_averages_orders(spark, d):
    return report.monthly_averages(read_table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("latest_change_events")
def latest_change_events(spark, d):
    days = read_table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return report.latest_change(days, "day", "total")


@query("benchmark_quality")
def benchmark_quality(spark, d):
    q = profile.quality_score(read_table(spark, d, "orders")).select(F.explode(F.array(F.struct(F.lit("data_quality_score").alias("metric"), F.col("score").alias("value")))).alias("x")).select("x.*")
    return report.compare_benchmarks(q, "general")


@query("question_orders", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS answer FROM orders GROUP BY 1")
def question_orders(spark, d):
    return report.ask(read_table(spark, d, "orders"), "What is the average o_totalprice by o_orderpriority?").withColumn("answer", F.round("answer", 4))


@query("insights_lineitem")
def insights_lineitem(spark, d):
    """Columns of lineitem of which some are made so that each rule has a case."""
    rows = read_table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_linenumber") < 3, F.col("l_tax")).alias("late_tax"),
        F.lit(1.0).alias("one"),
        F.when(F.col("l_orderkey") % 500 == 0, F.col("l_quantity") * 100).otherwise(F.col("l_quantity")).alias("spiked"),
    )
    columns = rows.columns
    r = report.insights(profile.numeric_profile(rows, columns), profile.missing_values(rows, columns), regress.correlation_matrix(rows, columns))
    return r.withColumn("detail", F.round("detail", 3))


@query("window_metrics_events", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL""")
def window_metrics_events(spark, d):
    r = stream.windowed_metrics(read_table(spark, d, "events"), "ts", "value", ["event_type"])
    return r.select("start", "event_type", "n", F.round("total", 4).alias("total"), "low", "high")


@query("event_metrics_users", "SELECT user_id, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at, count_if(event_type = 'error')::BIGINT AS errors, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def event_metrics_users(spark, d):
    r = stream.event_metrics(read_table(spark, d, "events"), "user_id", "event_type", "ts", "value")
    return r.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("decode_event_props", """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def decode_event_props(spark, d):
    return stream.decode_messages(read_table(spark, d, "events").select("event_id", F.col("props").alias("value")), "k bigint").select("event_id", "k")


@query("sessions_events")
def sessions_events(spark, d):
    return stream.sessions(read_table(spark, d, "events"), "ts", "user_id")


@query("kmeans_parts")
def kmeans_parts(spark, d):
    return ml.kmeans(read_table(spark, d, "part"), ["p_size", "p_retailprice"], 3).groupBy("cluster").agg(F.count("*").alias("n"))


@query("kmeans_elbow_parts")
def kmeans_elbow_parts(spark, d):
    return ml.kmeans_elbow(read_table(spark, d, "part"), ["p_size", "p_retailprice"])


@query("gaussian_mixture_parts")
def gaussian_mixture_parts(spark, d):
    return ml.gaussian_mixture(read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2).select("p_partkey", "component", "probability")


@query("pca_lineitem")
def pca_lineitem(spark, d):
    return ml.pca(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_NUM), _NUM).select("l_orderkey", "l_linenumber", "pc1", "pc2")


@query("dbscan_suppliers")
def dbscan_suppliers(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return ml.dbscan(s, "s_suppkey", ["x", "y"], eps=1.5, least=4)


@query("isolation_forest_orders")
def isolation_forest_orders(spark, d):
    return ml.isolation_forest(_spiked(spark, d), "o_orderkey", ["price"])


@query("sample_orders")
def sample_orders(spark, d):
    return clean.sample_rows(read_table(spark, d, "orders"), 5000, ["o_orderkey"]).select("o_orderkey")


@query("valid_share_orders", r"SELECT 'o_orderpriority' AS \"column\", 'priority' AS pattern, round(count_if(regexp_matches(o_orderpriority, '^[1-5]-')) * 100.0 / count(o_orderpriority), 4)::DOUBLE AS valid_pct FROM orders".replace("\\", ""))
def valid_share_orders(spark, d):
    return text.valid_share(read_table(spark, d, "orders"), ["o_orderpriority"], {"priority": "^[1-5]-"})


@query("top_mode_status", "SELECT o_orderstatus AS mode FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def top_mode_status(spark, d):
    return profile.top_values(read_table(spark, d, "orders"), ["o_orderstatus"], 1).select(F.col("value").alias("mode"))


@query("grades_customers", "SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 90 THEN 'A' WHEN c_acctbal / 100 >= 80 THEN 'B' WHEN c_acctbal / 100 >= 70 THEN 'C' WHEN c_acctbal / 100 >= 60 THEN 'D' ELSE 'F' END AS grade FROM customer")
def grades_customers(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", stats.grade(F.col("c_acctbal") / 100).alias("grade"))


@query("consistency_customer", """WITH c AS (SELECT CASE WHEN regexp_matches(b, '^-?[0-9]+$') THEN 'integer' WHEN regexp_matches(b, '^-?[0-9]+[.][0-9]+$') THEN 'float' ELSE 'text' END AS class, count(*) AS n
FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE c_acctbal::DECIMAL(18, 2)::VARCHAR END AS b FROM customer) GROUP BY 1)
SELECT 'balance' AS "column", arg_max(class, n) AS dominant, round(max(n) * 100.0 / sum(n), 4)::DOUBLE AS pct FROM c""")
def consistency_customer(spark, d):
    c = read_table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("balance"))
    return quality.consistency(c, ["balance"])


@query("accuracy_orders", f"""WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM {_SPIKED}), e AS (SELECT count_if(price < a - 3 * (b - a) OR price > b + 3 * (b - a)) AS x, count(price) AS n FROM {_SPIKED}, q)
SELECT 'price' AS "column", x::BIGINT AS extreme, round(greatest(0, 100 - 500.0 * x / n), 4)::DOUBLE AS score FROM e""")
def accuracy_orders(spark, d):
    return quality.accuracy(_spiked(spark, d), ["price"]).withColumn("score", F.round("score", 4))


@query("timeliness_events", "SELECT date_diff('day', max(ts)::DATE, DATE '2024-02-10')::INTEGER AS days, greatest(0, 100 - 0.5 * date_diff('day', max(ts)::DATE, DATE '2024-02-10'))::DOUBLE AS score FROM events")
def timeliness_events(spark, d):
    return quality.timeliness(read_table(spark, d, "events"), "ts", "2024-02-10")


@query("roles_part", """SELECT * FROM (VALUES ('p_partkey', 'identifier'), ('p_brand', 'grouping'), ('p_retailprice', 'feature')) t("column", role)""")
def roles_part(spark, d):
    p = read_table(spark, d, "part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")))
    cols = ["p_partkey", "p_brand", "p_retailprice"]
    return quality.suggest_roles(profile.infer_schema(p, cols).join(profile.cardinality(p, cols), "column"))


@query("cleaning_plan_orders", "SELECT * FROM (VALUES ('o_orderkey', 'keep'), ('price', 'impute')) t(\"column\", action)")
def cleaning_plan_orders(spark, d):
    return quality.cleaning_plan(profile.missing_values(_gappy(read_table(spark, d, "orders")), ["o_orderkey", "price"])).select("column", "action")


@query("quality_overall")
def quality_overall(spark, d):
    o = _gappy(read_table(spark, d, "orders"))
    parts = profile.quality_score(o).select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("double").alias("score")) for k in ("completeness", "uniqueness")])).alias("x")).select("x.*")
    more = quality.accuracy(o, ["price"]).select(F.lit("accuracy").alias("dimension"), "score")
    return quality.overall(parts.union(more)).withColumn("score", F.round("score", 4))


@query("sentiment_negated_conversations")
def sentiment_negated_conversations(spark, d):
    return text.sentiment_negated(read_table(spark, d, "conversations"), "text", ["conv_id", "turn"])


@query("series_summary_monthly", f"""SELECT o_orderstatus, count(total) AS points, round(min(total), 2) AS low, round(max(total), 2) AS high, round((arg_max(total, month) - arg_min(total, month)) / abs(arg_min(total, month)) * 100, 4) AS change_pct,
CASE WHEN arg_max(total, month) > arg_min(total, month) THEN 'up' WHEN arg_max(total, month) < arg_min(total, month) THEN 'down' ELSE 'flat' END AS direction, date_diff('day', min(month), max(month))::INTEGER AS days FROM {_MONTHLY} GROUP BY 1""")
def series_summary_monthly(spark, d):
    r = timeseries.series_summary(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    return r.select("o_orderstatus", "points", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("change_pct", 4).alias("change_pct"), "direction", "days")


@query("holdout_monthly", f"""WITH r AS (SELECT o_orderstatus, total AS y, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) AS t, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {_MONTHLY}),
f AS (SELECT o_orderstatus, avg(y) FILTER (t > floor(n * 0.8) - 7) AS flat, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM r WHERE t <= floor(n * 0.8) GROUP BY 1),
m AS (SELECT o_orderstatus, 'flat' AS model, y, flat AS p FROM r JOIN f USING (o_orderstatus) WHERE t > floor(n * 0.8) UNION ALL SELECT o_orderstatus, 'linear', y, a + b * t FROM r JOIN f USING (o_orderstatus) WHERE t > floor(n * 0.8))
SELECT o_orderstatus, model, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse, round(avg(abs((y - p) / nullif(y, 0))) * 100, 4) AS mape FROM m GROUP BY ALL""")
def holdout_monthly(spark, d):
    r = timeseries.holdout_errors(_monthly(spark, d), ["o_orderstatus"], "month", "total")
    return r.select("o_orderstatus", "model", F.round("rmse", 2).alias("rmse"), F.round("mape", 4).alias("mape"))


@query("permutation_importance")
def permutation_importance(spark, d):
    return regress.permutation_importance(read_table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])


@query("synthetic_orders")
def synthetic_orders(spark, d):
    o = read_table(spark, d, "orders")
    return synthetic.compare_numeric(o, synthetic.synthesize(o, ["o_totalprice"], ["o_orderstatus"], 5000), ["o_totalprice"])


@query("synthetic_overlap", """WITH a AS (SELECT o_orderstatus AS v, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS v, count(*) / sum(count(*)) OVER () AS q FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT round(sum(least(coalesce(p, 0), coalesce(q, 0))), 6)::DOUBLE AS overlap FROM a FULL JOIN b USING (v)""")
def synthetic_overlap(spark, d):
    o = read_table(spark, d, "orders")
    return synthetic.compare_categorical(o, o.where("o_orderkey % 3 = 0"), "o_orderstatus").withColumn("overlap", F.round("overlap", 6))


@query("sales_sample")
def sales_sample(spark, d):
    return synthetic.sales_sample(spark)
