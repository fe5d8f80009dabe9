"""Queries of whole-table assessments, compliance, row-wise outliers, causal pairs and products of columns, with their oracles."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from gneiss.operators import assess, findings, report
from gneiss.plans.catalog import query
from gneiss.plans.reference import _SPIKED, _spiked
from gneiss.session import read_table

#: Orders with gaps, copies and a column that is mostly empty.
_GAPS = """o AS (SELECT o_custkey % 50 AS cust, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price FROM orders)"""


def _gaps(spark, d):
    o, key = read_table(spark, d, "orders"), F.col("o_orderkey")
    return o.select((F.col("o_custkey") % 50).alias("cust"), F.col("o_orderstatus").alias("status"), F.when(key % 3 == 0, F.col("o_orderpriority")).alias("priority"), F.when(key % 9 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("price"))


_COUNTED = f"""{_GAPS}, c AS (SELECT count(*) AS rows, count_if(priority IS NULL) AS missing FROM o), k AS (SELECT count(*) AS kinds FROM (SELECT DISTINCT * FROM o)),
f AS (SELECT rows, 4 AS columns, rows * 4 AS cells, missing, rows - kinds AS duplicates FROM c, k)"""


@query("table_profile_nation", """WITH c AS (SELECT count(*) AS rows, sum(octet_length(encode(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR)))::BIGINT AS json_bytes FROM nation)
SELECT rows, 3 AS columns, rows * 3 AS cells, 0::BIGINT AS missing, 0::BIGINT AS duplicates, json_bytes, 100 AS quality FROM c""")
def table_profile_nation(spark, d):
    return assess.table_profile(read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("table_profile_orders", f"WITH {_COUNTED} SELECT rows, columns, cells, missing, duplicates, round(100 * (0.6 * (1 - missing / cells) + 0.4 * (1 - duplicates / rows)))::INTEGER AS quality FROM f")
def table_profile_orders(spark, d):
    return assess.table_profile(_gaps(spark, d)).drop("json_bytes")


@query("table_quality_orders", f"""WITH {_COUNTED}, s AS (SELECT 1 - missing / cells AS c, 1 - duplicates / rows AS u, 1 - CASE WHEN missing > rows * 0.5 THEN missing ELSE 0 END / cells AS v FROM f)
SELECT round(c, 6) AS completeness, round(u, 6) AS uniqueness, round(v, 6) AS validity, round(100 * (0.35 * c + 0.2 * u + 0.3 * v + 0.15))::INTEGER AS score FROM s""")
def table_quality_orders(spark, d):
    r = assess.table_quality(_gaps(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("completeness", "uniqueness", "validity")})


_SKEW = "skewness({c}) / (sqrt(count({c})::DOUBLE * (count({c}) - 1)) / (count({c}) - 2)) * count({c})::DOUBLE * count({c}) / ((count({c}) - 1)::DOUBLE * (count({c}) - 2))"


@query("quality_issues_orders", f"""WITH {_COUNTED}, k2 AS (SELECT {_SKEW.format(c="price")} AS price, {_SKEW.format(c="cust")} AS cust FROM o), u AS (SELECT count(DISTINCT status) AS s, count(DISTINCT priority) AS p FROM o)
SELECT CASE WHEN missing / cells > 0.2 THEN 'critical' ELSE 'warning' END AS severity, 'completeness' AS category, NULL::VARCHAR AS "column", round(missing / cells, 4) AS detail FROM f WHERE missing / cells > 0.05
UNION ALL SELECT CASE WHEN duplicates / rows > 0.1 THEN 'critical' ELSE 'warning' END, 'uniqueness', NULL, round(duplicates / rows, 4) FROM f WHERE duplicates > 0
UNION ALL SELECT 'critical', 'sparse_column', 'priority', round(missing / rows, 4) FROM f WHERE missing > 0.5 * rows
UNION ALL SELECT 'info', 'cardinality', 'status', s FROM u, f WHERE s > 0.95 * rows UNION ALL SELECT 'info', 'cardinality', 'priority', p FROM u, f WHERE p > 0.95 * rows
UNION ALL SELECT 'info', 'distribution', 'price', round(price, 4) FROM k2 WHERE abs(price) > 2 UNION ALL SELECT 'info', 'distribution', 'cust', round(cust, 4) FROM k2 WHERE abs(cust) > 2""")
def quality_issues_orders(spark, d):
    return assess.quality_issues(_gaps(spark, d)).withColumn("detail", F.round("detail", 4))


_UNIQUE = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query("uniqueness_orders", f"""WITH d AS (SELECT greatest(0, 100 - 200.0::DOUBLE * (count(*) - count(DISTINCT o_orderkey)) / count(*)) AS score FROM orders)
{" UNION ALL ".join(f"SELECT '{c}' AS " + '"column"' + f", count(DISTINCT {c}) AS " + '"distinct"' + f", count({c}) AS present, round(count(DISTINCT {c}) * 100.0::DOUBLE / count({c}), 6) AS cardinality_pct, count(DISTINCT {c}) = count({c}) AS is_key, count(DISTINCT {c}) * 100.0::DOUBLE / count({c}) < 5 AS is_low, score FROM orders, d GROUP BY score" for c in _UNIQUE)}""")
def uniqueness_orders(spark, d):
    return assess.uniqueness(read_table(spark, d, "orders"), _UNIQUE).withColumn("cardinality_pct", F.round("cardinality_pct", 6))


_MIXED = "(SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'none' WHEN o_orderkey % 11 = 0 THEN '1.5' ELSE o_custkey::VARCHAR END AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'soon' ELSE o_orderdate::DATE::VARCHAR END AS day, o_orderpriority AS word FROM orders)"


@query("validity_orders", f"""WITH m AS {_MIXED}, n AS (SELECT count_if(number = 'none') AS bad, count(*) AS all FROM m), w AS (SELECT count_if(day = 'soon') AS soon, count(*) AS all FROM m)
SELECT 'number' AS "column", 'integer' AS dominant, bad AS invalid, round((1 - bad / "all") * 100, 6) AS validity_pct, CASE WHEN 1 - bad / "all" < 0.7 THEN 'critical' WHEN 1 - bad / "all" < 0.95 THEN 'warning' ELSE 'good' END AS status FROM n
UNION ALL SELECT 'day', CASE WHEN soon > "all" - soon THEN 'text' ELSE 'date' END, CASE WHEN soon > "all" - soon THEN 0 ELSE soon END, round(CASE WHEN soon > "all" - soon THEN 100 ELSE (1 - soon / "all") * 100 END, 6), CASE WHEN soon > "all" - soon THEN 'good' WHEN 1 - soon / "all" < 0.7 THEN 'critical' ELSE 'warning' END FROM w
UNION ALL SELECT 'word', 'text', 0, 100, 'good'""")
def validity_orders(spark, d):
    key = F.col("o_orderkey")
    o = read_table(spark, d, "orders").select(
        F.when(key % 10 == 0, "none").when(key % 11 == 0, "1.5").otherwise(F.col("o_custkey").cast("string")).alias("number"), F.when(key % 2 == 0, "soon").otherwise(F.to_date("o_orderdate").cast("string")).alias("day"), F.col("o_orderpriority").alias("word")
    )
    return assess.validity(o, ["number", "day", "word"]).withColumn("validity_pct", F.round("validity_pct", 6))


def _personal(spark, d):
    o = read_table(spark, d, "orders")
    return findings.personal_columns(o.select(F.concat(F.lit("user"), "o_custkey", F.lit("@example.com")).alias("mail"), F.col("o_orderpriority").alias("full_name"), F.col("o_orderdate").alias("birth_date"), F.col("o_totalprice").alias("price")))


#: Two columns are found by their names, three by names and values.
_KINDS = r"""k AS (SELECT * FROM (VALUES ('mail', 'email', 15), ('full_name', 'name', 8), ('birth_date', 'date_of_birth', 15)) t(c, kind, w)
UNION ALL SELECT 'mail', 'email', 15 FROM orders HAVING count_if(regexp_matches('user' || o_custkey || '@example.com', '\w@\w+\.com')) > 0.3 * count(*) UNION ALL SELECT 'birth_date', 'date_of_birth', 15 FROM orders HAVING count_if(regexp_matches(o_orderdate::VARCHAR, '\d{4}-\d{2}-\d{2}')) > 0.3 * count(*))"""


@query("privacy_risk_orders", f"WITH {_KINDS} SELECT least(100, sum(w))::INTEGER AS score, CASE WHEN sum(w) > 70 THEN 'critical' WHEN sum(w) > 40 THEN 'high' WHEN sum(w) > 20 THEN 'medium' ELSE 'low' END AS level FROM k")
def privacy_risk_orders(spark, d):
    return assess.privacy_risk(_personal(spark, d))


@query("compliance_orders", f"""WITH {_KINDS}, h AS (SELECT count(*) AS n, string_agg(DISTINCT c, ',' ORDER BY c) AS c FROM k)
SELECT 'HIPAA' AS framework, n AS findings, CASE WHEN n > 2 THEN 'non_compliant' ELSE 'review_required' END AS status, c AS columns FROM h UNION ALL SELECT f, 0, 'compliant', '' FROM (VALUES ('GDPR'), ('CCPA'), ('PCI-DSS')) t(f)""")
def compliance_orders(spark, d):
    return assess.compliance(_personal(spark, d))


@query("row_anomalies_orders", f"""WITH v AS (SELECT o_orderkey, 'price' AS "column", price AS value FROM {_SPIKED}), s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM v), a AS (SELECT median(abs(value - q2)) AS mad FROM v, s),
t AS (SELECT v.*, abs(value - m) / sd / 2.5 AS z, CASE WHEN value < q1 - 1.8 * (q3 - q1) OR value > q3 + 1.8 * (q3 - q1) THEN abs(value - q2) / (q3 - q1) / 1.8 END AS i, 0.6745 * abs(value - q2) / mad / 2.5 AS z2 FROM v, s, a),
r AS (SELECT o_orderkey, "column", value, concat_ws(',', CASE WHEN z > 1 THEN 'z' END, CASE WHEN i IS NOT NULL THEN 'iqr' END, CASE WHEN z2 > 1 THEN 'mad' END) AS reasons, least(3, greatest(CASE WHEN z > 1 THEN z END, i, CASE WHEN z2 > 1 THEN z2 END)) AS score FROM t)
SELECT o_orderkey, "column", round(value, 2) AS value, reasons, round(score, 5) AS score, CASE WHEN score >= 2.5 THEN 'critical' WHEN score >= 1.8 THEN 'high' WHEN score >= 1.2 THEN 'medium' ELSE 'low' END AS severity FROM r WHERE reasons <> ''""")
def row_anomalies_orders(spark, d):
    r = assess.row_anomalies(_spiked(spark, d), ["o_orderkey"], ["price"])
    return r.withColumns({"value": F.round("value", 2), "score": F.round("score", 5)})


_CAUSAL = ["total", "n", "buyers"]


def _causal_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT o_orderstatus, month, '{a}' AS cause, '{b}' AS effect, {a} AS x, {b} AS y FROM m" for a, b in permutations(_CAUSAL, 2))
    sums = ", ".join(f"covar_pop({p}, {q}) * count(*) AS {p}{q}" for p, q in ("yy", "uu", "vv", "yu", "yv", "uv"))
    return f"""WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, sum(o_totalprice)::DOUBLE AS total, count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS buyers FROM orders GROUP BY ALL), p AS ({pairs}),
    l AS (SELECT *, lag(y) OVER w AS u, lag(x) OVER w AS v FROM p WINDOW w AS (PARTITION BY o_orderstatus, cause, effect ORDER BY month)),
    c AS (SELECT o_orderstatus, cause, effect, corr(x, y) AS r, count(*) AS n, regr_slope(y, x) AS slope FROM p GROUP BY ALL),
    s AS (SELECT o_orderstatus, cause, effect, count(*) AS k, {sums} FROM l WHERE u IS NOT NULL GROUP BY ALL),
    e AS (SELECT *, yy - yu * yu / uu AS alone, yy - yu * yu / uu - (yv * uu - yu * uv) * (yv * uu - yu * uv) / (uu * (uu * vv - uv * uv)) AS rest FROM s),
    g AS (SELECT *, (alone - rest) / (rest / (k - 3)) AS f, greatest((alone - rest) / alone * 100, 0) AS better FROM e),
    t AS (SELECT *, abs(r) * sqrt(n - 2) / sqrt(1 - r * r) AS t, abs(r) * CASE WHEN f > 3.84 THEN 1.2 ELSE 0.8 END AS confidence FROM c JOIN g USING (o_orderstatus, cause, effect))
    SELECT o_orderstatus, cause, effect, round(r, 6) AS r, CASE WHEN t > 4 THEN '<0.001' WHEN t > 3 THEN '<0.01' WHEN t > 2 THEN '<0.05' ELSE '>0.05' END AS p, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
    round(slope, 4) AS slope, round(r * r, 6) AS r2, round(f, 5) AS f, round(better, 5) AS improvement_pct, f > 3.84 AS causal, f > 4 AND better > 5 AS improves, round(confidence, 6) AS confidence FROM t WHERE abs(r) >= 0.3"""


@query("causal_pairs_monthly", _causal_sql())
def causal_pairs_monthly(spark, d):
    o = read_table(spark, d, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month"))
    m = o.agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("buyers"))
    r = assess.causal_pairs(m, ["o_orderstatus"], "month", _CAUSAL, most=None)
    return r.withColumns({c: F.round(c, k) for c, k in (("r", 6), ("slope", 4), ("r2", 6), ("f", 5), ("improvement_pct", 5), ("confidence", 6))})


@query("polynomial_part", """SELECT p_partkey, p_size * p_size::DOUBLE AS "p_size^2", round(p_size * p_retailprice, 4) AS "p_size*p_retailprice", round(p_retailprice * p_retailprice, 4) AS "p_retailprice^2" FROM part""")
def polynomial_part(spark, d):
    r = assess.polynomial_features(read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]).drop("p_size", "p_retailprice")
    return r.withColumns({c: F.round(f"`{c}`", 4) for c in r.columns if "p_retailprice" in c})


_HEAT = ["l_quantity", "l_extendedprice", "l_discount"]


@query("correlation_cells_lineitem", " UNION ALL ".join(f"""SELECT '{a}' AS "row", '{b}' AS "column", round(corr({a}, {b}), 6) AS r FROM lineitem""" for a in _HEAT for b in _HEAT if a != b) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in _HEAT))
def correlation_cells_lineitem(spark, d):
    return assess.correlation_cells(read_table(spark, d, "lineitem"), _HEAT)


@query("distribution_orders", """WITH n AS (SELECT 'n:' || o_orderpriority AS measure, count(*)::DOUBLE AS value FROM orders GROUP BY 1)
SELECT * FROM n UNION ALL SELECT 'distinct', count(DISTINCT o_orderpriority)::DOUBLE FROM orders""")
def distribution_orders(spark, d):
    return assess.distribution(read_table(spark, d, "orders"), "o_orderpriority")


def _stored(spark, d):
    o = _gaps(spark, d)
    return {
        "size": (assess.table_profile(o).select("rows", "columns", "quality"), [], None),
        "anomalies": (assess.row_anomalies(_spiked(spark, d), ["o_orderkey"], ["price"]), [F.desc("score"), F.desc("value"), F.asc("o_orderkey")], 5),
    }


@query("ask_size_orders", f"WITH {_COUNTED} SELECT rows, columns, round(100 * (0.6 * (1 - missing / cells) + 0.4 * (1 - duplicates / rows)))::INTEGER AS quality FROM f")
def ask_size_orders(spark, d):
    return report.ask_results(_stored(spark, d), "How many rows are there?")


@query("ask_anomalies_orders", f"""WITH s AS (SELECT avg(price) AS m, stddev_pop(price) AS sd, quantile_cont(price, 0.25) AS q1, median(price) AS q2, quantile_cont(price, 0.75) AS q3 FROM {_SPIKED}), a AS (SELECT median(abs(price - q2)) AS mad FROM {_SPIKED}, s),
t AS (SELECT o_orderkey, price, greatest(abs(price - m) / sd / 2.5, CASE WHEN price < q1 - 1.8 * (q3 - q1) OR price > q3 + 1.8 * (q3 - q1) THEN abs(price - q2) / (q3 - q1) / 1.8 END, 0.6745 * abs(price - q2) / mad / 2.5) AS score FROM {_SPIKED}, s, a)
SELECT o_orderkey, round(price, 2) AS value, round(least(3, score), 5) AS score FROM t WHERE score > 1 ORDER BY least(3, t.score) DESC, price DESC, o_orderkey LIMIT 5""")
def ask_anomalies_orders(spark, d):
    r = report.ask_results(_stored(spark, d), "Which values are unusual?")
    return r.select("o_orderkey", F.round("value", 2).alias("value"), F.round("score", 5).alias("score"))
