"""Oracles of queries whose SQL is longer than the query: recursions, determinants, text rules."""

from __future__ import annotations

from itertools import combinations

from gneiss.operators import quality, text
from gneiss.plans.ahead import _DRIFT
from gneiss.plans.catalog import ORACLES
from gneiss.plans.more import _holt_winters_sql
from gneiss.plans.reference import _GAPPY, _MONTHLY, _NUM, _in

ORACLES["holt_winters_monthly"] = _holt_winters_sql("updated")

ORACLES["seasonality_monthly"] = f"""WITH m AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY month) AS t, total - avg(total) OVER (PARTITION BY o_orderstatus) AS d, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {_MONTHLY}),
a AS (SELECT x.o_orderstatus, k, sum(x.d * z.d) AS c FROM m x JOIN range(0, 49) l(k) ON k <= x.n // 2 JOIN m z ON z.o_orderstatus = x.o_orderstatus AND z.t = x.t - k GROUP BY ALL),
b AS (SELECT o_orderstatus, k, c / max(c) FILTER (k = 0) OVER (PARTITION BY o_orderstatus) AS acf FROM a),
p AS (SELECT *, lag(acf) OVER w AS before, lead(acf) OVER w AS after FROM b WINDOW w AS (PARTITION BY o_orderstatus ORDER BY k))
SELECT o_orderstatus, coalesce(arg_max(k, acf) FILTER (k > 0 AND acf > 0.2 AND acf > before AND acf > after), 12)::INTEGER AS period FROM p GROUP BY 1"""

ORACLES["ar1_monthly"] = f"""WITH RECURSIVE d AS (SELECT o_orderstatus, month, total, total - lag(total) OVER (PARTITION BY o_orderstatus ORDER BY month) AS d FROM {_MONTHLY}),
l AS (SELECT *, lag(d) OVER (PARTITION BY o_orderstatus ORDER BY month) AS before FROM d),
f AS (SELECT o_orderstatus, coalesce(regr_slope(d, before), 0) AS phi, coalesce(regr_intercept(d, before), 0) AS c, arg_max(total, month) AS last, arg_max(d, month) AS d0 FROM l GROUP BY 1),
r(o_orderstatus, phi, c, step, move, forecast) AS (SELECT o_orderstatus, phi, c, 0, d0, last FROM f UNION ALL SELECT o_orderstatus, phi, c, step + 1, c + phi * move, forecast + c + phi * move FROM r WHERE step < 6)
SELECT o_orderstatus, step, round(forecast, 2) AS forecast FROM r WHERE step > 0"""

ORACLES["linear_seasonal_monthly"] = f"""WITH {_DRIFT}
SELECT e.o_orderstatus, h.step::INTEGER AS step, round(base + slope * (n + h.step - 1) + s, 2) AS forecast FROM e CROSS JOIN range(1, 7) h(step) JOIN p ON p.o_orderstatus = e.o_orderstatus AND p.phase = (n + h.step - 1) % 12"""

_XS = ["l_quantity", "l_discount", "l_tax"]
_PAIRED = ", ".join(f"covar_pop({a}, {b}) AS s{i}{j}" for (i, a), (j, b) in [((i, _XS[i - 1]), (j, _XS[j - 1])) for i in (1, 2, 3) for j in range(i, 4)])
#: Three coefficients by Cramer's rule on the covariances.
_SOLVED = f"""s AS (SELECT {_PAIRED}, {", ".join(f"covar_pop({x}, l_extendedprice) AS y{k}, avg({x}) AS m{k}" for k, x in enumerate(_XS, 1))}, var_pop(l_extendedprice) AS yy, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
d AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS det FROM s),
b AS (SELECT *, (y1 * (s22 * s33 - s23 * s23) - s12 * (y2 * s33 - s23 * y3) + s13 * (y2 * s23 - s22 * y3)) / det AS b1,
  (s11 * (y2 * s33 - s23 * y3) - y1 * (s12 * s33 - s23 * s13) + s13 * (s12 * y3 - y2 * s13)) / det AS b2,
  (s11 * (s22 * y3 - y2 * s23) - s12 * (s12 * y3 - y2 * s13) + y1 * (s12 * s23 - s22 * s13)) / det AS b3 FROM d)"""

ORACLES["ols_multiple"] = f"""WITH {_SOLVED}, t AS (SELECT unnest([{{'term': 'intercept', 'coefficient': my - b1 * m1 - b2 * m2 - b3 * m3}}, {", ".join(f"{{'term': '{x}', 'coefficient': b{k}}}" for k, x in enumerate(_XS, 1))}], recursive := true), (b1 * y1 + b2 * y2 + b3 * y3) / yy AS r2, n FROM b)
SELECT term, round(coefficient, 2) AS coefficient, round(r2, 6) AS r2, n FROM t"""

ORACLES["linear_shap"] = f"""WITH {_SOLVED}, t AS ({" UNION ALL ".join(f"SELECT '{x}' AS feature, avg(abs(b{k} * ({x} - m{k}))) AS importance FROM lineitem, b" for k, x in enumerate(_XS, 1))})
SELECT feature, round(importance, 2) AS importance, row_number() OVER (ORDER BY importance DESC, feature)::INTEGER AS rank FROM t"""

_LAGGED = ", ".join(f"covar_pop({a}, {b}) * count(*) AS {a}{b}" for a, b in ("yy", "uu", "vv", "yu", "yv", "uv"))
ORACLES["granger_monthly"] = f"""WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, sum(o_totalprice)::DOUBLE AS total, count(*)::DOUBLE AS c FROM orders GROUP BY ALL),
l AS (SELECT o_orderstatus, total AS y, lag(total) OVER w AS u, lag(c) OVER w AS v FROM m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)),
s AS (SELECT o_orderstatus, count(*) AS n, {_LAGGED} FROM l WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY 1), e AS (SELECT *, uu * vv - uv * uv AS det FROM s),
g AS (SELECT *, yy - (yu * vv - yv * uv) / det * yu - (yv * uu - yu * uv) / det * yv AS rest FROM e), f AS (SELECT o_orderstatus, n, CASE WHEN rest > 0 AND n >= 4 THEN ((yy - yu * yu / uu) - rest) / (rest / (n - 3)) ELSE 0 END AS f FROM g)
SELECT o_orderstatus, n, round(f, 6) AS f, f > 3.84 AS causal FROM f"""


def _partial_sql() -> str:
    """Correlations of pairs given one column, then given a second one; the plain ones are rounded as the operator's are."""
    names = {c: f"x{k}" for k, c in enumerate(_NUM)}
    plain = ", ".join(f"round(corr({a}, {b}), 6) AS {names[a]}{names[b]}" for a, b in combinations(_NUM, 2))

    def r(a, b):
        return names[min(a, b, key=_NUM.index)] + names[max(a, b, key=_NUM.index)]

    def given(a, b, c):
        return f"(({r(a, b)} - {r(a, c)} * {r(b, c)}) / sqrt((1 - {r(a, c)} * {r(a, c)}) * (1 - {r(b, c)} * {r(b, c)})))"

    rows = []
    for a, b in combinations(_NUM, 2):
        c, d = (x for x in _NUM if x not in (a, b))
        ab, ad, bd = given(a, b, c), given(a, d, c), given(b, d, c)
        rows.append(f"SELECT '{a}' AS a, '{b}' AS b, round(({ab} - {ad} * {bd}) / sqrt((1 - {ad} * {ad}) * (1 - {bd} * {bd})), 5) AS partial FROM r")
    return f"WITH r AS (SELECT {plain} FROM lineitem) " + " UNION ALL ".join(rows)


ORACLES["partial_correlations"] = _partial_sql()

_GOOD, _BAD = _in(text.POSITIVE), _in(text.NEGATIVE)
ORACLES["sentiment_conversations"] = f"""WITH t AS (SELECT conv_id, turn, string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+') AS t FROM conversations),
s AS (SELECT conv_id, turn, round((len(list_filter(t, lambda w: w IN {_GOOD})) - len(list_filter(t, lambda w: w IN {_BAD}))) / len(t), 6) AS score FROM t)
SELECT conv_id, turn, score, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM s"""

ORACLES["sentiment_negated_conversations"] = f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_]+') AS t FROM conversations),
w AS (SELECT conv_id, turn, len(t) AS n, list_transform(t, lambda x, i: CASE WHEN x IN {_GOOD} THEN CASE WHEN i > 1 AND t[i - 1] IN {_in(text.NEGATORS)} THEN -0.75 ELSE 1 END
  WHEN x IN {_BAD} THEN CASE WHEN i > 1 AND t[i - 1] IN {_in(text.NEGATORS)} THEN 0.5 ELSE -1 END ELSE 0 END::DOUBLE) AS worth FROM t),
s AS (SELECT conv_id, turn, CASE WHEN n > 0 THEN round(tanh(coalesce(list_sum(worth), 0) / sqrt(n)), 6) ELSE 0 END AS score FROM w)
SELECT conv_id, turn, score, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM s"""

_KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {text.PII_WEIGHTS[k]} AS weight, count_if(regexp_matches(coalesce(text, ''), '{p}')) > 0.1 * count(*) AS found FROM documents" for k, p in text.PII_PATTERNS.items())
ORACLES["pii_risk_documents"] = f"""WITH m AS ({_KINDS}), r AS (SELECT coalesce(sum(weight) FILTER (found), 0) AS raw, coalesce(bool_or(kind = 'ssn') FILTER (found), false) AS ssn, coalesce(bool_or(kind = 'creditCard') FILTER (found), false) AS card FROM m)
SELECT least(raw, 100)::INTEGER AS risk_score, CASE WHEN raw > 50 THEN 'high' WHEN raw > 20 THEN 'medium' ELSE 'low' END AS risk_level, CASE WHEN raw > 30 THEN 'non-compliant' ELSE 'likely-compliant' END AS gdpr, CASE WHEN raw > 30 THEN 'non-compliant' ELSE 'likely-compliant' END AS ccpa,
CASE WHEN ssn THEN 'non-compliant' ELSE 'n/a' END AS hipaa, CASE WHEN card THEN 'non-compliant' ELSE 'n/a' END AS pci_dss FROM r"""

ORACLES["sessions_events"] = """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""

ORACLES["latest_change_events"] = """WITH d AS (SELECT ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1), k AS (SELECT v, row_number() OVER (ORDER BY day DESC) AS k FROM d),
s AS (SELECT max(v) FILTER (k = 1) AS v1, max(v) FILTER (k = 2) AS v2, avg(v) FILTER (k <= 3) AS late, avg(v) FILTER (k BETWEEN 4 AND 6) AS early FROM k)
SELECT round((v1 - v2) / abs(v2) * 100, 4) AS change_pct, round((late - early) / abs(early) * 100, 4) AS trend_pct FROM s"""


def _quality_sql(table: str, columns: list[str]) -> str:
    missing = " + ".join(f"count_if({c} IS NULL OR {c}::VARCHAR = '')" for c in columns)
    return f"""o AS (SELECT {", ".join(columns)} FROM {table}), g AS (SELECT count(*) AS m FROM o GROUP BY ALL), k AS (SELECT sum(m - 1) AS dup FROM (SELECT count(*) AS m FROM o GROUP BY {", ".join(columns)})),
q AS (SELECT count(*) AS rows, {missing} AS miss FROM o), f AS (SELECT rows, 100 - miss * 100.0::DOUBLE / (rows * {len(columns)}) AS c, 100 - dup * 100.0::DOUBLE / rows AS u FROM q, k)"""


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORACLES["benchmark_quality"] = f"""WITH {_quality_sql("orders", _ORDERS)}, v AS (SELECT round((c + u + 200) / 4, 1) AS value FROM f),
p AS (SELECT value, round(CASE WHEN value >= 95 THEN 95 WHEN value >= 75 THEN 50 + (value - 75) / 20 * 45 WHEN value >= 55 THEN 25 + (value - 55) / 20 * 25 ELSE greatest(0, value / 55 * 25) END, 4)::DOUBLE AS percentile FROM v)
SELECT 'data_quality_score' AS metric, value, 75.0::DOUBLE AS median, percentile, CASE WHEN percentile > 75 THEN 'top_quartile' WHEN percentile > 50 THEN 'above_median' WHEN percentile > 25 THEN 'below_median' ELSE 'bottom_quartile' END AS status FROM p"""

_W = quality.WEIGHTS
ORACLES["quality_overall"] = f"""WITH {_quality_sql(_GAPPY, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "price"])}, e AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM o),
x AS (SELECT greatest(0, 100 - 500 * count_if(price < a - 3 * (b - a) OR price > b + 3 * (b - a)) / count(price)) AS acc FROM o, e),
s AS (SELECT ({_W["completeness"]} * round(c, 4) + {_W["uniqueness"]} * round(u, 4) + {_W["accuracy"]} * acc) / {_W["completeness"] + _W["uniqueness"] + _W["accuracy"]} AS s FROM f, x)
SELECT round(s, 4)::DOUBLE AS score, CASE WHEN s >= 95 THEN 'A+' WHEN s >= 85 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 45 THEN 'D' ELSE 'F' END AS grade FROM s"""

ORACLES["sample_orders"] = "SELECT o_orderkey FROM orders ORDER BY md5('1:' || o_orderkey), o_orderkey LIMIT 5000"

_TOLD = """t AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_linenumber < 3 THEN l_tax END AS late_tax, 1.0::DOUBLE AS one, CASE WHEN l_orderkey % 500 = 0 THEN l_quantity * 100 ELSE l_quantity END AS spiked FROM lineitem)"""
_TOLD_COLUMNS = ["price", "net", "late_tax", "one", "spiked"]
_SKEW = "CASE WHEN stddev_pop({c}) > 0 THEN skewness({c}) / (sqrt(count({c})::DOUBLE * (count({c}) - 1)) / (count({c}) - 2)) * count({c})::DOUBLE * count({c}) / ((count({c}) - 1)::DOUBLE * (count({c}) - 2)) ELSE 0 END"
ORACLES["insights_lineitem"] = f"""WITH {_TOLD}, a AS ({" UNION ALL ".join(f"SELECT '{c}' AS subject, {_SKEW.format(c=c)} AS skew, count(DISTINCT {c}) AS kinds, round(count_if({c} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS missing FROM t" for c in _TOLD_COLUMNS)}),
r AS ({" UNION ALL ".join(f"SELECT '{a}~{b}' AS subject, round(CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) ELSE 0 END, 6) AS r FROM t" for a, b in combinations(_TOLD_COLUMNS, 2))})
SELECT 'skewed' AS kind, subject, round(skew, 3)::DOUBLE AS detail, 'medium' AS impact FROM a WHERE abs(skew) > 2 UNION ALL SELECT 'constant', subject, 1, 'low' FROM a WHERE kinds = 1
UNION ALL SELECT 'missing', subject, round(missing, 3), CASE WHEN missing > 50 THEN 'high' ELSE 'medium' END FROM a WHERE missing > 10 UNION ALL SELECT 'correlated', subject, round(r, 3), 'high' FROM r WHERE abs(r) > 0.7"""
