import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.operators import assess

ROWS = [("a", 1, 2.0, None), ("a", 1, 2.0, None), ("b", 2, None, None), ("ü", 3, 4.0, "x")]
SCHEMA = "s string, n int, x double, e string"


def test_profile_and_quality(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = assess.table_profile(df).first()
    size = sum(len(json.dumps(dict(zip("snxe", row)), separators=(",", ":"), ensure_ascii=False).encode()) for row in ROWS)
    assert (r.rows, r.columns, r.cells, r.missing, r.duplicates, r.json_bytes) == (4, 4, 16, 4, 1, size)
    assert r.quality == round(100 * (0.6 * (1 - 4 / 16) + 0.4 * (1 - 1 / 4)))
    q = assess.table_quality(df).first()
    assert (q.completeness, q.uniqueness, q.validity) == (0.75, 0.75, 1 - 3 / 16) and q.score == round(100 * (0.35 * 0.75 + 0.2 * 0.75 + 0.3 * (1 - 3 / 16) + 0.15))
    empty = df.limit(0)
    assert assess.table_profile(empty).first().quality == 0 and assess.table_quality(empty).collect() == []


def test_issues(spark):
    rows = [(f"k{k}", 1.0 if k < 40 else 1000.0, None if k % 4 else "y", "same") for k in range(41)]
    found = {(r.category, r.column): (r.severity, r.detail) for r in assess.quality_issues(spark.createDataFrame(rows, "id string, x double, gap string, c string")).collect()}
    assert set(found) == {("completeness", None), ("sparse_column", "gap"), ("cardinality", "id"), ("distribution", "x")}
    assert found["completeness", None] == ("warning", pytest.approx(30 / 164)) and found["sparse_column", "gap"][0] == "critical"
    assert [(r.severity, r.category) for r in assess.quality_issues(spark.createDataFrame([], "a string")).collect()] == [("critical", "empty")]
    copies = assess.quality_issues(spark.createDataFrame([("a",)] * 3, "s string")).collect()
    assert [(r.severity, r.category) for r in copies] == [("critical", "uniqueness")]


def test_uniqueness_and_validity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (3, None)], "k int, w string")
    got = {r.column: (r.distinct, r.present, r.is_key, r.score) for r in assess.uniqueness(df, ["k", "w"]).collect()}
    assert got == {"k": (3, 4, False, 50.0), "w": (1, 2, False, 50.0)}
    mixed = spark.createDataFrame([("1", "a@b.c", "2024-01-01", "true"), ("2", "nope", "2024-01-02", "no"), ("2.5", "c@d.e", "2024-01-03", "x"), ("x", None, "later", "true")], "n string, m string, d string, b string")
    told = {r.column: (r.dominant, r.invalid, r.validity_pct, r.status) for r in assess.validity(mixed, ["n", "m", "d", "b"]).collect()}
    assert told == {"n": ("integer", 1, 75.0, "warning"), "m": ("email", 1, pytest.approx(100 * 2 / 3), "critical"), "d": ("date", 1, 75.0, "warning"), "b": ("boolean", 0, 100.0, "good")}


def test_risk_and_frameworks(spark):
    found = spark.createDataFrame([("a", "ssn"), ("b", "race"), ("c", "religion"), ("d", "credit_card"), ("e", "other")], "column string, kind string")
    assert tuple(assess.privacy_risk(found).first()) == (100, "critical")
    got = {r.framework: (r.findings, r.status, r.columns) for r in assess.compliance(found).collect()}
    assert got == {"GDPR": (3, "non_compliant", "a,b,c"), "CCPA": (2, "review_required", "a,d"), "HIPAA": (0, "compliant", ""), "PCI-DSS": (1, "review_required", "d")}
    none = found.limit(0)
    assert tuple(assess.privacy_risk(none).first()) == (0, "low") and {r.status for r in assess.compliance(none).collect()} == {"compliant"}


@pytest.mark.parametrize("sensitivity", list(assess.SENSITIVITY))
def test_row_anomalies(spark, sensitivity):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=200), 9.0, -7.0]
    flat = np.r_[np.full(150, 2.0), rng.normal(size=52) * 0.1 + 2]
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, flat))] + [(999, None, None)]
    got = {(r.id, r.column): (r.reasons, r.score) for r in assess.row_anomalies(spark.createDataFrame(rows, "id int, x double, flat double"), ["id"], ["x", "flat"], sensitivity).collect()}
    z_limit, fence, m_limit = assess.SENSITIVITY[sensitivity]
    want = {}
    for name, v in (("x", x), ("flat", flat)):
        q1, q2, q3 = np.percentile(v, [25, 50, 75])
        mad = np.median(np.abs(v - q2)) or 1e-9
        for k, value in enumerate(v):
            found = {}
            if (z := abs(value - v.mean()) / v.std()) > z_limit:
                found["z"] = z / z_limit
            if q3 > q1 and not q1 - fence * (q3 - q1) <= value <= q3 + fence * (q3 - q1):
                found["iqr"] = abs(value - q2) / (q3 - q1) / fence
            if (m := 0.6745 * abs(value - q2) / mad) > m_limit:
                found["mad"] = m / m_limit
            if found:
                want[k, name] = (",".join(found), min(3.0, max(found.values())))
    assert set(got) == set(want) and (200, "x") in got
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])


def test_causal_pairs(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=120)
    b = np.r_[0, a[:-1]] + a + rng.normal(size=120) * 0.1
    rows = [("s", t, float(x), float(y), 1.0) for t, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "k string, t int, a double, b double, c double")
    got = {(r.cause, r.effect): r for r in assess.causal_pairs(df, ["k"], "t", ["a", "b", "c"]).collect()}
    assert set(got) == {("a", "b"), ("b", "a")}
    r = got["a", "b"]
    y, u, v = b[1:], b[:-1], a[:-1]

    def rest(*xs):
        m = np.c_[np.ones(len(y)), *xs] if xs else np.ones((len(y), 1))
        return float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())

    f = (rest(u) - rest(u, v)) / (rest(u, v) / (len(y) - 3))
    assert r.f == pytest.approx(f) and r.causal and r.improves and r.improvement_pct == pytest.approx(100 * (1 - rest(u, v) / rest(u)))
    assert r.r == pytest.approx(np.corrcoef(a, b)[0, 1]) and r.p == "<0.001" and r.confidence == pytest.approx(abs(r.r) * 1.2)
    assert len(assess.causal_pairs(df, ["k"], "t", ["a", "b"], most=1).collect()) == 1
    with pytest.raises(ValueError, match="two columns"):
        assess.causal_pairs(df, ["k"], "t", ["a"])


def test_bands_products_and_distributions(spark):
    row = spark.range(1).select(*[assess.p_band(F.lit(float(r)), F.lit(n)).alias(f"p{k}") for k, (r, n) in enumerate([(0.9, 2), (0.1, 10), (1.0, 10), (0.6, 12), (0.55, 14), (-0.7, 14)])]).first()
    assert list(row) == ["n/a", ">0.05", "<0.001", "<0.05", "<0.05", "<0.01"]
    made = assess.polynomial_features(spark.createDataFrame([(2, 3.0), (None, 1.0)], "a int, b double"), ["a", "b"], 3)
    assert made.columns == ["a", "b", "a^2", "a*b", "b^2", "a^3", "a^2*b", "a*b^2", "b^3"]
    assert sorted(made.collect(), key=lambda r: r.b, reverse=True)[0][2:] == (4.0, 6.0, 9.0, 8.0, 12.0, 18.0, 27.0)
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), (None, 5.0)], "s string, v double")
    assert {r.measure: r.value for r in assess.distribution(df, "v").collect()}["median"] == 3.0
    assert {r.measure: r.value for r in assess.distribution(df, "s").collect()} == {"n:x": 2.0, "distinct": 1.0}
    cells = {(r.row, r.column): r.r for r in assess.correlation_cells(df.selectExpr("v", "2 * v AS w"), ["v", "w"]).collect()}
    assert cells == {("v", "v"): 1.0, ("w", "w"): 1.0, ("v", "w"): 1.0, ("w", "v"): 1.0}
