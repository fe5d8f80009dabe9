import pytest

from gneiss.plans import ahead, assessed, feeds, fitted, layers, more, networks, oracles, reference, told  # noqa: F401
from gneiss.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: The ten suppliers of the smallest tables are all noise.
LARGER = {"dbscan_suppliers": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """The others have rows of values that are not all null."""
    rows = QUERIES[name](spark, LARGER.get(name, SF)).collect()
    assert rows
    for column in rows[0].asDict():
        assert any(r[column] is not None for r in rows)


@pytest.mark.parametrize("sf", [SF, LARGER["dbscan_suppliers"]])
def test_dbscan_against_all_pairs(spark, sf):
    points = {r.s_suppkey: (r.s_acctbal / 1000, float(r.s_nationkey)) for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    near = {a: [b for b in points if (p[0] - points[b][0]) ** 2 + (p[1] - points[b][1]) ** 2 <= 1.5**2] for a, p in points.items()}
    label = {a: a for a in points if len(near[a]) >= 4}
    for _ in label:
        label = {a: min(label[b] for b in near[a] if b in label) for a in label}
    want = {a: label.get(a, min((label[b] for b in near[a] if b in label), default=None)) for a in points}
    assert {r.s_suppkey: r.cluster for r in QUERIES["dbscan_suppliers"](spark, sf).collect()} == want
