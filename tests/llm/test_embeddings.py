import numpy as np
import pytest
from pyspark.sql import types as T

from gneiss.llm import embeddings, registry
from tests.oracle import compare

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType())])


def test_roots_and_nearest_point():
    roots = embeddings.e8_roots()
    assert len({tuple(r) for r in roots}) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(size=(400, 8)) * 2
    near = embeddings.nearest_e8(x)
    away = ((x - near) ** 2).sum(axis=1)
    assert away.max() <= 1 + 1e-9  # the covering radius is 1
    for r in roots:
        assert (((x - near - r) ** 2).sum(axis=1) >= away - 1e-9).all()
    doubled = np.rint(2 * near)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1) & (near.sum(axis=1) % 2 == 0)).all()


def slow(rows, least):
    unit = {}
    for n, (_, e, label, _x) in enumerate(rows):
        if e and label is not None and None not in e and np.isfinite(e).all() and np.any(e):
            v = np.array(e, np.float32).astype(float)
            unit[n] = v / np.linalg.norm(v)
    links = [(a, b) for a in unit for b in unit if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    return links


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for base in range(40):
        v = rng.normal(size=64)
        v /= np.linalg.norm(v)
        for _ in range(8):
            angle, w = rng.uniform(0, 0.25), rng.normal(size=64)
            w -= (w @ v) * v
            rows.append((len(rows), (np.cos(angle) * v + np.sin(angle) * w / np.linalg.norm(w)).tolist(), base % 3, "x"))
    links = slow(rows, 0.98)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got.values()) >= 0.97 * len(links) and sum(got.values()) <= len(links)


@pytest.mark.parametrize("dims", [4, 8, 16, 32, 64, 256])
def test_recall_in_other_dimensions(dims):
    rng = np.random.default_rng(9)
    v, w = rng.normal(size=(2, 500, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w -= (w * v).sum(axis=1, keepdims=True) * v
    y = 0.98 * v + (1 - 0.98**2) ** 0.5 * w / np.linalg.norm(w, axis=1, keepdims=True)
    scale, met = 0.7 / 0.04**0.5, np.zeros(500, bool)
    for table in range(6):
        a, b = (embeddings.cells(x, table, scale, 8, 11) for x in (v, y))
        met |= (a == b[:, :1]).all(axis=2).any(axis=1) | (b == a[:, :1]).all(axis=2).any(axis=1)
    assert met.mean() >= 0.97


def test_edges(spark):
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [(1, a, 1), (2, a, 1), (3, b, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 3, 1), (8, [1.0, None, 0.5], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [], 1), (11, a + [0.0], 1), (None, a, 1), (2, a, 1)]
    got = embeddings.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert [(by[k].n_links, by[k].component_id, by[k].kept) for k in (1, 2, 3)] == [(4, 1, True), (4, 1, False), (4, 1, False)]
    assert all((by[k].n_links, by[k].component_id, by[k].kept) == (0, k, True) for k in range(4, 12))
    assert by[None].component_id is None and by[None].kept
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    compare(spark, registry.QUERIES["op3_embeddings"], registry.ORACLES["op3_embeddings"], SF)
