from itertools import permutations

import numpy as np

from gneiss.llm import audit

SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failed(text, smaller):
    """The letters of the conditions that hold, straight from the contract."""
    words = text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    tests = [
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        any(c in "#$%&*|" for c in text),
        smaller,
    ]
    return {letter for letter, holds in zip("ABCDE", tests) if holds}


def brute(docs, labels):
    rows = []
    for doc_id, text, part in docs:
        smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in docs)
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        rows.append((part or "", failed(text or "", smaller), any(q == 1 for _, q, _ in own), any(t == 1 for _, _, t in own)))
    out = {}
    for part in {r[0] for r in rows}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                here = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                fails = sum(x in r[1] for r in rows if r[0] == part)
                removed_by[x] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), fails - len(here), sum(r[1] == {x} for r in rows if r[0] == part), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def check(spark, docs, labels, **how):
    found = audit.audit_filters(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), **how).collect()
    assert len(found) == len({r[:3] for r in found})
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}
    assert got == brute(docs, labels)


LONG = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (1, LONG, "a"),
    (2, LONG, "a"),
    (3, LONG, "b"),
    (3, LONG, "b"),
    (4, None, "a"),
    (5, "", None),
    (6, LONG + " $", "a"),
    (7, "x " * 80, "b"),
    (8, LONG.upper(), ""),
    (None, LONG, "c"),
    (None, None, None),
    (9, "é" * 19 + "A", "a"),
    (10, "é" * 20 + "AA", "a"),
    (11, "ABC | " * 30, "d"),
    (12, "ABC | " * 30, "d"),
]
LABELLED = [(1, 1, 0), (2, 1, 1), (4, None, None), (5, 0, 1), (6, 1, None), (6, 0, 1), (8, 1, 0), (None, 1, 1), (12, 1, 1), (99, 1, 1)]


def test_against_every_order(spark):
    check(spark, DOCS, LABELLED)
    check(spark, [(None, None, None)], [])


def test_many_parts_are_written_out_in_between(spark, monkeypatch):
    docs = [(k, LONG if k % 3 else None, f"p{k % 7}") for k in range(40)]
    monkeypatch.setattr(audit, "PARTS", 2)
    check(spark, docs, LABELLED)


def test_table_of_first_failures():
    table = audit.first_failures(5)
    assert table.shape == (32, 120)
    for bits in range(32):
        for n, order in enumerate(permutations(range(5))):
            assert table[bits, n] == next((s for s, f in enumerate(order) if bits >> f & 1), 5)


def test_other_filters_long_texts_and_names(spark):
    docs = spark.createDataFrame([(1, "b" * 9_000_000, "x", 1, 2), (2, "a", "x", 3, 4)], SCHEMA + ", failed int, digest int")
    out = audit.audit_filters(docs, spark.createDataFrame([], LABELS), filters={"L": lambda text, words: len(text) > 1000})
    rows = {(r.filter_order, r.step): (r.kept, r.removed) for r in out.collect()}
    assert rows == {("LE", 1): (1, 1), ("LE", 2): (1, 0), ("EL", 1): (2, 0), ("EL", 2): (1, 1)}


def test_empty_table(spark):
    out = audit.audit_filters(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))
    assert out.collect() == [] and out.columns[:3] == ["part", "filter_order", "step"]


def test_removals_add_up(spark):
    out = audit.audit_filters(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).toPandas()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    last = out[out.step == 5].groupby("filter_order").kept.sum()
    assert last.nunique() == 1
    assert (out.groupby("filter_order").removed.sum() + last == n).all()
    assert np.all(out[["kept", "removed", "redundant"]] >= 0)
