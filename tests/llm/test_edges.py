"""Very long texts, repeated rows, clashing names and empty tables of the operators that fit models or link documents."""

import pytest
from pyspark.sql import functions as F

from gneiss.llm import langid, lines, mixing, near_docs, quality, registry, toxicity
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog and then " * 40_000  # two million letters


@pytest.mark.parametrize("name", ["op11_phrases", "op12_audit"])
def test_queries_match_their_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def frame(spark, names="lang_pred int, rejected string, severity string, grade string, base_failed int, posterior int"):
    clash = [f"cast(null AS {x.split()[1]}) AS {x.split()[0]}" for x in names.split(", ")]
    rows = [(1, LONG), (2, "the quick brown fox " * 3), (2, "the quick brown fox " * 3), (None, "the quick brown fox"), (3, None), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *clash)


def test_language(spark, learned):
    docs, _ = learned
    model = langid.fit_languages(docs)
    out = langid.identify_language(frame(spark), model)
    rows = out.collect()
    assert len(rows) == 6 and [t for n, t in out.dtypes if n in ("lang_pred", "rejected")] == ["string", "boolean"]
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 2}) == 1
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4)} == {"und"}
    assert langid.identify_language(frame(spark).limit(0), model).count() == 0


def test_toxicity(spark, learned):
    docs, labels = learned
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)
    out = toxicity.score_toxicity(frame(spark), model)
    rows = out.collect()
    assert len(rows) == 6 and dict(out.dtypes)["severity"] == "double" and dict(out.dtypes)["grade"] == "int"
    assert len({r.severity for r in rows if r.doc_id == 2}) == 1 and all(r.severity >= 0 for r in rows)
    assert toxicity.score_toxicity(frame(spark).limit(0), model).count() == 0


def test_quality(spark, learned):
    docs, labels = learned
    model = quality.fit_quality(docs, labels)
    out = quality.judge_quality(frame(spark), model)
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    words = len(LONG.split())
    assert by[1][0].n_words == words and by[1][0].n_repeat_words == words and by[1][0].base_failed is True
    assert by[2][0] == by[2][1] and dict(out.dtypes)["base_failed"] == "boolean"


def test_mixing(spark, learned):
    docs, labels = learned
    out = mixing.mix_to_targets(frame(spark), mixing.label_domains(labels), mixing.TARGETS).collect()
    assert len(out) == 6 and all(r.rate >= 0 for r in out)
    whole = mixing.mix_to_targets(docs.select("doc_id", "text").unionByName(frame(spark).select("doc_id", "text").where("doc_id = 1").withColumn("doc_id", F.lit(-1).cast("long"))), mixing.label_domains(labels), mixing.TARGETS)
    assert whole.where("doc_id = -1").first().n_tokens == len(LONG.split())


def test_near_documents(spark):
    rows = [(1, LONG), (2, LONG + "an ending"), (3, "of its own"), (3, "of its own"), (None, LONG), (5, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gone_id", "2 AS id", "3 AS h")
    kept = near_docs.drop_near_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 3, 5]
    assert near_docs.drop_near_documents(docs.limit(0)).count() == 0


def test_which_copy_keeps_its_lines_does_not_depend_on_partitions(spark):
    text = "a line of some length that stands here\nanother line that is not like it"
    rows = [(1, text, f"source {k}") for k in range(6)]
    kept = set()
    for parts in (1, 2, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts).orderBy(F.rand(parts))
        kept.add(next(r.source for r in lines.drop_duplicate_lines(docs).collect() if "another" in r.text))
    assert len(kept) == 1
