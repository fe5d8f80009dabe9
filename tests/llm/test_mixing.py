import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import mixing, registry

SF = "/root/testdata/sf0.01"


def test_rates_match_local_projected_gradient(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    tokens = rng.integers(0, 900, 300)
    rows = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(tokens, p)], "n_tokens long, posterior array<double>")
    targets = [0.45, 0.35, 0.2]
    steps, wanted, reached = mixing.fit_rates(rows, targets, rounds=25)
    assert np.abs(reached / wanted - 1).max() < 0.02
    natural = (tokens[:, None] * p).sum(axis=0)
    rate = np.ones(300)
    for _ in steps:
        gap = ((rate * tokens) @ p - wanted) / natural
        rate = np.maximum(0, rate - p @ gap)
    got = [r[0] for r in rows.select(mixing.rate_of(F.col("posterior"), steps)).collect()]
    assert np.allclose(got, rate) and min(got) >= 0


def test_query_meets_targets(spark):
    got = registry.op9_mixing(spark, SF).toPandas()
    total = {d: (got.rate * got.n_tokens * got[f"p_{d}"]).sum() for d in mixing.TARGETS}
    share = {d: v / sum(total.values()) for d, v in total.items()}
    assert len(got) == 1000 and (got.rate >= 0).all()
    assert all(share[d] == pytest.approx(w, abs=0.01) for d, w in mixing.TARGETS.items())


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    model = mixing.fit_domains(docs, labels.where("doc_id % 2 = 0"))
    rows = mixing.with_posteriors(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([model.domains[int(np.argmax(r.posterior))] == r.domain for r in rows]) > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (None, "", 9), (1, "a b", 9)], "doc_id long, text string, rate int")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix_to_targets(docs, none, {"x": 1.0}).collect()
    assert [r.rate for r in got] == [1.0] * 4 and sorted(r.n_tokens for r in got) == [0, 0, 2, 2]
    one = mixing.mix_to_targets(docs, spark.createDataFrame([(1, "x"), (2, "y"), (None, "x")], none.schema), {"x": 1.0, "z": 3.0}).collect()
    assert len(one) == 4 and all(r.rate >= 0 for r in one)
    assert mixing.mix_to_targets(docs.limit(0), none, {"x": 1.0}).count() == 0


def test_report_tells_what_was_reached(spark):
    docs = spark.createDataFrame([(i, "red red red apple" if i % 2 else "blue sky blue") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "case when doc_id % 2 = 1 then 'r' else 'b' end as domain")
    report = []
    rated = mixing.mix_to_targets(docs, labels, {"r": 0.5, "b": 0.5, "none": 0.2}, report=report).collect()
    by = {r["domain"]: r for r in report}
    assert set(by) == {"b", "r"} and all(r["wanted"] > 0 for r in report)
    for d in by:
        for rate, want in ((True, "reached"), (False, "natural")):
            total = sum((r.rate if rate else 1.0) * r.n_tokens * r.posterior[d] for r in rated)
            assert abs(total - by[d][want]) < 1e-6 * total
