import random

import corpus_pipeline as cp
from gneiss.llm import registry
from tests.llm import test_lines

SF = "/root/testdata/sf0.001"


def test_queries_match_brute_force_of_five_characters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip((i for i, _ in rows), test_lines.slow(rows)))
    got = {r.doc_id: r.text for r in cp.drop_repeated_lines(spark, docs, SF).collect()}
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
    count = {i: sum(1 for x in (t or "").split("\n") if x.strip()) for i, t in want.items()}
    left = {r.doc_id: r.n_lines - r.n_dropped for r in registry.op2_line_dedup(spark, SF).collect()}
    assert sum(left[i] != count[i] for i in want) <= 0.01 * len(want)


def test_one_changed_word_in_a_short_line_is_found(spark):
    rnd = random.Random(6)
    base = [["".join(rnd.choices("abcdefghij", k=6)) for _ in range(17)] for _ in range(20)]
    made = [" ".join(b) for b in base] + [" ".join(b[:8] + ["other1"] + b[9:]) for b in base]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(made)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.n_chars for r in cp.drop_repeated_lines(spark, docs, SF).collect()}
    assert all(got[i] > 0 for i in range(20)) and sum(got[i] == 0 for i in range(20, 40)) >= 19
