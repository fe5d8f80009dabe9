import sentencepiece

import corpus_pipeline as cp
from gneiss.llm.scratch import Scratch
from tests.llm.test_lines import slow as slow_lines
from tests.llm.test_near_docs import slow_kept

SF = "/root/testdata/sf0.001"


def test_stages_and_decisions(spark):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        seen.append(docs)
        docs = scratch.keep(stage(spark, docs, SF))
        if name != "sentencepiece":
            assert docs.columns == columns
    raw, known, lined, alone, mixed = ({r.doc_id: r for r in d.collect()} for d in seen)
    assert set(known) <= set(raw) and len(known) >= 0.97 * len(raw)
    assert all(known[i] == raw[i] for i in known)
    order = sorted(known)
    cut = dict(zip(order, slow_lines([(i, known[i].text) for i in order])))
    assert set(lined) == set(known)
    assert sum(lined[i].text != cut[i] for i in order) <= 0.01 * len(order)
    assert all(r.n_chars == len(r.text) for r in lined.values())
    kept, _ = slow_kept({i: r.text for i, r in lined.items()})
    assert set(alone) == kept and all(alone[i] == lined[i] for i in alone)
    assert set(mixed) <= set(alone) and len(mixed) > 0.5 * len(alone)
    library = sentencepiece.SentencePieceProcessor(model_file=cp.TOKENIZER)
    final = {r.doc_id: r for r in docs.collect()}
    assert set(final) == set(mixed)
    for i, r in final.items():
        assert r.ids == library.encode(mixed[i].text, add_eos=True) and r.decoded == library.decode(r.ids)


def test_edge_rows_of_every_stage(spark):
    rows = [(1, "The cat and the dog went to the house of the old man and the two women.", "x", 5), (2, None, "y", 5), (3, "", "z", 5), (None, "The cat and the dog went out of the house.", None, None)]
    rows += [rows[0], (4, "The cat " * 4000, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE string, ids long").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as rate", "2 as gone_id")
    scratch = Scratch(spark)
    for table in (docs, docs.limit(0)):
        size = table.count()
        for name, stage in cp.STAGES:
            out = scratch.keep(stage(spark, table, SF))
            assert out.count() <= size
            if name == "sentencepiece":
                assert "ids" in out.columns and dict(out.dtypes)["ids"] == "array<int>" and out.count() == size
            else:
                assert out.columns == table.columns
