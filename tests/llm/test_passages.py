import hashlib
import random
from collections import Counter

import pytest

from gneiss.llm import passages, registry

SF = "/root/testdata/sf0.001"


def slow(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(gone)))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, KEPT string")
    got = passages.remove_repeats(docs, **how).collect()
    return {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r["kept"])) for r in got}, len(got)


def sample(rnd):
    def words(n):
        return " ".join("".join(rnd.choices("abcdefgé", k=rnd.randrange(2, 7))) for _ in range(n))

    shared, phrase = [words(90), words(45), words(300)], words(14)
    texts = [None, "", "short", "ab" * 300, "x" * 199, "y" * 200, "z" * 201, "q" * 500]
    for _ in range(40):
        parts = [words(rnd.randrange(5, 60)) for _ in range(3)]
        passage = rnd.choice(shared)
        a, b = sorted(rnd.sample(range(len(passage)), 2))
        parts[1:1] = [passage[a:b], phrase]
        texts.append(" ".join(parts))
    return texts + texts[10:13]


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_matches_brute_force(spark, broadcast):
    texts = sample(random.Random(6))
    want = slow(texts, 200)
    got, _ = run(spark, list(enumerate(texts)), broadcast_bytes=broadcast)
    assert {i: g[:3] for i, g in got.items()} == {i: w[:3] for i, w in enumerate(want)}
    assert [got[i][3] for i in got] == [want[i][3] for i in got]


def test_sorter_spills(spark):
    texts = sample(random.Random(7))
    got, _ = run(spark, list(enumerate(texts)), memory=50, blocks_per_shard=10**9)
    assert {i: g for i, g in got.items()} == dict(enumerate(slow(texts, 200)))


def test_long_texts_are_cut_into_parts():
    rnd = random.Random(8)
    raw = bytes(rnd.choices(b"abcdef", k=5000))
    parts = list(passages._batches_of([b"", raw, b"x"], 200, most=1000))
    assert all(p == raw[o : o + len(p)] for n, ps, os in parts for p, o in zip(ps, os) if n == 1)
    windows = {o + i for n, ps, os in parts for p, o in zip(ps, os) if n == 1 for i in range(len(p) - 199)}
    assert windows == set(range(4801))


def test_documents_and_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(docs, slow([r.text for r in docs], 200))}
    got = {r.doc_id: r for r in registry.op6_suffix_dedup(spark, SF).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}


def test_null_and_repeated_ids(spark):
    text = "".join(random.Random(9).choices("abcdefgh", k=260))
    got, n = run(spark, [(None, text), (1, text + "tail"), (1, "other " * 10), (2, None)])
    assert n == 4 and got[None][1] == 260 and got[2] == (0, 0, 0, b"")
    assert run(spark, [(None, text)])[0][None][1] == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.remove_repeats(docs).count() == 0
