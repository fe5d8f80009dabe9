import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm.pieces import Encoder, decode, digests, encode_decode, encode_documents, load_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return load_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def compare(model, library, texts):
    ids, offsets = Encoder(model).encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    want = [library.encode(t or "", add_eos=True) for t in texts]
    assert got == want
    assert decode(model, ids, offsets) == [library.decode(x) for x in want]


def test_documents(model, library):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    compare(model, library, texts)


def test_edges(model, library):
    odd = ["", None, " ", "  ", "\n", "a", " a", "a ", "▁", "▁a b▁▁", "\x00\x01", "\U0001f600é　ﬁ", "aaaaaaaaaaaa", "hahahahahah" * 9]
    odd += [" " * n for n in range(1, 70)] + ["=" * n for n in range(1, 90)] + ["x" * 3000, " " * 3001 + "y", "the" * 700, "1234567890" * 200, "日本語テキスト" * 90]
    compare(model, library, odd)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab e\n ▁é日thein-=1", max_size=60) | st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_random(text):
    compare(load_model_once(), library_once(), [text])


_ONCE = {}


def load_model_once():
    return _ONCE.setdefault("m", load_model(PATH))


def library_once():
    return _ONCE.setdefault("l", sentencepiece.SentencePieceProcessor(model_file=PATH))


def test_decode_any_ids(model, library):
    rng = np.random.default_rng(1)
    ids = rng.integers(3, 400, 400)
    for at in range(0, 400, 8):
        part = ids[at : at + 8]
        assert decode(model, part, np.array([0, 8])) == [library.decode(part.tolist())]


def test_query_columns(spark, library):
    rows = [(1, "Hello world ", "x"), (2, None, "y"), (2, None, "y"), (None, "é" * 50, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in digests(encode_decode(docs, PATH)).collect()}
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_documents(docs.limit(0), PATH).count() == 0
