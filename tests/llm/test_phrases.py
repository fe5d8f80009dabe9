import random
import re
from collections import Counter

import numpy as np

from gneiss.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000, share=50):
    """The contract, by counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {}
    candidates = [c for c in f if len(c) > 2 and f[c] >= least]
    for lang, *w in candidates:
        a = f[lang, *w]
        if any(100 * f[c] >= share * a for c in candidates if c[0] == lang and len(c) > len(w) + 1 and any(list(c[i : i + len(w)]) == w for i in range(1, len(c)))):
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, some in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(some)[:top], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


TEXTS = (
    [("en", "New York City is big. new york city, NEW YORK city\tis")] * 6
    + [("en", "york york york york york york york"), ("de", "das ist ein Test; das ist ein Test"), (None, "x y x y x y x y x y x y x y x y x y x y x y")]
    + [("de", "das ist so")] * 9
    + [("en", None), ("en", ""), ("en", " \t.,;"), (None, None), ("und", "x y"), ("fr", "é a b c é a b c")]
    + [("fr", "é a b c . \x00 . é a b c")] * 12
)
SCHEMA = "lang string, text string"


def test_against_counts(spark):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    got = rows_of(phrases.mine_phrases(df))
    assert got == brute(TEXTS)
    assert any(r[0] == "und" for r in got) and any(r[2] == "é a b c" for r in got)


def test_longer_phrases_small_chunks_and_a_short_list(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").collect()
    rows = [(r.lang, r.text) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(phrases.mine_phrases(df, longest=4, least=6, top=150, kept_below=70, chunk_bytes=5000)) == brute(rows, 4, 6, 150, 70)


def test_repeated_rows_and_long_text_and_clashing_names(spark):
    text = "alpha beta gamma delta " * 60_000 + "! alpha beta"
    rows = [("en", text, 1, "a", 1), ("en", text, 1, "a", 1)]
    df = spark.createDataFrame(rows, "lang string, text string, chunk long, word string, n int")
    got = rows_of(phrases.mine_phrases(df, chunk_bytes=1000))
    assert got == brute([r[:2] for r in rows])
    assert got[0][6] == 2 * (240_002)


def test_empty_table_and_no_candidates(spark):
    for rows in ([], [("en", "one two three")]):
        out = phrases.mine_phrases(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert out.collect() == []


def test_scores_pass_64_bits(spark):
    big = 4_000_000_000_000
    level = spark.createDataFrame([(1, 2, 3, "en", "a b", "b", big, [big + 1], [big + 7])], "id long, left long, right long, lang string, phrase string, last string, f long, firsts array<long>, lasts array<long>")
    row = phrases._scored(level, None, 2, 50).first()
    assert row.score == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_pairs_do_not_depend_on_the_order_in_which_ids_arrive():
    """Ids of one chunk come from several buckets in any order, and another one at each level."""
    rng = np.random.default_rng(1)
    seq, buckets = rng.integers(0, 60, 4000), 4
    chunk = phrases._rows([{"chunk": 7, "seq": phrases._packed(seq)}], phrases._CHUNKS)
    words = [{"level": 1, "bucket": b, "chunk": 7, "at": phrases._packed(np.arange(1 + b, 60, buckets)), "id": phrases._packed(np.arange(1 + b, 60, buckets))} for b in range(buckets)]
    pairs = phrases._pair_entries(chunk, phrases._rows(words, phrases._NAMED), (buckets,))
    both = [(b, phrases._unpacked(x), phrases._unpacked(y)) for b, x, y in zip(*(pairs.column(c).to_pylist() for c in ("bucket", "left", "right")))]
    named = [{"level": 2, "bucket": b, "chunk": 7, "at": phrases._packed(np.arange(len(x))), "id": phrases._packed(x * 100 + y)} for b, x, y in both]
    want = Counter((100 * a + b, 100 * b + c) for a, b, c in zip(seq.tolist(), seq[1:].tolist(), seq[2:].tolist()) if a and b and c)
    for k in range(4):
        rows = random.Random(k).sample(words + named, len(words + named))
        found = phrases._pair_entries(chunk, phrases._rows(rows, phrases._NAMED), (buckets, buckets))
        got = [np.concatenate([phrases._unpacked(x) for x in found.column(c).to_pylist()]).tolist() for c in ("left", "right", "n")]
        assert {(a, b): n for a, b, n in zip(*got)} == want
