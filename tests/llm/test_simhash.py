import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import types as T

from gneiss.llm.components import connected_components
from gneiss.llm.scratch import Scratch
from gneiss.llm.simhash import BUNDLES, _met, _postings, drop_simhash_duplicates, fingerprint, fingerprint_links, simhash_near_duplicates, tallied_pairs

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(prints, bits=2):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("text", ["", None, " \n\t", "One", "one two", "A b c", "ÀÉ b  c\x0bd e f", "x y z " * 500])
def test_fingerprint_matches_definition(text):
    assert fingerprint(text) % 2**64 == slow_fingerprint(text)


@pytest.mark.parametrize("longest", [1, 3, 64])
def test_matches_brute_force(spark, longest):
    base = " ".join(f"w{i}" for i in range(300))
    texts = {i: base.replace(f"w{i * 7} ", "zz ") for i in range(30)}
    texts |= {100 + i: f"other text number {i % 5} with words" for i in range(12)} | {200: None, 201: "", 202: " \n"}
    rows = [(i, t, "clash") for i, t in texts.items()]
    got = {r.doc_id: r for r in simhash_near_duplicates(spark.createDataFrame(rows, SCHEMA), longest=longest).collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(prints)


@pytest.mark.parametrize("longest", [1, 64])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_of_given_fingerprints(spark, longest, bits):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = {p ^ (1 << rnd.randrange(64)) ^ (rnd.random() < 0.6) << rnd.randrange(64) for p in base for _ in range(12)} | set(base)
    prints |= {2**63, 2**63 | 1, 2**62}
    signed = {p - 2**64 if p >= 2**63 else p for p in prints}
    scratch = Scratch(spark)
    links = fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"), scratch, bits, longest)
    roots = {r.node: r.root for r in connected_components(links, scratch).collect()}
    want = slow_components({p: p % 2**64 for p in signed}, bits)
    assert {p: roots.get(p, p) for p in signed} == want


@pytest.mark.parametrize("longest", [2, 1000])
def test_the_tally_drops_pairs_that_meet(spark, longest):
    import random

    rnd = random.Random(11)
    base = rnd.getrandbits(64)
    prints = {base} | {base ^ sum(rnd.randrange(1, 256) << 8 * k for k in rnd.sample(range(8), n)) for n in (1, 2, 3, 4) for _ in range(25)}
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")

    def shared(a, b):
        return sum((a ^ b) >> 8 * k & 0xFF == 0 for k in range(8))

    met = {(r.a, r.b) for r in _met(_postings(fps), ["bundle", "value"]).collect()}
    kept = {(r.a, r.b) for r in tallied_pairs(fps, Scratch(spark), longest=longest).collect()}
    pairs = list(combinations(signed, 2))
    assert len(BUNDLES) == 56
    assert met == {p for p in pairs if shared(*p) >= 5} and kept == {p for p in pairs if shared(*p) >= 6}
    assert len(met) > len(kept) > 0


def test_very_long_texts_and_the_empty_table(spark, monkeypatch):
    from gneiss.llm import simhash

    long = " ".join(f"w{k % 7919}x{k % 13}" for k in range(200_000))
    assert fingerprint(long) % 2**64 == slow_fingerprint(long)  # more shingles than a chunk holds
    assert len(long.split()) > 2 * simhash._CHUNK
    assert drop_simhash_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (2, "A B C D", None)]
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1)]
    left = drop_simhash_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 1, 1] and left[0].fp == "x"
    assert simhash_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 1000 for i in range(1001, 1100)}
