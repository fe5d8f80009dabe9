import re

import numpy as np
import pytest

from gneiss.llm import licenses, registry

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
SF = "/root/testdata/sf0.01"
MIT = next(t for label, t, _ in licenses.TEMPLATES if label == "mit" and "granted" in t)
BSD = next(t for label, t, _ in licenses.TEMPLATES if label == "bsd-3")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def base(text):
    """Words, places, first and last place and labels of the base phrases, by looking at every place."""
    w, found = words(text), []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), sorted({label for _, label in found})


def brute_labels(texts, rare=6, slack=8, least=0.6):
    """Labels and scores by trying every beginning of every template in every text."""
    vocabulary = {w for _, t, keys in licenses.TEMPLATES for x in (t, *keys) for w in words(x)} | {w for p in PHRASES.values() for w in p.split()}
    split = [words(t) for t in texts]
    idf = {w: 1 + np.log((1 + len(texts)) / (1 + sum(w in s for s in split))) for w in vocabulary}
    out = []
    for text, w in zip(texts, split):
        own = dict.fromkeys(base(text)[4], 1.0)
        for label, t, keys in licenses.TEMPLATES:
            tw = words(t)
            chosen = sorted(set(w) & set(tw), key=lambda x: (-idf[x], x))[:rare]
            begins = [(i - j, x) for x in chosen for i, a in enumerate(w) if a == x for j, b in enumerate(tw) if b == x]
            for shift in (0, slack):
                for cell in {(b + shift) // (2 * slack) for b, _ in begins}:
                    inside = [(b, x) for b, x in begins if (b + shift) // (2 * slack) == cell]
                    if len({x for _, x in inside}) < (len(chosen) + 1) // 2:
                        continue
                    low, high = min(b for b, _ in inside), max(b for b, _ in inside)
                    span = w[max(0, low - slack) : max(0, high + len(tw) + slack)]
                    if all(any(span[i : i + len(k)] == k for i in range(len(span))) for k in map(words, keys)):
                        share = sum(min(tw.count(x), span.count(x)) * idf[x] for x in set(tw)) / sum(tw.count(x) * idf[x] for x in set(tw))
                        if share >= least:
                            own[label] = max(own.get(label, 0), share)
        out.append((sorted(own), max(own.values(), default=0.0)))
    return out


TEXTS = [
    "Released under the MIT License.",
    "UNDER the MIT\nlicense under the mit licenses, under_the-mit license",
    "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "This program is licensed under the terms of the GNU General Public License, version 2",
    "the public license of the gnu general was this version 3 of a work",
    "x " * 500 + MIT + " y" * 500,
    "x " * 300 + MIT.replace("including without limitation", "including but without any limitation at all").replace("sublicense", "sub-license") + BSD,
    MIT.replace("free of charge", "for a fee"),
    BSD.replace("Neither the name of", "Not the name of"),
    "licensed under the mit and the apache, not the license version 2",
    "überlizenz under the mıt license under the mit license",
    "This is free and unencumbered software released into the public domain.",
    None,
    "",
    " \t\n--",
]


def test_against_every_place(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows)
    for (k, text), (labels, score) in zip(rows, brute_labels(TEXTS)):
        r = found[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert (r.labels, pytest.approx(score)) == (labels, r.score)
    assert found[6].labels == ["mit"] and found[7].labels == ["bsd-3", "mit"] and found[3].labels == ["gpl-3"]
    assert found[5].labels == found[8].labels == found[9].labels == []


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute_labels(list(texts.values()))))
    got = registry.QUERIES["op13_licenses"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n_words, n_base, first, last, labels = base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n_words, n_base, first, last, ",".join(labels))
        assert (r.labels, pytest.approx(r.score)) == (",".join(want[r.doc_id][0]), want[r.doc_id][1])
    assert any("gpl-3" in r.labels for r in got)


def test_null_ids_repeated_rows_long_texts_and_names(spark):
    long = "filler " * 2_000_000 + MIT
    rows = [(None, TEXTS[0], "a"), (1, TEXTS[0], "b"), (1, TEXTS[0], "b"), (2, long, "c")]
    df = spark.createDataFrame(rows, "doc_id int, text string, labels string")
    got = licenses.scan_licenses(df).collect()
    assert sorted((r.doc_id or 0, r.n_base, tuple(r.labels)) for r in got) == [(0, 1, ("mit",)), (1, 1, ("mit",)), (1, 1, ("mit",)), (2, 0, ("mit",))]
    assert max(r.n_words for r in got) == 2_000_000 + len(words(MIT))


def test_empty_table(spark):
    out = licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == [] and out.columns[0] == "doc_id"


def test_a_word_that_stands_very_often(spark):
    text = "license " * 50_000 + "Released under the MIT License. " + "mit " * 50_000
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.first_word, r.labels, r.score) == (1, 50_001, ["mit"], 1.0)
