import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import lines, registry

SF = "/root/testdata/sf0.001"


def normal(line):
    return " ".join(line.lower().split())


def shingles(line, width=5):
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def slow(rows, least=0.8):
    """Text by (id, text) with the lines of each component but the first cut out."""
    places = [(i, n, k, normal(x)) for n, (i, t) in enumerate(rows) if i is not None and t is not None for k, x in enumerate(t.split("\n")) if normal(x)]
    names = sorted({p[3] for p in places})
    sets = [shingles(x) for x in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if len(sets[a]) * 0.8 <= len(sets[b]) <= len(sets[a]) / 0.8 and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    of = {x: find(n) for n, x in enumerate(names)}
    best = {}
    for i, n, k, x in sorted(places, key=lambda p: (p[0], p[1], p[2])):
        best.setdefault(of[x], (i, n, k))
    gone = {(n, k) for i, n, k, x in places if best[of[x]] != (i, n, k)}
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in gone) for n, (_, t) in enumerate(rows)]


def variants(rnd, base, count):
    words = base.split()
    for _ in range(count):
        w = list(words)
        w[rnd.randrange(len(w))] = rnd.choice(["alpha", "beta", "gamma", "delta"])
        yield " ".join(w)


@pytest.mark.parametrize("longest", [2, 40])
def test_matches_brute_force(spark, longest):
    rnd = random.Random(3)
    base = [" ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)) for n in (20, 40, 60)]
    made = [v for b in base for v in variants(rnd, b, 25)] + ["Short", "short ", "SHORT", "tiny", "a b", "A  b", "é", ""]
    rnd.shuffle(made)
    rows = [(i, "\n".join(made[3 * i : 3 * i + 3]) + rnd.choice(["", "\n", "\n \n"])) for i in range(len(made) // 3)] + [(90, None), (91, ""), (None, "short"), (92, "\n\n")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, line string")
    got = {r.doc_id: r.text for r in lines.drop_duplicate_lines(docs, longest=longest).collect()}
    assert got == {i: t for (i, _), t in zip(rows, slow(rows))}
    far = {r.doc_id: r.text for r in lines.drop_duplicate_lines(docs, longest=longest, broadcast_bytes=0).collect()}
    assert far == got


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in lines.drop_duplicate_lines(docs).collect()}
    want = dict(zip((i for i, _ in rows), slow(rows)))
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one line here\n \nand"), (1, "one line here\n \nand"), (2, "one line here\nother")], "doc_id long, text string")
    got = sorted(lines.drop_duplicate_lines(docs, dropped_col="cut").collect())
    assert [(r.text, r.cut) for r in got] == [(" ", 2), ("one line here\n \nand", 0), ("other", 1)]
    assert lines.drop_duplicate_lines(docs.limit(0)).count() == 0
    row = registry.op2_line_dedup(spark, SF).agg(F.count("*"), F.sum("n_lines"), F.sum("n_dropped")).first()
    assert row[0] == 200 and 0 < row[2] < row[1]


def test_clashing_names_and_null_columns(spark):
    kind = "doc_id long, text string, id long, h string, gone_lines string, GONE_ID long, copy_number int, cut string"
    rows = [(1, "one line here", None, "x", "y", 5, 1, "z"), (2, "ONE line  here\nother", 7, None, None, None, None, None)]
    got = sorted(lines.drop_duplicate_lines(spark.createDataFrame(rows, kind), dropped_col="cut").collect())
    assert [tuple(r) for r in got] == [(1, "one line here", None, "x", "y", 5, 1, 0), (2, "other", 7, None, None, None, None, 1)]


def test_very_long_line(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 700)
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(1500)]
    near = " ".join(words[:700] + ["changed"] + words[701:])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.drop_duplicate_lines(docs).collect()} == {1: " ".join(words), 2: "", 3: "short"}


def edited(rnd, line, least):
    """The line with words replaced while its similarity stays at or above least; None if one replacement is too much."""
    words, last = line.split(), None
    for k in rnd.sample(range(len(words)), len(words)):
        words[k] = "".join(rnd.choices("klmnop", k=len(words[k])))
        if len(shingles(line) & shingles(" ".join(words))) < least * len(shingles(line) | shingles(" ".join(words))):
            return last
        last = " ".join(words)
    return last


@pytest.mark.parametrize("size", [18, 40, 120, 600])
def test_pair_recall_at_the_threshold(size):
    rnd = random.Random(size)
    signer, found, total = lines.Signer(), 0, 0
    while total < 300:
        line = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(size))
        other = edited(rnd, line, 0.8)
        if other is not None:
            keys, sketches = lines.line_signer(signer, 5, [line, other])
            bits = int(np.bitwise_xor(*sketches.view(np.uint64))).bit_count()
            found += bool((keys[0] == keys[1]).any()) and bits <= lines.MOST_BITS
            total += 1
    assert found >= 0.93 * total


def test_prefix_join_misses_no_pair(spark):
    rnd = random.Random(9)
    shared = " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(20))
    made = [shared + " " + " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(80)]
    made += list(variants(rnd, made[0], 8)) + list(variants(rnd, made[1], 8))
    pending = spark.createDataFrame([(0, n, 0, len(made), n) for n in range(len(made))], "key long, c long, s long, n long, root long")
    texts = spark.createDataFrame(list(enumerate(made)), "c long, normal string")
    from gneiss.llm.scratch import Scratch

    got = {(r.a, r.b) for r in lines._prefix_pairs(pending, texts, Scratch(spark), 0.8, lambda: lines.Verifier(5)).collect()}
    want = {(a, b) for a in range(len(made)) for b in range(a + 1, len(made)) if lines.exact_jaccard(made[a], made[b], 5) >= 0.8}
    assert want <= got and len(got) < 0.5 * len(made) ** 2 / 2


def test_prefix_join_tells_long_lines_apart(spark):
    """Long lines that share rare shingles but are not similar are no candidates."""
    from gneiss.llm.scratch import Scratch

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    body, choices = " ".join(word() for _ in range(90)), [[word() for _ in range(4)] for _ in range(60)]
    made = [body + " " + " ".join(rnd.choice(c) for c in choices) for _ in range(60)]
    made += [made[n].replace(choices[0][0], word()).replace(body[:6], word()) for n in range(5)]
    pending = spark.createDataFrame([(0, n, 0, len(made), n) for n in range(len(made))], "key long, c long, s long, n long, root long")
    texts = spark.createDataFrame(list(enumerate(made)), "c long, normal string")
    got = {(r.a, r.b) for r in lines._prefix_pairs(pending, texts, Scratch(spark), 0.8, lambda: lines.Verifier(5)).collect()}
    want = {(a, b) for a in range(len(made)) for b in range(a + 1, len(made)) if lines.exact_jaccard(made[a], made[b], 5) >= 0.8}
    assert len(want) >= 5 and want <= got
    assert len(got) < 2 * len(want)


@pytest.mark.parametrize("block", [7, 1024])
def test_pairs_are_made_within_lists_alone(spark, monkeypatch, block):
    """The work follows the lists: what only shares shingles with classes of other lists is not compared."""
    from gneiss.llm.scratch import Scratch

    monkeypatch.setattr(lines, "BLOCK", block, raising=False)
    rnd = random.Random(6)
    base = " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(40))
    made = [" ".join("".join(rnd.choices("abcdefghij", k=6)) if rnd.random() < 0.06 else w for w in base.split()) for _ in range(90)]
    of = [n % 3 for n in range(90)]  # the list of each
    root = [n - n % 2 for n in range(90)]
    pending = spark.createDataFrame([(of[n], n, 0, 30, root[n]) for n in range(90)] + [(9, n, 0, 2, root[n]) for n in (0, 4)], "key long, c long, s long, n long, root long")
    texts = spark.createDataFrame(list(enumerate(made)), "c long, normal string")
    got = [(r.a, r.b) for r in lines._prefix_pairs(pending, texts, Scratch(spark), 0.8, lambda: lines.Verifier(5)).collect()]
    inside = {(a, b) for a in range(90) for b in range(a + 1, 90) if root[a] != root[b] and (of[a] == of[b] or (a, b) == (0, 4))}
    want = {(a, b) for a, b in inside if lines.exact_jaccard(made[a], made[b], 5) >= 0.8}
    assert len(got) == len(set(got)) and want and want <= set(got) <= inside


def test_bins_estimate_similarity():
    rnd = random.Random(1)
    signer = lines.Signer(100, 4, 1)
    for n in (60, 900):
        base = " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n))
        words = base.split()
        for k in range(0, n, 25):
            words[k] = "other"
        other = " ".join(words)
        sig = signer.bins(*lines.shingle_codes([base, other, base], 9))
        both = (sig[0] < lines._EMPTY) | (sig[1] < lines._EMPTY)
        assert abs((sig[0] == sig[1])[both].mean() - lines.exact_jaccard(base, other, 9)) < 0.08
        assert np.array_equal(sig[0], sig[2])


@pytest.mark.parametrize("width", [1, 3, 8, 9])
def test_shingles_are_those_of_each_line(width):
    made = ["abcdefghijkl", "abc", "xabcdefghijk", "é"]
    codes, starts = lines.shingle_codes(made, width)
    per = [c.tolist() for c in np.split(codes, starts[1:])]
    sets = [[x[i : i + width] for i in range(max(1, len(x) - width + 1))] for x in made]
    assert [len(c) for c in per] == [len(s) for s in sets]
    pairs = {(a, b) for c, s in zip(per, sets) for a, b in zip(c, s)}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
