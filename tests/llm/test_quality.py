import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gneiss.llm import quality, registry

SF = "/root/testdata/sf0.01"


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    held = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            held |= set(range(i, i + 8))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(held)]


def test_base_statistics_match_definition():
    texts = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()
    texts = [t for t in texts if len(t) < 4000][:250]
    texts += [None, "", " ", "a\n\na \nb\na ", "x " * 30, "é ü #<\x0b>", "a b c d e f g h " * 3 + "i", "a " * 8, "a " * 9]
    for t in texts:
        assert quality.statistics(t)[0] == slow_base(t), repr(t)[:80]


def test_trees_are_monotone_and_flat_walk_matches():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(1500, 3))
    y = (rng.uniform(size=1500) < 1 / (1 + np.exp(6 * x[:, 0] - 3 + 3 * np.sin(9 * x[:, 1])))).astype(float)
    trees = quality.fit_trees(x, y, [-1, 0, 1], trees=25)
    grid = np.linspace(0, 1, 60)
    for _ in range(25):
        row = rng.uniform(size=3)
        for f, sign in ((0, -1), (2, 1)):
            many = np.tile(row, (60, 1))
            many[:, f] = grid
            assert (sign * np.diff(trees.chance(many)) >= -1e-12).all()

    def walk(r):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if r[trees.feature[node]] <= trees.cut[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.chance(x[:50]), [walk(r) for r in x[:50]])
    assert ((trees.chance(x) > 0.5) == (y > 0.5)).mean() > 0.7


def test_query_and_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.judge_quality(docs.select("doc_id", "text"), model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.93
    assert registry.op5_quality(spark, SF).columns[:7] == ["doc_id", *quality.BASE, "p_good"]


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "word " * 40, 5), (3, "a b c d e f g h i j k l m n o p q r s t u", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = {r.doc_id: r for r in quality.judge_quality(docs, quality.EVEN).collect()}
    assert [got[k].base_failed for k in (1, 2, None, 3)] == [True, True, True, False] and got[3].kept
    assert quality.judge_quality(docs.limit(0), quality.EVEN).count() == 0
    assert quality.fit_quality(docs, docs.select("doc_id", F.lit(1).alias("quality"))) is quality.EVEN
