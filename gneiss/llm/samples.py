"""Bounded samples of labelled rows, and words that tell labels apart.

A classifier may be fitted on a bounded sample; the bounds are parameters of the
operators.  The rows are chosen by a hash of their id, so a sample is the same in
every run, and only ids travel until the choice is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import map_texts

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased runs of letters and digits; other characters of more than one byte count as letters."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def word_features(text: str | None) -> list[bytes]:
    """The words of a text and, marked by their length, the 5- to 8-byte beginnings of its longer words."""
    words = plain_words(text)
    return words + [b"%d%b" % (n, w[:n]) for n in (5, 6, 7, 8) for w in words if len(w) > n]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """At most ``most`` rows of docs (id, text) with their labels (labels has two columns), equal texts and ids once.

    Of several labels of an id the smallest counts, of several texts of an id the
    smallest, and of several ids of a text the smallest with its label.
    """
    label = next(c for c in labels.columns if c != id_col)
    ids = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias(label))
    present = ids.join(docs.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, "left_semi")
    few = present.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(most)
    texts = docs.join(F.broadcast(few), id_col)  # few has at most ``most`` rows
    alone = texts.groupBy(id_col).agg(F.min(F.struct("text", label)).alias("row")).select(id_col, "row.*")
    return alone.groupBy("text").agg(F.min(F.struct(id_col, label)).alias("row")).select("row.*", "text")


def telling_words(sample: DataFrame, label_col: str, size: int, least_docs: int = 3, least_gain: float = 20.0, text_col: str = "text") -> dict:
    """The words and word beginnings that more documents of one label hold than of the others.

    Returns {word: {label: (gain, share inside, share outside)}} for the ``size``
    largest gains of each label; the gain is the log-likelihood ratio statistic.
    """
    words = map_texts(
        sample.select(text_col, F.col(label_col).alias("label")), text_col, "words array<binary>", lambda: lambda texts: [[list(set(word_features(t))) for t in texts]]
    )
    words = Scratch(sample.sparkSession).keep(words)  # bounded by the sample
    totals = {r.label: r.n for r in words.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = sorted(totals)
    counts = words.select("label", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(*[F.count(F.when(F.col("label") == F.lit(y), 1)).alias(f"n{k}") for k, y in enumerate(names)], F.count("*").alias("all"))
    counts = counts.where(F.col("all") >= least_docs)
    whole = sum(totals.values())

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    chosen: dict = {}
    for k, y in enumerate(names):
        n, a, both = totals[y], F.col(f"n{k}"), F.col("all")
        b, m = both - a, whole - n
        gain = part(a, both * n / whole) + part(n - a, (whole - both) * n / whole)
        gain = 2 * (gain + (part(b, both * m / whole) + part(m - b, (whole - both) * m / whole) if m else F.lit(0.0)))
        p, q = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
        best = counts.where(a >= least_docs).select("word", gain.alias("gain"), p.alias("p"), q.alias("q"))
        for r in best.where(f"p > q and gain >= {least_gain}").orderBy(F.desc("gain"), "word").limit(size).collect():
            chosen.setdefault(bytes(r.word), {})[y] = (r.gain, r.p, r.q)
    return chosen


def word_counts(words: list[bytes], place: dict[bytes, int], size: int) -> np.ndarray:
    """log(1 + count) of each word of a vocabulary."""
    found = [place[w] for w in words if w in place]
    return np.log1p(np.bincount(found, minlength=size)).astype(np.float32)


@dataclass
class SparseRows:
    """Rows of a sparse matrix: the columns and values of all rows, and the row of each."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    columns: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.rows)

    def transposed_times(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * s[self.row], self.columns)


def sparse_counts(texts: list[list[bytes]], place: dict[bytes, int]) -> SparseRows:
    """log(1 + count) of the words of a vocabulary that each text holds."""
    size = max(1, len(place))
    parts = [np.array([place[w] for w in words if w in place], np.int64) + n * size for n, words in enumerate(texts)]
    cells, counts = np.unique(np.concatenate([np.empty(0, np.int64), *parts]), return_counts=True)
    return SparseRows(cells // size, cells % size, np.log1p(counts), len(texts), len(place))
