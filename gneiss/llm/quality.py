"""Quality rules: gradient-boosted trees over document statistics (operator 5).

Base statistics come from whole texts.  A booster is trained here on at most
``most`` labelled documents: histogram trees of small depth on the logistic loss,
with monotonic constraints on chosen features (a split that breaks one is not
taken, and the bounds of its children keep the whole tree monotone).  For scoring
all trees lie flat in numpy node arrays and a batch of rows walks down all of
them at once.

A document that fails the base rule is not kept; another is kept if the booster
gives it a chance of at least ``least`` to be good.

Edge cases: a null text counts as empty (no words, base_failed); rows with a null
id are judged but never learned from; of several labels of one id the smallest
counts and equal texts are learned once; of equal gains the first feature and cut
split; repeated rows are judged alike; an empty table gives an empty result; very
long texts are read whole; the columns made replace columns of docs with their names; without labels of both kinds the booster
gives every document an even chance, which keeps it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.samples import labelled_sample
from gneiss.llm.texts import map_texts

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Features in order, with the sign of their monotonic constraint (0: none).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "words_per_line": 0,
    "distinct_share": 0,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that the text holds twice or more; each word counts once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():  # equal windows have equal codes
        return 0
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = 1
    while width < window:  # exact ranks of windows of 2, 4, 8 words
        pair = rank[:-width] * len(words) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the features of a text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(words)
    chars = len(text) - int(counts[list(SPACES)].sum())
    symbols = int(counts[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    some = max(1, n)
    features = [
        float(np.log1p(n)), chars / some, symbols / some, dup / max(1, len(lines)), repeat / some, upper / max(1, upper + lower),
        digits / max(1, chars), marks / max(1, chars), n / max(1, len(lines)), len(set(words)) / some,
    ]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class FlatTrees:
    """Nodes of all trees in flat arrays; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, smallest: float = 2.0) -> FlatTrees:
    """Gradient boosting of y (0 or 1); signs are the monotonic constraints of the columns of x."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), base)
    nodes: list[list] = []  # feature, cut, left, right, value
    roots = []

    def leaf(g, h, low, high):
        return float(np.clip(-g / (h + penalty), low, high))

    def grow(rows, g, h, level, low, high):
        sums = g[rows].sum(), h[rows].sum()
        here = len(nodes)
        nodes.append([0, np.inf, here, here, leaf(*sums, low, high) * rate])
        best = None
        if level < depth:
            for f, sign in enumerate(signs):
                size = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                gr, hr = sums[0] - gl, sums[1] - hl
                vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
                gain = -(gl * vl + 0.5 * (hl + penalty) * vl**2) - (gr * vr + 0.5 * (hr + penalty) * vr**2)
                gain[(hl < smallest) | (hr < smallest) | (sign * (vr - vl) < 0)] = -np.inf
                if len(gain) and (best is None or gain.max() > best[0]):
                    k = int(gain.argmax())
                    best = (gain[k], f, k, float(vl[k]), float(vr[k]))
        own = leaf(*sums, low, high)
        if best is not None and best[0] > 1e-6 - (sums[0] * own + 0.5 * (sums[1] + penalty) * own**2):
            _, f, k, vl, vr = best
            go = binned[rows, f] <= k
            middle, sign = (vl + vr) / 2, signs[f]
            bounds = [(low, high), (low, high)] if not sign else [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)]
            a = grow(rows[go], g, h, level + 1, *bounds[0])
            b = grow(rows[~go], g, h, level + 1, *bounds[1])
            nodes[here] = [f, cuts[f][k], a, b, 0.0]
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -8.0, 8.0))
        first = roots[-1]
        node = np.full(len(y), first)
        for _ in range(depth):
            f = np.array([n[0] for n in nodes[first:]])[node - first]
            at = np.array([n[1] for n in nodes[first:]])[node - first]
            node = np.where(x[np.arange(len(y)), f] <= at, np.array([n[2] for n in nodes[first:]])[node - first], np.array([n[3] for n in nodes[first:]])[node - first])
        total += np.array([n[4] for n in nodes[first:]])[node - first]
    flat = [np.array(c) for c in zip(*nodes)]
    return FlatTrees(flat[0].astype(int), flat[1].astype(float), flat[2].astype(int), flat[3].astype(int), flat[4].astype(float), np.array(roots), depth, base)


EVEN = FlatTrees(np.zeros(1, int), np.full(1, np.inf), np.zeros(1, int), np.zeros(1, int), np.zeros(1), np.zeros(1, int), 0, 0.0)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 8000) -> FlatTrees:
    """A booster learned from at most ``most`` labelled documents; labels has (id, 0 or 1)."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("__good"))
    sample = labelled_sample(docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")), known, most, id_col)
    found = map_texts(
        sample.select("text", "__good"), "text", "features array<double>", lambda: lambda texts: [[statistics(t)[1] for t in texts]]
    ).collect()  # bounded by most
    found.sort(key=lambda r: (r.features, r["__good"]))
    y = np.array([r["__good"] for r in found], float)
    if len(set(y.tolist())) < 2:
        return EVEN
    return fit_trees(np.array([r.features for r in found]), y, list(FEATURES.values()))


def judge_quality(docs: DataFrame, model: FlatTrees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs without the text, with the base statistics, base_failed, p_good and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded: trees x nodes

    def make():
        trees = FlatTrees(**shared.value)

        def judge(texts):
            found = [statistics(t) for t in texts]
            chance = trees.chance(np.array([f for _, f in found])).tolist() if found else []
            return [*map(list, zip(*(b for b, _ in found))), chance] if found else [[]] * (len(BASE) + 1)

        return judge

    out = map_texts(docs, text_col, ", ".join(f"{c} long" for c in BASE) + ", p_good double", make)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= least))
