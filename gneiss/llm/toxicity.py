"""Toxicity by cumulative-link ordinal regression (operator 10).

Features are sparse: log counts of the words and word beginnings that tell toxic
labels from the rest.  Grades are 0 (not toxic), 1 and 2; labels say only whether a text is
toxic, so grades 1 and 2 split the toxic texts of the sample at the median
number of strongly telling words.  The proportional-odds model shares one weight
vector across the ordered thresholds: P(grade <= k) = sigmoid(threshold_k - w.x).
The result is the expected severity, between 0 and 2.

Fitting uses at most ``most`` labelled texts and ``vocabulary`` words, both
parameters; prediction reads whole texts.

Edge cases: a null or empty text has no word and gets the severity of an empty
text; without toxic labels, or with nothing but those, all severities are 0; of
several labels of one id the smallest counts, and equal texts are learned once, with
the label of the smallest id; rows with a null id are scored and never learned from;
repeated rows give repeated rows; an empty table gives an empty result; very long
texts are read whole.  severity, p_toxic, grade and toxic replace columns of docs
with these names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.samples import SparseRows, labelled_sample, sparse_counts, telling_words, word_features
from gneiss.llm.texts import map_texts


@dataclass
class OrdinalModel:
    place: dict
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, x: SparseRows) -> np.ndarray:
        """P(grade <= k) for each row and threshold."""
        return 1 / (1 + np.exp(np.clip(x.times(self.weights)[:, None] - self.thresholds, -40, 40)))

    def severity(self, texts: list) -> list[list]:
        if not len(self.thresholds):
            return [[0.0] * len(texts), [0.0] * len(texts), [0] * len(texts), [False] * len(texts)]
        out: list[list] = [[], [], [], []]
        for at in range(0, len(texts), 256):
            x = sparse_counts([word_features(t) for t in texts[at : at + 256]], self.place)
            over = 1 - self.at_most(x)
            for into, values in zip(out, (over.sum(axis=1), over[:, 0], (over >= 0.5).sum(axis=1), over[:, 0] >= 0.5)):
                into.extend(values.tolist())
        return out


def fit_ordinal(x: SparseRows, grade: np.ndarray, top: int, penalty: float = 1e-4, rounds: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the mean negative log-likelihood."""
    w = np.zeros(x.columns)
    share = np.clip([(grade <= k).mean() for k in range(top)], 0.02, 0.98)
    first = np.log(share / (1 - share))
    raw = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])  # gaps stay positive
    state = [np.zeros(len(w) + top), np.zeros(len(w) + top)]
    rows = np.arange(len(grade))
    weight = 1 / np.sqrt(np.bincount(grade, minlength=top + 1))[grade]  # rarer grades weigh more
    weight /= weight.sum()
    for t in range(1, rounds + 1):
        gaps = np.exp(raw[1:])
        cuts = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        below = np.zeros((len(grade), top + 2))
        below[:, 1:-1] = 1 / (1 + np.exp(np.clip(x.times(w)[:, None] - cuts, -40, 40)))
        below[:, -1] = 1
        slope = below * (1 - below)
        chance = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
        up, down = slope[rows, grade + 1] / chance, slope[rows, grade] / chance
        up, down = up * weight, down * weight
        score = up - down
        g_cuts = np.array([-(up * (grade == k)).sum() + (down * (grade == k + 1)).sum() for k in range(top)])
        tail = np.cumsum(g_cuts[::-1])[::-1]
        grad = np.concatenate([x.transposed_times(score) + penalty * w, tail[:1], tail[1:] * gaps])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-9)
        w, raw = w - step[: len(w)], raw - step[len(w) :]
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 8000, vocabulary: int = 400) -> OrdinalModel:
    """A model learned from the labelled texts; labels has (id, 0 or 1)."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("__toxic"))
    sample = labelled_sample(docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")), known, most, id_col).select("text", "__toxic")
    words = telling_words(sample, "__toxic", vocabulary)
    words = {w: by for w, by in words.items() if 1 in by}
    if not words:
        return OrdinalModel({}, np.zeros(0), np.zeros(0))
    place = {w: n for n, w in enumerate(sorted(words))}
    strong = {w for w, by in words.items() if by[1][1] > 10 * by[1][2]}

    def make():
        def features(texts):
            split = [word_features(t) for t in texts]
            known = [[w for w in words if w in place] for words in split]
            return [known, [float(sum(x in strong for x in w)) for w in known]]

        return features

    found = map_texts(sample, "text", "words array<binary>, strength double", make).collect()  # bounded by most
    found.sort(key=lambda r: (r["__toxic"], sorted(map(bytes, r.words))))
    x = sparse_counts([[bytes(w) for w in r.words] for r in found], place)
    toxic, strength = np.array([r["__toxic"] for r in found]), np.array([r.strength for r in found])
    grade = np.where(toxic == 1, 1 + (strength > np.median(strength[toxic == 1])), 0)
    return OrdinalModel(place, *fit_ordinal(x, grade, top=int(grade.max())))


def score_toxicity(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs without the text, with severity, p_toxic, grade and toxic (p_toxic >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the vocabulary
    return map_texts(docs, text_col, "severity double, p_toxic double, grade int, toxic boolean", lambda: OrdinalModel(**shared.value).severity)
