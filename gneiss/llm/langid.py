"""Language identification by nearest centroid (operator 7).

A text becomes a vector of hashed character n-grams (2 to 4 UTF-8 bytes of the
lower-cased letters), weighted by square root of count times inverse document
frequency and scaled to length one.  The vectors of each language are clustered
into a few centroids (spherical k-means); a text takes the language of the
centroid with the largest cosine.  A text is rejected when that cosine is below
what labelled texts of the language and about its length reach when they are left
out of the centroids: the training texts are dealt into folds, the centroids of
the other folds judge beginnings of several lengths of each, and a low quantile
by language and length is the threshold, interpolated by the number of n-grams.

Fitting uses at most ``per_language`` labelled texts of each language (a bounded
sample, the first by a hash; there is one centroid set per distinct language).  Prediction reads
whole texts.

Edge cases: equal cosines go to the first centroid, in the order of language names;
repeated rows are judged alike; an empty table gives an empty result; the columns
made replace columns of docs with their names; very long texts are read whole; a
null text or one without a letter is ``und`` with score 0 and
rejected; rows with null labels are predicted and never learned from; without
any labelled row every prediction is ``und``.  Where a language has fewer than
``LEAST_TEXTS`` texts of a length, those of all languages give its threshold; no
threshold is below a quarter of the low quantile of the language's learned texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import map_texts

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))

#: Characters of the beginnings that thresholds are learned on.
LENGTHS = (8, 16, 40, 100, 250, 600, 1500, 4000)
LEAST_TEXTS = 20


def gram_counts(text: str, dims: int) -> np.ndarray:
    """Counts of hashed n-grams of 2 to 4 bytes."""
    raw = b" %b " % b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    total = np.zeros(dims, np.int64)
    mixed = codes * _FACTORS[0]
    for n in (1, 2, 3):
        if len(codes) <= n:
            break
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * _FACTORS[n] + codes[n:] * _FACTORS[0]
        total += np.bincount(mixed >> shift, minlength=dims)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    languages: list
    owner: np.ndarray  # index of the language of each centroid
    centroids: np.ndarray  # one row each
    idf: np.ndarray
    least: list  # by language: (logs of numbers of n-grams, cosines below which a text of so many is rejected)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts, dtype=np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list) -> tuple[list, list, list]:
        names, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        todo = [n for n, t in enumerate(texts) if self.languages and has_letter(t)]
        for at in range(0, len(todo), 64):
            part = todo[at : at + 64]
            counts = np.stack([gram_counts(texts[n], len(self.idf)) for n in part])
            cosines = self.vectors(counts) @ self.centroids.T
            best = cosines.argmax(axis=1)
            sizes = np.log(np.maximum(counts.sum(axis=1), 1))
            for n, k, cosine, size in zip(part, best, cosines[np.arange(len(part)), best], sizes):
                names[n] = self.languages[self.owner[k]]
                scores[n] = float(min(1.0, max(0.0, cosine)))
                rejected[n] = bool(scores[n] < np.interp(size, *self.least[self.owner[k]]))
        return names, scores, rejected


def _clusters(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[nearest == j].sum(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _centroids(counts: np.ndarray, of: np.ndarray, names: list, clusters: int, seed: int) -> LanguageModel:
    """A model without thresholds of texts with these counts and languages."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    model = LanguageModel(names, np.zeros(0, int), np.zeros((0, len(idf)), np.float32), idf, [([0.0], [0.0])] * len(names))
    x = model.vectors(counts)
    rng = np.random.default_rng(seed)
    parts = [_clusters(x[of == k], clusters, 12, rng) if (of == k).any() else x[:0] for k in range(len(names))]
    model.owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    model.centroids = np.concatenate(parts).astype(np.float32)
    return model


def _thresholds(whole: LanguageModel, counts: np.ndarray, heads: list, of: np.ndarray, clusters: int, seed: int, folds: int, quantile: float, slack: float) -> list:
    """By language the points of its threshold, from texts that the judging centroids have not seen."""
    names = whole.languages
    fold = np.random.default_rng(seed).permutation(len(of)) % folds
    seen: dict = {}
    for f in range(folds):
        model = _centroids(counts[fold != f], of[fold != f], names, clusters, seed)
        for size in LENGTHS:
            at = [n for n in np.flatnonzero(fold == f) if len(heads[n]) >= size and has_letter(heads[n][:size])]
            if at:
                grams = np.stack([gram_counts(heads[n][:size], counts.shape[1]) for n in at])
                cosines = model.vectors(grams) @ model.centroids.T
                for n, row, total in zip(at, cosines, grams.sum(axis=1)):
                    own = row[model.owner == of[n]]
                    if len(own):
                        seen.setdefault((of[n], size), []).append((np.log(max(total, 1)), own.max()))
    out = []
    for k in range(len(names)):
        places, least = [0.0], [0.0]
        for size in LENGTHS:
            found = np.array(seen.get((k, size), []))
            if len(found) < LEAST_TEXTS:
                found = np.array([x for j in range(len(names)) for x in seen.get((j, size), [])])
            if len(found) >= LEAST_TEXTS and np.median(found[:, 0]) > places[-1]:
                places.append(float(np.median(found[:, 0])))
                least.append(float(slack * np.quantile(found[:, 1], quantile)))
        own = (whole.vectors(counts[of == k]) @ whole.centroids[whole.owner == k].T).max(axis=1)
        floor = float(np.quantile(own, 0.005)) / 4  # all there is where too few texts could be left out
        least = [max(x, floor) for x in least]
        out.append((places, least))
    return out


def fit_languages(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 400, clusters: int = 4, dims: int = 8192, slack: float = 0.8, seed: int = 7, quantile: float = 0.01, folds: int = 4
) -> LanguageModel:
    """A model learned from about per_language of the rows whose text and language are not null."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    nothing = LanguageModel([], np.zeros(0, int), np.zeros((0, dims), np.float32), np.ones(dims, np.float32), [])
    lang = F.col(lang_col).alias("lang")
    dice = F.xxhash64(F.lit(seed), id_col, F.col(text_col)).alias("dice")
    # the first texts of each language by the hash; every task keeps per_language rows of a language before the shuffle
    order = F.row_number().over(Window.partitionBy("lang").orderBy("dice"))
    chosen = rows.select(lang, dice).withColumn("place", order).where(F.col("place") <= per_language)
    chosen = Scratch(docs.sparkSession).keep(chosen.select("lang", "dice").distinct())
    few = rows.select(lang, dice, F.col(text_col).alias("text")).join(chosen, ["lang", "dice"]).dropDuplicates(["lang", "dice"])
    few = few.select("lang", F.substring("text", 1, LENGTHS[-1]).alias("head"), "text")

    def make():
        return lambda texts: [[np.minimum(gram_counts(t, dims), 65535).astype(np.uint16).tobytes() if has_letter(t) else None for t in texts]]

    found = map_texts(few, "text", "grams binary", make).where("grams is not null").collect()  # at most per_language rows a language
    found.sort(key=lambda r: (r.lang, bytes(r.grams), r["head"]))
    names = sorted({r.lang for r in found})
    if not found:
        return nothing
    counts = np.stack([np.frombuffer(r.grams, np.uint16) for r in found])
    of = np.array([names.index(r.lang) for r in found])
    model = _centroids(counts, of, names, clusters, seed)
    model.least = _thresholds(model, counts, [r.head for r in found], of, clusters, seed, folds, quantile, slack)
    return model


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", made: tuple[str, str, str] = ("lang_pred", "score", "rejected"), keep_text: bool = False) -> DataFrame:
    """docs, without the text unless keep_text, with the columns made: prediction, score and whether it is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded: languages x clusters x dims
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in zip(made, ("string", "double", "boolean")))
    return map_texts(docs, text_col, kinds, lambda: LanguageModel(**shared.value).predict, keep_text)


def is_held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1):
    """True for ids whose CRC-32, as text, leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
