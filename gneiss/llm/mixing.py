"""Mixing domains to target weights by soft membership (operator 9).

A classifier learned from a table of labelled documents gives every document
posteriors over the domains.  Nonnegative document rates are then fitted so that
the expected tokens of each domain, the sum of rate x tokens x posterior, meet
its target: projected gradient on the least squares of the relative gaps, scaled
by each domain's natural tokens.  A step needs one vector with an entry per
domain, gathered by a distributed sum; rates are replayed from these vectors, so
nothing per document is kept between steps.

The token budget defaults to the largest that asks no domain for more than it
has, so rates stay near or below one.

Features of the classifier (softmax regression): log counts of words and word
beginnings that tell the domains apart, and shares of character kinds.  It is
fitted on at most ``most`` labelled texts; rates and totals use all documents.

Edge cases: a null or empty text has no token, gets posteriors like any other
and moves no total; an empty table gives an empty result; a domain without
labelled text cannot be predicted and has no tokens, its target cannot be met;
without any labelled text every rate is one.  Targets that the posteriors
cannot reach with nonnegative rates are approached in ``rounds`` steps, and a report
shows what was reached.  Rates may pass one by a little; who draws documents by their
rates takes those as one.  Repeated rows get equal rates; of several labels of one id
the smallest counts; very long texts are read whole; the columns made replace columns
of docs with their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.samples import labelled_sample, telling_words, word_counts, word_features
from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import map_texts

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*", b"|", b"!", b" \t", b"\n"]


@dataclass
class DomainModel:
    domains: list
    place: dict
    weights: np.ndarray  # (features + 1, domains)

    def features(self, texts: list) -> np.ndarray:
        rows = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            shares = [sum(raw.count(bytes([b])) for b in kind) / max(1, len(raw)) for kind in _KINDS]
            rows.append(np.concatenate([word_counts(word_features(text), self.place, len(self.place)), shares, [1.0]]))
        return np.stack(rows) if rows else np.zeros((0, len(self.place) + len(_KINDS) + 1))

    def posteriors(self, texts: list) -> np.ndarray:
        out = np.zeros((len(texts), len(self.domains)))
        for at in range(0, len(texts), 256):
            score = self.features(texts[at : at + 256]) @ self.weights
            score = np.exp(score - score.max(axis=1, keepdims=True))
            out[at : at + 256] = score / score.sum(axis=1, keepdims=True)
        return out


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", most: int = 6000, vocabulary: int = 150, rounds: int = 500) -> DomainModel | None:
    """A softmax regression learned from at most ``most`` labelled texts; labelled has (id, domain).  None without any."""
    known = labelled.where(F.col(domain_col).isNotNull()).select(id_col, F.col(domain_col).alias("__domain"))
    sample = labelled_sample(docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")), known, most, id_col).select("text", "__domain")
    sample = Scratch(docs.sparkSession).keep(sample)
    words = sorted(telling_words(sample, "__domain", vocabulary))
    model = DomainModel([], {w: n for n, w in enumerate(words)}, np.zeros((0, 0)))

    def make():
        return lambda texts: [[row.astype(np.float32).tobytes() for row in model.features(texts)]]

    found = map_texts(sample, "text", "x binary", make).collect()  # bounded by most
    found.sort(key=lambda r: (r["__domain"], bytes(r.x)))
    if not found:
        return None
    x = np.stack([np.frombuffer(r.x, np.float32) for r in found]).astype(float)
    model.domains = sorted({r["__domain"] for r in found})
    y = np.array([model.domains.index(r["__domain"]) for r in found])
    w, first, second = np.zeros((x.shape[1], len(model.domains))), 0.0, 0.0
    target = np.eye(len(model.domains))[y]
    for t in range(1, rounds + 1):
        score = x @ w
        p = np.exp(score - score.max(axis=1, keepdims=True))
        grad = x.T @ (p / p.sum(axis=1, keepdims=True) - target) / len(x) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    model.weights = w
    return model


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text", made: tuple[str, str] = ("n_tokens", "posterior"), keep_text: bool = False) -> DataFrame:
    """docs, without the text unless keep_text, with tokens (runs without white space) and posteriors (array, in the order of model.domains)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by the vocabulary

    def make():
        domain_model = DomainModel(**shared.value)
        return lambda texts: [[len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], domain_model.posteriors(texts).tolist()]

    return map_texts(docs, text_col, f"`{made[0]}` long, `{made[1]}` array<double>", make, keep_text)


def rate_of(posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after the given steps from one: step by step less posterior . step, never below zero."""
    moves = [F.array(*[F.lit(float(v)) for v in step]) for step in steps]
    rate = F.lit(1.0)
    if not moves:
        return rate

    def after(r: Column, move: Column) -> Column:
        return F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(posterior, move, lambda p, m: p * m), F.lit(0.0), lambda s, v: s + v))

    return F.aggregate(F.array(*moves), rate, after)


def _totals(rows: DataFrame, rate: Column, size: int) -> np.ndarray:
    got = rows.agg(*[F.coalesce(F.sum(rate * F.col("n_tokens") * F.col("posterior")[k]), F.lit(0.0)) for k in range(size)]).first()
    return np.array(got, float)


def fit_rates(rows: DataFrame, targets: list[float], budget: float | None = None, rounds: int = 30, tolerance: float = 1e-3) -> tuple[list[list[float]], np.ndarray, np.ndarray]:
    """(steps, wanted totals, reached totals) for rows with n_tokens and posterior; targets are the weights of the domains."""
    weights = np.array(targets, float) / sum(targets)
    natural = _totals(rows, F.lit(1.0), len(weights))
    some = (natural > 0) & (weights > 0)
    if not some.any():
        return [], np.zeros(len(weights)), natural
    if budget is None:
        budget = float((natural[some] / weights[some]).min())
    wanted = budget * weights
    steps: list[list[float]] = []
    reached = natural
    for _ in range(rounds):
        gap = (reached - wanted) / np.maximum(natural, 1e-12) * (natural > 0)
        if np.abs(gap).max() <= tolerance:
            break
        steps.append(gap.tolist())
        reached = _totals(rows, rate_of(F.col("posterior"), steps), len(weights))
    return steps, wanted, reached


def mix_to_targets(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain",
    made: tuple[str, str, str] = ("n_tokens", "posterior", "rate"), keep_text: bool = False, report: list | None = None, **how,
) -> DataFrame:
    """docs, without the text unless keep_text, with tokens, posterior (map by domain) and rate, named as in made.

    To report, if given, is added a dict for each domain with its natural tokens
    and those wanted and reached: targets that rates cannot meet show there.
    """
    spark = docs.sparkSession
    model = fit_domains(docs, labelled, id_col, text_col, domain_col, **how)
    tokens, posterior, rate = made
    if model is None:
        counted = map_texts(docs, text_col, f"`{tokens}` long", lambda: lambda texts: [[len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]], keep_text)
        return counted.withColumn(posterior, F.lit(None).cast("map<string,double>")).withColumn(rate, F.lit(1.0))
    rows = Scratch(spark).keep(with_posteriors(docs, model, text_col, (tokens, posterior), keep_text))
    parts = rows.select(F.col(tokens).alias("n_tokens"), F.col(posterior).alias("posterior"))
    steps, wanted, reached = fit_rates(parts, [targets.get(d, 0.0) for d in model.domains])
    if report is not None:
        natural = _totals(parts, F.lit(1.0), len(model.domains))
        report += [{"domain": d, "natural": n, "wanted": w, "reached": r} for d, n, w, r in zip(model.domains, natural.tolist(), wanted.tolist(), reached.tolist())]
    names = F.array(*[F.lit(d) for d in model.domains])
    rated = rows.withColumn(rate, rate_of(F.col(posterior), steps))
    return rated.withColumn(posterior, F.map_from_arrays(names, F.col(posterior)))


#: Domains of the queries, from the labels table, and the shares of tokens they are to have.
TARGETS = {"clean": 0.85, "low": 0.06, "toxic": 0.09}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else low or clean by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def draw(id_col: Column, seed: int = 13) -> Column:
    """A fixed number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / float(1 << 30)
