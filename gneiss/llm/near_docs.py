"""Near-duplicate documents of the pipeline's SimHash stage.

Documents at a Jaccard similarity of 0.8 differ in about ten of 64 SimHash bits,
where no index of positional bytes guarantees a match, so the SimHash operator
(within two bits) finds only nearly equal texts.  The stage keeps its links and
adds those of the pairs whose sets of word shingles have at least the given
Jaccard similarity: documents with equal words are one class, MinHash bands of the
shingle sets give candidates, and these are verified on their whole sets, as
lines are (gneiss/llm/lines.py).

Edge cases: words are those of the SimHash; a text of fewer words than a shingle is
one shingle; a text without a word has no shingle and no Jaccard link; rows with a
null id stay and take no part; rows with one id stay or go together, so repeated rows
of a kept id stay repeated; a very long text is one set of shingles, made alone in its
batch; a similarity of exactly the threshold links, and of a group the smallest id
stays, so ties cannot occur; inner names give way to columns of docs; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import lines, simhash
from gneiss.llm.components import connected_components
from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import free_name, map_texts

_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    """The words that a SimHash is made of, a space between them."""
    return b" ".join(simhash.words_of(text))


def word_shingles(normal: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit codes of the shingles of a plain text that is not empty."""
    hashes = np.array([xxhash.xxh64_intdigest(w, simhash.SEED) for w in normal.split()], np.uint64)
    size = min(words, len(hashes))
    codes = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        codes = (codes ^ (codes >> np.uint64(31))) * _MIX + hashes[k : k + len(codes)]
    return np.unique((codes ^ (codes >> np.uint64(32))) * _MIX)


class DocVerifier(lines.Verifier):
    """Verifier of plain texts by their word shingles; remembers the sets of recent texts, such as pivots."""

    def __init__(self, width: int, remembered: int = 500_000):
        super().__init__(width)
        self.remembered, self.held, self.known = remembered, 0, {}

    def codes(self, line) -> np.ndarray:
        found = self.known.get(line)
        if found is None:
            if self.held > self.remembered:
                self.known.clear()
                self.held = 0
            found = self.known[line] = word_shingles(line, self.width)
            self.held += len(found)
        return found

    def jaccards(self, xs: list, ys: list) -> np.ndarray:
        out = np.zeros(len(xs))
        for n, (x, y) in enumerate(zip(xs, ys)):
            x, y = self.codes(x), self.codes(y)
            both = np.sort(np.concatenate([x, y]))
            shared = int((both[1:] == both[:-1]).sum())
            out[n] = shared / (len(x) + len(y) - shared)
        return out


def _signed(known: DataFrame, signer: lines.Signer, words: int) -> DataFrame:
    """(id, h, k, c, c2, s, keys) of the rows of known (id, h, text) that have a word; k is 0."""

    def make():
        def sign(texts: list) -> list[list]:
            normals = [plain(t) for t in texts]
            at = [n for n, x in enumerate(normals) if x]
            sets = [word_shingles(normals[n], words) for n in at]
            size = np.array([len(s) for s in sets], np.int64)

            def codes(part):
                yield np.concatenate([sets[n] for n in part]), np.cumsum(size[part]) - size[part]

            keys, sketches = signer.sign(size, codes)
            out: list = [[None] * len(texts) for _ in range(4)]
            for n, row, s in zip(at, keys.tolist(), sketches.tolist()):
                c, c2 = np.frombuffer(xxhash.xxh3_128_digest(normals[n]), np.int64).tolist()
                for into, value in zip(out, (c, c2, s, row)):
                    into[n] = value
            return out

        return sign

    return map_texts(known, "text", "c long, c2 long, s long, keys array<long>", make).where("c is not null").withColumn("k", F.lit(0))


def jaccard_links(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, signer: lines.Signer | None = None, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """Links (a, b) of ids that connect all documents of at least this similarity whose words are not the same."""
    known = lines.known_texts(docs, id_col, text_col)
    signed = scratch.keep(_signed(known, signer or lines.Signer(bands=16, rows=4, seed=11), words))
    classes = lines.first_places(signed, scratch)
    members = lines.candidate_lists(signed, scratch)

    def texts_of(wanted: DataFrame) -> DataFrame:
        places = classes.join(wanted, "c").select("id", "h", "k", "c")
        found = lines.texts_at(known, places, scratch, broadcast_bytes).select("text", F.col("ks")[0]["c"].alias("c"))
        return map_texts(found.dropDuplicates(["c"]), "text", "normal binary", lambda: lambda texts: [[plain(t) for t in texts]])

    roots = scratch.keep(lines.similar_components(members, texts_of, scratch, lambda: DocVerifier(words), least))
    ids = classes.select("c", "id")
    named = roots.where("c <> root").join(ids.withColumnRenamed("id", "a"), "c")
    return named.join(ids.select(F.col("c").alias("root"), F.col("id").alias("b")), "root").select("a", "b")


def drop_near_documents(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is not the smallest of those linked to it, by SimHash within two bits or by Jaccard similarity."""
    scratch = Scratch(docs.sparkSession)
    alike = simhash.simhash_near_duplicates(docs, id_col, text_col, words_per_shingle=words)
    stars = alike.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("a"), F.col("component_id").alias("b"))
    links = stars.union(jaccard_links(docs, scratch, id_col, text_col, words, least))
    name = free_name(docs.columns, "gone_id")
    gone = scratch.keep(connected_components(links, scratch).where("node <> root").select(F.col("node").alias(name)).distinct())
    scratch.leave(gone)
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
