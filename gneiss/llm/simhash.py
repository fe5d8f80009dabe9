"""Near-duplicates by SimHash (operator 1).

Documents get a 64-bit SimHash of their word shingles.  Equal fingerprints
collapse before anything is compared.  The inverted index holds bundles of five
positional bytes: a fingerprint has 56 postings, one for each five of its eight
bytes.  Two fingerprints that differ in at most two bits differ in at most two bytes,
so they share six bytes or more and with them six bundles.  The bundles that a pair
shares are tallied; pairs under this guaranteed minimum, which share five bytes only,
are dropped, and the rest are verified by their differing bits.

A list of more than ``longest`` fingerprints is split by each of the three bytes that
its bundle leaves out: a pair to be found shares one of them at least, so it still
meets in that list and the bundle counts once for it.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like
any other; rows with a null id keep their fingerprint, form no class and have
component_id null; repeated rows give repeated rows; ties cannot occur (ids are
ordered); very long texts are hashed in chunks; an empty table gives an empty
result.  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.components import connected_components
from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import free_name, map_texts

SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text; zero if it has no word."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(id, fp) of every row of docs."""

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, "text", "fp long", lambda: lambda texts: [[fingerprint(t, words_per_shingle) for t in texts]])


#: Bytes of a bundle; masks of all bundles and of single bytes, as signed longs.
SHARED = 5
BUNDLES, BYTES = ([int(np.array(sum(0xFF << 8 * k for k in places), np.uint64).view(np.int64)) for places in combinations(range(8), n)] for n in (SHARED, 1))


def _literals(masks: list[int]) -> Column:
    return F.array(*[F.lit(m).cast("long") for m in masks])


def _postings(fps: DataFrame) -> DataFrame:
    """(fp, bundle, value): the bytes of each fingerprint in each bundle."""
    return fps.select("fp", F.explode(_literals(BUNDLES)).alias("bundle")).withColumn("value", F.col("fp").bitwiseAND(F.col("bundle")))


def _longer_postings(postings: DataFrame) -> DataFrame:
    """(fp, bundle, more, value): each posting with one of the three bytes that its bundle leaves out."""
    left_out = F.filter(_literals(BYTES), lambda b: b.bitwiseAND(F.col("bundle")) == 0)
    return postings.select("fp", "bundle", F.explode(left_out).alias("more")).withColumn("value", F.col("fp").bitwiseAND(F.col("bundle").bitwiseOR(F.col("more"))))


def _met(postings: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, bundle): pairs of one list."""
    left, right = postings.select(*keys, F.col("fp").alias("a")), postings.select(*keys, F.col("fp").alias("b"))
    return left.join(right, keys).where("a < b").select("a", "b", "bundle")


def tallied_pairs(fps: DataFrame, scratch: Scratch, max_bits: int = 2, longest: int = 64) -> DataFrame:
    """(a, b): pairs that share as many bundles as fingerprints within max_bits do at least."""
    postings = _postings(fps)
    lists = scratch.keep(postings.groupBy("bundle", "value").agg(F.count("*").alias("n")).where("n > 1"))
    listed = scratch.keep(postings.join(lists.hint("merge"), ["bundle", "value"]))
    short = _met(listed.where(F.col("n") <= longest), ["bundle", "value"])
    long = _met(_longer_postings(listed.where(F.col("n") > longest)), ["bundle", "more", "value"]).distinct()
    tally = short.union(long).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return tally.where(F.col("shared") >= comb(8 - max_bits, SHARED)).select("a", "b")


def fingerprint_links(fps: DataFrame, scratch: Scratch, max_bits: int = 2, longest: int = 64) -> DataFrame:
    """Links (a, b) of all distinct fingerprints within max_bits (at most 2) of each other."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index guarantees links of at most two bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return tallied_pairs(fps, scratch, max_bits, longest).where(near)


def simhash_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, max_bits: int = 2, longest: int = 64
) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id reachable by links."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, id_col, text_col, words_per_shingle))
    classes = scratch.keep(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("first")))
    links = fingerprint_links(classes.select("fp"), scratch, max_bits, longest)
    parts = connected_components(links, scratch)
    rooted = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted)
    firsts = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = scratch.keep(rooted.join(firsts.hint("merge"), "root").select("fp", "component_id"))
    scratch.leave(prints, named)
    out = prints.join(named.hint("merge"), "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def drop_simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose id is not the smallest of its class; all columns stay.

    Rows with a null id stay.  The ids decide, so repeated rows of a kept id stay together.
    """
    found = simhash_near_duplicates(docs, id_col, text_col, **how)
    name = free_name(docs.columns, "gone_id")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
