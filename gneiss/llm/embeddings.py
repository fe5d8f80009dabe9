"""Embedding near-duplicates by lattice hashing (operator 3).

Equal vectors of one label collapse first.  Each table projects the unit vectors
to eight dimensions by an orthonormal random projection, scales and shifts them,
and decodes them to the nearest point of the E8 lattice.  Every vector is stored
in the cell of its nearest point and looks up that cell and those of the lattice
points next to it that are nearest to its projection.  Pairs that meet in a cell
of any table are verified by the cosine in double precision.

The scale makes the projected distance of a pair at the threshold about the
lattice's packing radius, so a near pair shares a cell or a probed one in at
least one table with high probability (measured against brute force in the
tests), while unrelated vectors rarely meet.  All rows are indexed; no sample is fitted and no cell is
capped.

Only equal labels are compared and a null label never is.  A vector that is
null, zero, or holds null or non-finite components links with nothing; so do
vectors of different lengths.  Repeated ids keep their rows: each row counts as
a vector of its own for n_links.  A null id gives component_id null and kept
true, and its links count for the others.  An empty table gives an empty result;
a cosine of exactly the threshold links, and ties cannot occur otherwise (ids are
ordered); a vector of many dimensions is projected like any other, its scale follows
from its length; only id, label and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.components import connected_components
from gneiss.llm.scratch import Scratch


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: what separates a lattice point from its neighbours."""
    pairs = [[(s if k == i else t if k == j else 0) for k in range(8)] for i, j in combinations(range(8), 2) for s in (-1, 1) for t in (-1, 1)]
    halves = [[0.5 * s for s in signs] for signs in product((-1, 1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(pairs + halves, float)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the nearer of the nearest points of D8 and of D8 + 1/2."""

    def nearest_d8(v):
        near = np.rint(v)
        odd = near.sum(axis=1) % 2 != 0
        worst = np.abs(v - near).argmax(axis=1)
        rows = np.arange(len(v))
        step = np.where(v[rows, worst] >= near[rows, worst], 1.0, -1.0)
        near[rows[odd], worst[odd]] += step[odd]
        return near

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _projection(dims: int, table: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, table, dims])
    basis = np.linalg.qr(rng.normal(size=(max(dims, 8), 8)))[0][:dims]
    return basis, rng.uniform(0, 1, 8)


def cells(x: np.ndarray, table: int, scale: float, probes: int, seed: int) -> np.ndarray:
    """Doubled lattice coordinates of the own cell and the probed ones: (rows, 1 + probes, 8).

    Eight of the dimensions hold 8 / dimensions of a squared distance on average, so the
    default scale puts a pair at the threshold about 0.7 apart in a lattice of packing radius 0.71.
    """
    basis, shift = _projection(x.shape[1], table, seed)
    at = x @ basis * (scale / min(1.0, 8 / x.shape[1]) ** 0.5) + shift
    home = nearest_e8(at)
    roots = e8_roots()
    order = np.argpartition(-((at - home) @ roots.T), min(probes, 239), axis=1)[:, :probes]  # all roots have one length
    return np.rint(2 * np.concatenate([home[:, None], home[:, None] + roots[order]], axis=1)).astype(np.int16)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _postings(distinct: DataFrame, tables: int, scale: float, probes: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, label = batch.column("cid"), batch.column("label")
            vectors = batch.column("v").to_pylist()
            for dims in sorted({len(v) for v in vectors}):
                rows = [n for n, v in enumerate(vectors) if len(v) == dims]
                for at in range(0, len(rows), 2000):
                    part = rows[at : at + 2000]
                    x = np.array([vectors[n] for n in part], float)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = np.stack([cells(x, t, scale, probes, seed) for t in range(tables)], axis=1)
                    count = tables * (1 + probes)
                    raw = found.reshape(len(part) * count, 8).tobytes()
                    keys = [b"%d,%d," % (dims, k // (1 + probes) % tables) + raw[16 * k : 16 * k + 16] for k in range(len(part) * count)]
                    take = pa.array(np.repeat(part, count))
                    home = np.tile(np.arange(count) % (1 + probes) == 0, len(part))
                    yield pa.RecordBatch.from_arrays([ids.take(take), label.take(take), pa.array(keys, pa.binary()), pa.array(home)], names=["cid", "label", "cell", "home"])

    kind = distinct.schema["label"].dataType.simpleString()
    return distinct.mapInArrow(run, f"cid long, label {kind}, cell binary, home boolean")


def near_vectors(
    vectors: DataFrame, least: float = 0.98, tables: int = 6, probes: int = 8, scale: float | None = None, seed: int = 11,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    if scale is None:
        scale = 0.7 / max(1e-3, (2 - 2 * least) ** 0.5)
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(_usable(F.col("v")) & F.col("label").isNotNull(), F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    rows = rows.withColumn("digest", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.col("v").cast("array<string>"), " ")), 256)))
    rows = scratch.keep(rows)
    classes = rows.where("v is not null").groupBy("digest").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    postings = scratch.keep(_postings(classes.select("cid", "label", "v"), tables, scale, probes, seed))
    stored = postings.where("home").select("label", "cell", F.col("cid").alias("b"))
    pairs = postings.select("label", "cell", F.col("cid").alias("a")).join(stored, ["label", "cell"]).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    sized = classes.select("cid", "v", norm.alias("norm"))
    left = sized.select(F.col("cid").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na"))
    right = sized.select(F.col("cid").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    links = pairs.join(left, "a").join(right, "b").where((dot / (F.col("na") * F.col("nb"))) >= least).select("a", "b")
    links = scratch.keep(links)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("cid").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    roots = connected_components(links, scratch)
    told = classes.select("cid", "digest", "copies", "first").join(degree, F.col("cid") == F.col("a"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    told = scratch.keep(told.select("digest", "copies", "first", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "cid").alias("root")))
    least_id = scratch.keep(told.groupBy("root").agg(F.min("first").alias("component")))
    named = scratch.keep(told.join(least_id, "root").select("digest", (F.col("copies") - 1 + F.col("others")).alias("links"), "component"))
    scratch.leave(rows, named)
    out = rows.select("id", "digest").join(named.hint("merge"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).cast("long")
    out = out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
