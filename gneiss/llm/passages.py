"""Removal of repeated byte strings by external induced suffix sorting (operator 6).

Every byte that a ``length``-byte string covers which also starts somewhere else
is removed.  A string is known by the start of its window.

1. Each window has an anchor: the position in it whose ``GRAM``-byte hash is
   smallest (leftmost of equals).  Equal windows have equal anchors at equal
   offsets.  Neighbouring windows with one anchor form a segment.
2. Anchors are counted.  Segments whose anchor occurs once are done.  A Bloom
   filter of fixed size over the repeated anchors keeps most of them from being
   shuffled; what passes it wrongly is dropped by the exact counts.
3. Segments with equal anchor and content (copies) are repeated as a whole.
4. Different segments of an anchor are cut at fixed offsets from the anchor into
   blocks of ``BLOCK`` windows.  All windows of a block share its core, so only
   blocks with equal cores can hold equal windows.
5. Equal blocks are repeated as a whole. The different blocks of a core are
   sorted: the bytes left of the core, one symbol
   for the core, the bytes right of it, as one text per shard, by external
   induced sorting with common prefixes, whose queues and text go to disk beyond
   ``memory`` entries.  Neighbours whose common prefix covers a whole window are
   repeated.

Hashes that stand for contents are at least 128 bits together with their anchor.
Matches never cross documents.  Nothing but repeats is moved between tasks.

Edge cases: a null text counts as empty; texts shorter than ``length`` keep all
bytes; rows with a null id or the same id count as documents of their own (rows
equal in id and text are copies of each other and lose the same bytes); very long
texts are cut into overlapping parts; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.bloom import bloom_of, passing
from gneiss.llm.induced import Sorter
from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import bound_batches, free_name, map_texts, slices, without

GRAM = 32
BLOCK = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = 24  # bits of a position; longer texts are cut into overlapping parts
_PART = (1 << _PLACE) - 1


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each position on, by doubling."""
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * _MIX
    width = 1
    while width < GRAM:
        mixed = (mixed[:-width] ^ (mixed[:-width] >> np.uint64(29))) * _MIX + mixed[width:]
        width *= 2
    return (mixed ^ (mixed >> np.uint64(32))) * _MIX


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by blocks with running minima from both sides."""
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: len(values) - width + 1], ahead[width - 1 : len(values)])


def segments(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor position, anchor hash) of all segments of some texts."""
    flat = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws])
    if len(flat) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    grams = gram_hashes(flat)
    place = np.uint64(_PART)
    keyed = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (window_minima(keyed, length - GRAM + 1) & place).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.repeat(np.arange(len(raws)), sizes)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= (starts + sizes)[text]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    past = np.concatenate([at[1:], [len(anchor)]])
    ends = np.concatenate([[0], np.cumsum(valid)])
    count = ends[past] - ends[at]
    own = text[at]
    return own, at - starts[own], count, anchor[at] - starts[own], grams[anchor[at]].view(np.int64)


def _batches_of(raws: list[bytes], length: int, most: int = 1 << 16) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(number of the first text, parts, offset of each part) of bounded size; only very long texts are cut."""
    group: list[bytes] = []
    size = first = 0
    for n, raw in enumerate(raws):
        if group and size + len(raw) > most:
            yield first, group, [0] * len(group)
            group, size = [], 0
        if len(raw) > most:
            for at in range(0, len(raw) - length + 1, most):
                yield n, [raw[at : at + most + length - 1]], [at]
            first = n + 1
            continue
        if not group:
            first = n
        group.append(raw)
        size += len(raw)
    if group:
        yield first, group, [0] * len(group)


def _found(texts: list, length: int) -> Iterator[tuple]:
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for first, group, offsets in _batches_of(raws, length):
        own, at, count, place, anchor = segments(group, length)
        shift = np.array(offsets)[own] if len(own) else own
        yield raws, own + first, at + shift, count, place + shift, anchor


def _blocks(off: int, count: int) -> range:
    """Blocks of the windows that start ``off`` .. ``off + count - 1`` from the anchor."""
    return range(off // BLOCK, (off + count - 1) // BLOCK + 1)


def _segment_rows(docs: DataFrame, length: int, bits) -> DataFrame:
    """(id, h, anchor, seg, off, count, places, cores): the segments of each text whose anchor passes the filter, equal ones once."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    low, most = 1 << 63, (1 << 64) - 1

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, "text"):
                whose, anchors, segs, offs, counts, places, cores = made = [[] for _ in range(7)]
                for raws, own, at, count, place, anchor in _found(part.column("text").to_pylist(), length):
                    keep = np.flatnonzero(passing(anchor, bits.value))
                    held: dict = {}
                    for n, a, c, p, h in zip(*(x[keep].tolist() for x in (own, at, count, place, anchor))):
                        raw = raws[n]
                        seg = digest(raw[a : a + c + length - 1], p - a) - low
                        seen = held.get((n, h, seg))
                        if seen is not None:
                            seen.append(p)
                            continue
                        for into, value in zip(made, (n, h, seg, a - p, c, [p])):
                            into.append(value)
                        held[n, h, seg] = places[-1]
                        cores.append([digest(raw[p + BLOCK * j + BLOCK - 1 : p + BLOCK * j + length], (h + 977 * j) & most) - low for j in _blocks(a - p, c)])
                at = pa.array(whose, pa.int64())
                numbers = [pa.array(anchors, pa.int64()), pa.array(segs, pa.int64()), pa.array(offs, pa.int32()), pa.array(counts, pa.int32())]
                lists = [pa.array(places, pa.list_(pa.int32())), pa.array(cores, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("h").take(at), *numbers, *lists], names=["id", "h", "anchor", "seg", "off", "count", "places", "cores"])

    return docs.select("id", "h", "text").mapInArrow(run, f"id {kind}, h long, anchor long, seg long, off int, count int, places array<int>, cores array<long>")


def repeated_windows(docs: DataFrame, scratch: Scratch, length: int = 200, memory: int = 1 << 18, blocks_per_shard: int = 40_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, h, start, count): runs of window starts whose strings start elsewhere too; docs has (id, h, text)."""
    if length < GRAM + BLOCK:
        raise ValueError("the strings are too short for the anchors")
    spark = docs.sparkSession

    def anchors():
        def rows(texts: list) -> list[list]:
            out: list = [[] for _ in texts]
            for _, own, _, _, _, anchor in _found(texts, length):
                cuts = np.searchsorted(own, np.arange(len(texts) + 1))
                for n in np.unique(own).tolist():
                    out[n].extend(anchor[cuts[n] : cuts[n + 1]].tolist())
            return [out]

        return rows

    every = map_texts(docs.select("text"), "text", "anchors array<long>", anchors).select(F.explode("anchors").alias("anchor"))
    repeated = scratch.keep(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    bits = spark.sparkContext.broadcast(bloom_of(repeated))
    found = _segment_rows(docs, length, bits)
    found = scratch.keep(found)
    distinct = found.groupBy("anchor", "seg").agg(F.sum(F.size("places")).alias("n"), F.min(F.struct("id", "h", F.col("places")[0].alias("p"), "off", "count")).alias("at"), F.min("cores").alias("cores"))
    distinct = scratch.keep(distinct)
    whole = distinct.where("n > 1").select("anchor", "seg")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    partly = distinct.join(mixed.hint("merge"), "anchor")
    blocks = partly.select("anchor", "seg", "n", "at", F.posexplode("cores").alias("k", "core"))
    blocks = scratch.keep(blocks.withColumn("j", (F.floor(F.col("at.off") / BLOCK) + F.col("k")).cast("int")).drop("k"))
    shared = blocks.groupBy("anchor", "core").agg(F.count("*").alias("sharing"), F.max(F.when(F.col("n") == 1, 1).otherwise(0)).alias("open")).where("sharing > 1 and open = 1")
    wanted = blocks.join(shared.drop("open").hint("merge"), ["anchor", "core"])
    wanted = wanted.select("at.id", "at.h", F.struct("anchor", "seg", "core", "j", "n", "sharing", F.col("at.p").alias("p"), F.col("at.off").alias("off"), F.col("at.count").alias("count")).alias("w"))
    wanted = scratch.keep(wanted.groupBy("id", "h").agg(F.collect_list("w").alias("ws")))  # bounded by the document's own length
    bytes_of = _block_bytes(docs, wanted, length, broadcast_bytes)
    bytes_of = scratch.keep(bytes_of.withColumn("variant", F.xxhash64("core", "first", "left", "right")))
    key = ["anchor", "core", "variant"]
    variants = bytes_of.groupBy(*key).agg(F.count("*").alias("m"), F.min("first").alias("first"), F.min("left").alias("left"), F.min("right").alias("right"))
    variants = scratch.keep(variants)  # equal blocks are repeated as a whole and go on once
    kinds = variants.groupBy("anchor", "core").agg(F.count("*").alias("kinds"), F.min("m").alias("fewest")).where("kinds > 1 and fewest = 1")
    open_ones = scratch.keep(variants.join(kinds.drop("fewest").hint("merge"), ["anchor", "core"]))
    sorted_runs = _sorted_repeats(open_ones, memory, blocks_per_shard)
    equal = variants.where("m > 1").select(*key, F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + _last_start("left", "right")).cast("int"))).alias("off"))
    told = sorted_runs.unionByName(equal).groupBy(*key).agg(F.collect_set("off").alias("offs"))
    told = scratch.keep(told)  # at most BLOCK offsets each
    part = bytes_of.select("anchor", "seg", "core", "variant").join(told.hint("merge"), key)
    part = scratch.keep(part.groupBy("anchor", "seg").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("offs")))).alias("offs")))  # at most ``length`` offsets a segment
    places = found.select("anchor", "seg", "id", "h", "off", "count", "places")
    runs = places.join(whole.hint("merge"), ["anchor", "seg"]).select("id", "h", F.explode("places").alias("p"), "off", "count")
    runs = runs.select("id", "h", (F.col("p") + F.col("off")).alias("start"), "count")
    # each run begins where the offset before is missing and ends where the next one is
    firsts = F.filter("offs", lambda x, k: (k == 0) | (F.get("offs", k - 1) != x - 1))
    lasts = F.filter("offs", lambda x, k: (k == F.size("offs") - 1) | (F.get("offs", k + 1) != x + 1))
    part = part.select("anchor", "seg", F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("off"), (b - a + 1).alias("count"))).alias("runs"))
    some = places.drop("off", "count").join(part.hint("merge"), ["anchor", "seg"]).select("id", "h", "places", F.explode("runs").alias("run"))
    some = some.select("id", "h", F.explode("places").alias("p"), "run").select("id", "h", (F.col("p") + F.col("run.off")).alias("start"), "run.count")
    return runs.union(some)


def _block_bytes(docs: DataFrame, wanted: DataFrame, length: int, broadcast_bytes: int) -> DataFrame:
    """(anchor, seg, core, n, sharing, first, left, right): the bytes around the core of each wanted block.

    The wanted places are broadcast if their counted size is at most broadcast_bytes;
    otherwise a Bloom filter of the texts' hashes picks the texts that are shuffled.
    Repeated rows of docs repeat their blocks, which are repeats then in any case.
    """
    size = wanted.agg(F.coalesce(F.sum(64 + 80 * F.size("ws")), F.lit(0))).first()[0]
    places = wanted.withColumnsRenamed({"id": "id2", "h": "h2"})
    texts = docs.select("id", "h", "text")
    if size <= broadcast_bytes:
        places = F.broadcast(places)
    else:
        bits = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("h").distinct()))

        def some(batches):
            for batch in batches:
                yield batch.filter(pa.array(passing(batch.column("h").to_numpy(zero_copy_only=False), bits.value)))

        texts, places = texts.mapInArrow(some, texts.schema), places.hint("merge")
    joined = texts.join(places, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))).select("ws", "text")

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for ws, text in zip(batch.column("ws").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for w in ws:
                    low = max(w["off"], BLOCK * w["j"])
                    high = min(w["off"] + w["count"], BLOCK * w["j"] + BLOCK)  # past the last window
                    core = w["p"] + BLOCK * w["j"] + BLOCK - 1
                    left = raw[w["p"] + low : core]
                    right = raw[w["p"] + BLOCK * w["j"] + length : w["p"] + high - 1 + length]
                    for into, value in zip(columns, (w["anchor"], w["seg"], w["core"], w["n"], w["sharing"], low, left, right)):
                        into.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    long, binary = pa.int64(), pa.binary()
    schema = pa.schema([("anchor", long), ("seg", long), ("core", long), ("n", long), ("sharing", long), ("first", long), ("left", binary), ("right", binary)])
    return joined.mapInArrow(run, "anchor long, seg long, core long, n long, sharing long, first long, left binary, right binary")


def _last_start(left: str, right: str):
    """Offset of a block's last window from its first, as a column.

    The first starts at the beginning of left; the last needs all of right.
    """
    return F.least(F.length(left), F.lit(1 - BLOCK) + F.length(left) + F.length(right))


def _sorted_repeats(rows: DataFrame, memory: int = 1 << 18, blocks_per_shard: int = 40_000) -> DataFrame:
    """(anchor, core, variant, off) of repeated windows, by suffix sorting the blocks of each shard (a partition by core)."""

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            yield from _sort_shard(batches, folder, memory)

    shards = -(-rows.count() // blocks_per_shard) or 1
    dealt = rows.repartition(shards, "anchor", "core").select("anchor", "variant", "core", "first", "left", "right").sortWithinPartitions("anchor", "core")
    return dealt.mapInArrow(run, "anchor long, core long, variant long, off int")


def _sort_shard(batches: Iterator[pa.RecordBatch], folder: str, memory: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the blocks that stream in; the text and what belongs to it wait on disk."""
    info_path, text_path, first_path = f"{folder}/blocks", f"{folder}/text", f"{folder}/firsts"
    blocks = symbols = 0
    number, core = 255, None
    with open(info_path, "wb") as info, open(text_path, "wb") as text, open(first_path, "wb") as starts:
        for batch in batches:
            for a, v, c, f, left, right in zip(*(batch.column(k).to_pylist() for k in ("anchor", "variant", "core", "first", "left", "right"))):
                if (a, c) != core:  # blocks come in the order of their cores
                    number, core = number + 1, (a, c)
                # a block reads: a mark of its own (negative), left, the core, right
                part = [-2 - blocks, *left, number, *right]
                np.array(part, np.int64).tofile(text)
                np.array([a, c, v, f, symbols, len(left), len(right)], np.int64).tofile(info)
                np.array([symbols], np.int64).tofile(starts)
                symbols += len(part)
                blocks += 1
        np.array([-2 - blocks], np.int64).tofile(text)
    if blocks < 2:
        return
    blocks_info = np.memmap(info_path, np.int64, "r").reshape(-1, 7)
    firsts = np.memmap(first_path, np.int64, "r")

    out: list[tuple] = []
    last = None
    for position, common in Sorter(folder, memory).suffixes_of_file(text_path, symbols + 1):
        n = int(np.searchsorted(firsts, position, side="right")) - 1 if position < symbols else -1
        here = None
        if n >= 0:
            anchor, core, variant, first, start, left, right = blocks_info[n].tolist()
            x = position - start - 1
            need = BLOCK - 1 - (left - x)
            if 0 <= x <= left and 0 <= need <= right:
                here = (anchor, core, variant, first + x, left - x + 1 + need)
        if here is not None and last is not None and common >= here[4]:
            out += [last[:4], here[:4]]
        last = here
        if len(out) > 20_000:
            yield _offsets(out)
            out = []
    yield _offsets(out)


def _offsets(rows: list[tuple]) -> pa.RecordBatch:
    *ids, offs = zip(*set(rows)) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([*(pa.array(i, pa.int64()) for i in ids), pa.array(offs, pa.int32())], names=["anchor", "core", "variant", "off"])


def _spans(runs: list, length: int) -> list[dict]:
    """Maximal removed spans of runs of window starts."""
    spans: list[list[int]] = []
    for start, past in sorted((r["start"], r["start"] + r["count"] - 1 + length) for r in runs):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], past)
        else:
            spans.append([start, past])
    return [{"start": a, "end": b} for a, b in spans]


def _kept(raw: bytes, spans: list) -> bytes:
    edges = [0, *(e for s in spans for e in (s["start"], s["end"])), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, broadcast_bytes: int = 32 << 20, **how) -> DataFrame:
    """docs without the text, with n_bytes, removed (array of start and end) and kept (the other bytes).

    These three replace columns of docs with their names.  The spans to remove are
    broadcast if their counted size is at most broadcast_bytes, and joined by
    shuffle otherwise.
    """
    scratch = Scratch(docs.sparkSession)
    h = F.coalesce(F.xxhash64(text_col), F.lit(0))
    known = docs.select(F.col(id_col).alias("id"), h.alias("h"), F.col(text_col).alias("text"))
    runs = repeated_windows(known, scratch, length, broadcast_bytes=broadcast_bytes, **how)
    runs = runs.groupBy("id", "h").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("count").cast("int").alias("count"))).alias("runs"))
    spans = map_texts(runs, "runs", "spans array<struct<start:int,end:int>>", lambda: lambda rows: [[_spans(r, length) for r in rows]])
    own_id, own_h, both, cuts = (free_name(docs.columns, x) for x in ("span_id", "span_h", "text_and_spans", "spans"))
    spans = scratch.keep(spans.withColumnsRenamed({"id": own_id, "h": own_h, "spans": cuts}))  # bounded by the document's own length
    scratch.leave(spans)
    size = spans.agg(F.coalesce(F.sum(64 + 16 * F.size(cuts)), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if size <= broadcast_bytes else spans.hint("merge")
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (h == F.col(own_h))
    made = ["n_bytes", "removed", "kept"]
    kept = [c for c in without(docs.columns, made) if c != text_col]
    rows = docs.join(spans, same, "left").select(*kept, F.struct(F.col(text_col).alias("text"), F.col(cuts).alias("spans")).alias(both))

    def make():
        def cut(rows: list) -> list[list]:
            raws = [(r["text"] or "").encode("utf-8", "surrogatepass") for r in rows]
            found = [r["spans"] or [] for r in rows]
            return [[len(r) for r in raws], found, [_kept(raw, spans) for raw, spans in zip(raws, found)]]

        return cut

    return map_texts(rows, both, "n_bytes long, removed array<struct<start:int,end:int>>, kept binary", make)
