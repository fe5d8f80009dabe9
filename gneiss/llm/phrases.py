"""Phrase collocations by hierarchical pair naming (operator 11).

Texts are dealt into chunks, each a sequence of the words of one language in the
ids of its own small dictionary.  Level by level, what a chunk holds is sent once, with
its count, to a bucket of its hash; the bucket adds up the counts of all chunks, gives
frequent phrases a global id and sends the ids back to the chunks that hold them.  Two
neighbouring names of a sequence make a phrase a word longer, whose name is the pair of
the ids of its first and its last k - 1 words.  A bucket is of bounded size: there are
as many as the counts of the level before ask for, and a hot word or phrase is a single
entry of each chunk.  Arrays travel as bytes, so that Spark moves few rows.

The two ids of a pair are parent pointers.  Counts of all beginnings and endings,
which the cuts need, are handed on along them.  A phrase within a longer candidate
lies in the parents of one that is a single word longer, and at least as frequent,
so looking at the phrases that point to a candidate settles whether it is dropped.

The first phrases of a language are found in a table sorted over all languages:
counts of its ranges give each range the rank it begins with, and only the ranges
that begin early enough are numbered.

Edge cases: a null or empty text has no word; a null language is ``und``, as is one
of that name; repeated rows count as often as they stand there; ties of scores go by
count, then by the bytes of the phrase; a very long text makes a chunk of its own
(phrases are never cut); an empty table, or one without candidates, gives an empty
result.  Only language and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import bound_batches

#: Bytes of text that a task gathers before it writes chunks, and entries that a bucket has on average.
CHUNK_BYTES = 8 << 20
BUCKET_ENTRIES = 1 << 18
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))

_CHUNKS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()), ("word", pa.list_(pa.binary())), ("n", pa.binary())])
_WORDS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("word", pa.list_(pa.binary())), ("n", pa.binary())])
_PAIRS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())])
#: Rows with a chunk tell it the ids of its entries of a bucket; the one row without is the list of names of the bucket.
_LISTS = ["word", "left", "right", "ids", "f"]
_NAMED = pa.schema(
    [("level", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("at", pa.binary()), ("id", pa.binary()), ("langs", pa.list_(pa.string()))]
    + [(c, pa.list_(pa.binary() if c == "word" else pa.int64())) for c in _LISTS]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` " + (f"array<{names[f.type.value_type]}>" if pa.types.is_list(f.type) else names[f.type]) for f in schema)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _packed(values: np.ndarray) -> bytes:
    """Numbers not below zero in four bytes each, or eight if they must."""
    small = not len(values) or values.max() < 1 << 32
    return bytes([4 if small else 8]) + values.astype(np.uint32 if small else np.int64).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if data[0] == 4 else np.int64, offset=1).astype(np.int64)


def encode_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(sequence, words, counts) of some texts; words have ids from 1, and 0 stands between pieces."""
    tokens = b".".join(t.translate(_PLAIN) for t in texts).replace(b".", b" . ").split()
    coded = pa.array([b".", *tokens], pa.binary()).dictionary_encode()  # the break is entry 0
    seq = coded.indices.to_numpy()[1:]
    words = coded.dictionary.to_pylist()[1:]
    return seq, words, np.bincount(seq, minlength=len(words) + 1)[1:]


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0

    def flush(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        nonlocal made
        for lang in list(held):
            seq, words, counts = encode_words(held.pop(lang))
            if words:
                row = {"chunk": (task << 32) + made, "lang": lang, "seq": _packed(seq), "word": words, "n": _packed(counts)}
                yield from _rows([row], _CHUNKS).to_batches()
                made += 1

    held, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            if size and size + len(text.as_buffer()) > most:
                yield from flush(held)
                size = 0
            held.setdefault(lang.as_py(), []).append(text.as_py())
            size += len(text.as_buffer())
    yield from flush(held)


def _deal(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): entries ordered by the bucket of their 64-bit key, and where each bucket ends."""
    bucket = ((key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(buckets)
    return np.argsort(bucket, kind="stable"), np.bincount(bucket.astype(np.int64), minlength=buckets).cumsum()


def _word_entries(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, lang, words, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lang", "word", "n"))):
            counts, salt = _unpacked(n), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
            order, ends = _deal(np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in words), np.uint64, len(words)), buckets)
            rows = [
                {"bucket": b, "chunk": chunk, "lang": lang, "at": _packed(own + 1), "word": [words[k] for k in own.tolist()], "n": _packed(counts[own])}
                for b, own in enumerate(np.split(order, ends[:-1]))
                if len(own)
            ]
            yield from _rows(rows, _WORDS).to_batches()


def _tell(table: pa.Table, level: int, bucket: int, sizes: list[int], at: list[bytes] | None, ids: np.ndarray, names: dict) -> pa.Table:
    """Ids of the frequent entries (others -1) back to their chunks, and the list of names."""
    rows = [{"level": level, "bucket": bucket} | names]
    for k, (chunk, own) in enumerate(zip(table.column("chunk").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]))):
        held = np.flatnonzero(own >= 0)
        if len(held):
            rows.append({"level": level, "bucket": bucket, "chunk": chunk, "at": _packed(held if at is None else _unpacked(at[k])[held]), "id": _packed(own[held])})
    return _rows(rows, _NAMED)


def _added(code: np.ndarray, n: np.ndarray, least: int, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each entry or -1, a code of each frequent phrase, its count) from the codes of the entries, which have no gaps."""
    total = np.bincount(code, n).astype(np.int64)
    often = np.flatnonzero(total >= least)
    ids = np.full(len(total), -1, np.int64)
    ids[often] = np.arange(len(often)) * buckets + bucket
    return ids[code], often, total[often]


def _name_words(table: pa.Table, least: int, buckets: int) -> pa.Table:
    """One bucket of words."""
    bucket = table.column("bucket")[0].as_py()
    n = [_unpacked(x) for x in table.column("n").to_pylist()]
    words = pa.concat_arrays([c.flatten() for c in table.column("word").chunks]).dictionary_encode()
    langs = pa.array(table.column("lang").to_pylist()).dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(), [len(x) for x in n]).astype(np.int64)
    pairs, code = np.unique(lang * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True)
    ids, often, total = _added(code, np.concatenate(n), least, bucket, buckets)
    spelt = [words.dictionary[k].as_py() for k in (pairs[often] % len(words.dictionary)).tolist()]
    names = {"langs": [langs.dictionary[k].as_py() for k in (pairs[often] // len(words.dictionary)).tolist()], "word": spelt}
    return _tell(table, 1, bucket, [len(x) for x in n], table.column("at").to_pylist(), ids, names | {"ids": np.arange(len(often)) * buckets + bucket, "f": total})


def _name_pairs(table: pa.Table, level: int, least: int, buckets: int) -> pa.Table:
    """One bucket of pairs of names."""
    bucket = table.column("bucket")[0].as_py()
    left, right, n = ([_unpacked(x) for x in table.column(c).to_pylist()] for c in ("left", "right", "n"))
    sizes = [len(x) for x in n]
    left, right = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((right, left))
    first = np.ones(len(order), bool)
    first[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
    code = np.empty(len(order), np.int64)
    code[order] = first.cumsum() - 1
    ids, often, total = _added(code, np.concatenate(n), least, bucket, buckets)
    shown = order[first][often]
    return _tell(table, level, bucket, sizes, None, ids, {"left": left[shown], "right": right[shown], "ids": np.arange(len(often)) * buckets + bucket, "f": total})


def neighbours(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of pairs, left ids, right ids, counts) of a sequence of places in ids, 0 being no name; pairs have places from 1."""
    both = (at[:-1] > 0) & (at[1:] > 0)
    pairs, where, counts = np.unique((at[:-1][both] - 1) * max(1, len(ids)) + at[1:][both] - 1, return_inverse=True, return_counts=True)
    following = np.zeros(max(0, len(at) - 1), np.int64)
    following[both] = where + 1
    return following, ids[pairs // max(1, len(ids))], ids[pairs % max(1, len(ids))], counts


def _bucket_pairs(left: np.ndarray, right: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return _deal(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), buckets)


def _pair_entries(chunks: pa.Table, told: pa.Table, buckets: tuple[int, ...]) -> pa.Table:
    """The pairs of one chunk at the level after the last of buckets (by level from 2; the last are those to deal to), by bucket."""
    rows = []
    if chunks.num_rows and told.num_rows:
        at = _unpacked(chunks.column("seq")[0].as_py())
        of = np.zeros(at.max(initial=0) + 1, np.int64)
        # each level numbers its pairs by the order of these rows, and the next one must find the same, whatever order they arrive in
        names = sorted(zip(*(told.column(c).to_pylist() for c in ("level", "bucket", "at", "id"))))
        for level in range(1, len(buckets) + 1):
            own = [(b, _unpacked(places), _unpacked(ids)) for k, b, places, ids in names if k == level]
            if level > 1:  # places are told within the bucket
                order, ends = _bucket_pairs(left, right, buckets[level - 2])
                begins = np.concatenate([[0], ends])
                own = [(b, order[begins[b] + places] + 1, ids) for b, places, ids in own]
                of = np.zeros(len(left) + 1, np.int64)
            if not own:
                return _rows([], _PAIRS)
            places, ids = np.concatenate([x for _, x, _ in own]), np.concatenate([x for _, _, x in own])
            of[places] = np.arange(1, len(places) + 1)
            at, left, right, counts = neighbours(of[at], ids)
        order, ends = _bucket_pairs(left, right, buckets[-1])
        chunk = chunks.column("chunk")[0].as_py()
        rows = [
            {"bucket": b, "chunk": chunk, "left": _packed(left[own]), "right": _packed(right[own]), "n": _packed(counts[own])}
            for b, own in enumerate(np.split(order, ends[:-1]))
            if len(own)
        ]
    return _rows(rows, _PAIRS)


def _pairs_of(buckets: tuple[int, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda chunk, told: _pair_entries(chunk, told, buckets)


def _names_of(level: int, least: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _name_pairs(table, level, least, buckets)


def _wide(count: str) -> str:
    """Counts below 10^15, so that the products of a score stay exact decimals."""
    return f"cast({count} as decimal(15,0))"


def _with_parents(names: DataFrame, parents: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, left, right, lang, phrase, last, f, firsts, lasts) of the phrases of one level, from the level before."""
    left = parents.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("firsts", F.array("f")).alias("firsts"))
    right = parents.select(F.col("id").alias("right"), "last", F.concat("lasts", F.array("f")).alias("lasts"))
    rows = names.join(left, "left").join(right, "right")
    return scratch.keep(rows.select("id", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "firsts", "lasts"))


def _scored(level: DataFrame, longer: DataFrame | None, words: int, kept_below: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of a level by their weakest cut, without those within a longer one."""
    if longer is not None:
        over = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("g")).groupBy("id").agg(F.max("g").alias("g"))
        level = level.join(over, "id", "left").where(f"g is null or 100 * g < {kept_below} * f")
    cuts = []
    for k in range(1, words):
        l, r = f"firsts[{k - 1}]", f"lasts[{words - k - 1}]"  # noqa: E741
        share = F.expr(f"(cast(1000000 as decimal(7,0)) * ({_wide('f')} * {_wide('f')})) div ({_wide(l)} * {_wide(r)})")
        cuts.append(F.struct(share.alias("score"), F.lit(k).alias("k"), F.expr(l).alias("l"), F.expr(r).alias("r")))
    return level.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_of_each(rows: DataFrame, key: str, order: list, top: int, scratch: Scratch) -> DataFrame:
    """The first ``top`` rows of each key in an order without ties, with their rank from 1."""
    dealt = scratch.keep(rows.repartitionByRange(key, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "range").agg(F.count("*").alias("m")).select(key, "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(key, "range").orderBy(*order)
    near = dealt.join(starts.where(F.col("ahead") < top), [key, "range"])
    return near.withColumn("rank", F.col("ahead") + F.row_number().over(within)).where(F.col("rank") <= top).drop("range", "ahead")


def mine_phrases(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    kept_below: int = 50,
    lang_col: str = "lang",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    bucket_entries: int = BUCKET_ENTRIES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of 2 to ``longest`` words of each language.

    A candidate stands at least ``least`` times in its language and is dropped if a
    longer one around it has at least ``kept_below`` percent of its count.
    """
    scratch = Scratch(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    chunks = scratch.keep(rows.mapInArrow(lambda batches: _chunked(batches, chunk_bytes), _ddl(_CHUNKS)))

    entries = chunks.agg(F.sum(F.size("word")).alias("n")).first().n or 0
    parts = 1 + entries // bucket_entries
    dealt = chunks.select("chunk", "lang", "word", "n").mapInArrow(lambda batches: _word_entries(batches, parts), _ddl(_WORDS))
    told = scratch.keep(dealt.groupBy("bucket").applyInArrow(lambda t: _name_words(t, least, parts), _ddl(_NAMED)))
    names = told.where("chunk is null").select(F.inline(F.arrays_zip("ids", "langs", "word", "f")))
    word, none = F.col("word").cast("string"), F.array().cast("array<long>")
    level = scratch.keep(names.select(F.col("ids").alias("id"), F.col("langs").alias("lang"), word.alias("phrase"), word.alias("last"), "f", none.alias("firsts"), none.alias("lasts")))

    levels, buckets = [], []
    for words in range(2, longest + 1):
        entries = level.agg(F.sum("f").alias("n")).first().n or 0  # no chunk has more entries than its names stand there
        buckets = [*buckets, 1 + entries // bucket_entries]
        ids = told.where("chunk is not null").select(F.col("chunk").alias("of"), "level", "bucket", "at", "id")
        dealt = chunks.select("chunk", "seq").groupBy("chunk").cogroup(ids.groupBy("of")).applyInArrow(_pairs_of(tuple(buckets)), _ddl(_PAIRS))
        found = scratch.keep(dealt.groupBy("bucket").applyInArrow(_names_of(words, least, buckets[-1]), _ddl(_NAMED)))
        names = found.where("chunk is null").select(F.inline(F.arrays_zip("ids", "left", "right", "f"))).withColumnRenamed("ids", "id")
        level = _with_parents(names, level, scratch)
        levels.append(level)
        told = told.union(found)

    scored = [_scored(level, longer, words, kept_below) for words, (level, longer) in enumerate(zip(levels, [*levels[1:], None]), 2)]
    found = scored[0]
    for more in scored[1:]:
        found = found.union(more)
    ranked = first_of_each(found, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, scratch)
    totals = chunks.select("lang", "n").mapInArrow(_word_totals, "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals = [int(_unpacked(n).sum()) for n in batch.column("n").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(totals, pa.int64())], ["lang", "total"])
