"""How filters of a corpus act together (operator 12).

Every document gets the set of filters that it fails, as bits.  In which step of an
order a document goes depends on that set alone, so a table of the first failure of
each of the 32 sets in each of the 120 orders is made once; tasks look up their
documents in it and count removals by part, order, step and label.  Their arrays are
added up, and what else is reported follows from the sums.

The duplicate filter looks at all documents, removed or not: texts are compared by
their SHA-256.  A text is read once; what is joined later is a digest, an id and bits.

Edge cases: a null text counts as empty, a null part as the empty part; a null id has
no label, never fails the duplicate filter and makes no other fail it; rows equal in
id and text are no duplicates of each other, as no id is smaller; of several labels
of an id each counts that is 1 anywhere; a very long text is a batch of its own; an
empty table gives an empty result.  Only id, text and part are read, so other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import bound_batches, slices

_UPPER = bytes(range(65, 91))
_ODD = re.compile(rb"[#$%&*|]")

#: Conditions on the bytes of a text, by letter; a document fails where one holds.
TEXT_FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": lambda text, words: len(words) < 50,
    "B": lambda text, words: 100 * len(set(words)) < 65 * len(words),
    "C": lambda text, words: 100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * len(text.decode("utf-8", "replace")),
    "D": lambda text, words: _ODD.search(text) is not None,
}
#: The filter of texts that a smaller id has, too.
DUPLICATE = "E"
#: Parts whose counts a task holds at once.
PARTS = 256


def first_failures(filters: int) -> np.ndarray:
    """By set of failed filters and order, the step (from 0) in which a document goes; the number of filters if it stays."""
    orders = np.array(list(permutations(range(filters))))
    failed = np.arange(1 << filters)[:, None, None] >> orders & 1
    return np.where(failed.any(axis=2), failed.argmax(axis=2), filters)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict | None = None) -> DataFrame:
    """(id, part, failed, digest) of every row: the bits of the text filters that it fails, in order of their letters."""
    bound_batches(docs.sparkSession)
    tests = [t for _, t in sorted((filters or TEXT_FILTERS).items())]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                texts = some.column("text").to_pylist()
                failed = [sum(test(t, words) << k for k, test in enumerate(tests)) for t, words in ((t, t.split()) for t in texts)]
                digest = [hashlib.sha256(t).digest() for t in texts]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("part"), pa.array(failed, pa.int32()), pa.array(digest, pa.binary())], ["id", "part", "failed", "digest"])

    return rows.mapInArrow(run, f"id {kind}, part string, failed int, digest binary")


def removals(rows: DataFrame, filters: int) -> DataFrame:
    """(part, cells array<long>) of rows (part, failed, good, toxic): partial counts of each task.

    The cells are removals by label (all, good, toxic), order and step, then how many
    documents fail each filter, how many fail it alone, and the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = first_failures(filters)
        orders, steps = first.shape[1], filters + 1
        bits = np.arange(1 << filters)[:, None] >> np.arange(filters) & 1
        alone = bits * (bits.sum(axis=1) == 1)[:, None]
        gone: dict[str, np.ndarray] = {}
        sets: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            cells = []
            for part in gone:
                by = gone[part][:, :, :filters]  # label 1 is good, 2 toxic, 3 both
                labels = [by.sum(axis=0), by[1] + by[3], by[2] + by[3]]
                cells.append(np.concatenate([*(x.ravel() for x in labels), sets[part] @ bits, sets[part] @ alone, [sets[part].sum()]]))
            yield pa.RecordBatch.from_arrays([pa.array(list(gone), pa.string()), pa.array(cells, pa.list_(pa.int64()))], ["part", "cells"])
            gone.clear()
            sets.clear()

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            failed, label = batch.column("failed").to_numpy(), batch.column("label").to_numpy()
            cell = ((part * 4 + label)[:, None] * orders + np.arange(orders)) * steps + first[failed]
            counts = np.bincount(cell.ravel(), minlength=len(names) * 4 * orders * steps).reshape(len(names), 4, orders, steps)
            held = np.bincount(part * len(bits) + failed, minlength=len(names) * len(bits)).reshape(len(names), len(bits))
            for k, name in enumerate(names):
                gone[name] = gone.get(name, 0) + counts[k]
                sets[name] = sets.get(name, 0) + held[k]
            if len(gone) > PARTS:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "part string, cells array<long>")


def _report(sums: DataFrame, letters: str) -> DataFrame:
    """The rows of each part from its added up cells, (part, cells map<int, long>)."""
    n = len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = np.array(list(permutations(range(n))))
        names = ["".join(letters[f] for f in order) for order in orders]
        for batch in batches:
            for part, pairs in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                cells = np.zeros(3 * orders.size + 2 * n + 1, np.int64)
                for at, count in pairs:
                    cells[at] = count
                removed, good, toxic = cells[: 3 * orders.size].reshape(3, *orders.shape)
                fails, alone, docs = cells[3 * orders.size : -1 - n], cells[-1 - n : -1], cells[-1]
                over = np.bincount(orders.ravel(), removed.ravel()).astype(np.int64)
                columns = [docs - removed.cumsum(axis=1), removed, fails[orders] - removed, alone[orders], good, toxic, over[orders]]
                arrays = [pa.array([part] * orders.size), pa.array(np.repeat(names, n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(c.ravel()) for c in columns], names=_COLUMNS)

    longs = ", ".join(f"{c} long" for c in _COLUMNS[3:])
    return sums.mapInArrow(run, f"part string, filter_order string, step int, {longs}")


_COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_filters(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict | None = None
) -> DataFrame:
    """One row per part, order of the filters and step: what stays, what goes, and what the filter of that step finds at all.

    labels holds id, quality and toxic; quality = 1 is good, toxic = 1 toxic.
    """
    scratch = Scratch(docs.sparkSession)
    letters = "".join(sorted(filters or TEXT_FILTERS)) + DUPLICATE
    told = scratch.keep(failures(docs, id_col, text_col, part_col, filters))
    firsts = told.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    firsts = scratch.keep(firsts)  # a table of its own, so that the join can split a text with very many copies
    label = (F.max((F.col("quality") == 1).cast("int")), 2 * F.max((F.col("toxic") == 1).cast("int")))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(sum((F.coalesce(x, F.lit(0)) for x in label), F.lit(0)).alias("label"))
    late = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    failed = F.col("failed") + late * (1 << len(letters) - 1)
    rows = told.join(firsts, "digest", "left").join(marks, "id", "left").select("part", failed.alias("failed"), F.coalesce("label", F.lit(0)).alias("label"))
    cells = removals(rows, len(letters)).select("part", F.posexplode("cells").alias("at", "count")).where("count > 0")
    added = cells.groupBy("part", "at").agg(F.sum("count").alias("count"))
    sums = added.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", "count"))).alias("cells"))
    return _report(sums, letters)
