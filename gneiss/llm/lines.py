"""Near-duplicate lines by MinHash (operator 2).

Lines are the pieces between newlines that hold more than white space, compared
lower-cased with runs of white space as one space.  Equal lines are one class,
known by a 64-bit code.  A class gets a MinHash signature of its character
shingles by one hash function whose values are dealt into bins; an empty bin
borrows from others in a fixed random order.  Bands of bins are the postings of a
class, and the lowest bits of some more bins are its sketch.

Classes that meet in a band are candidates.  The classes of a list (of one band
key) are compared with its smallest and its largest code first.  Pairs whose
sketches differ in too many bits are dropped, the others are verified by the exact
Jaccard similarity of their whole shingle sets, and what is similar is united by
distributed union-find.  Of the lists that hold several components after that,
all pairs of different components are compared: short lists pair by pair, long
ones after a round of further pivots block by block, by sizes and parity sketches
of whole sets, which bound the similarity exactly; what is left is verified.

Of each component only the first line (by id, then a hash of the text, then
position) stays.

Edge cases: a null text has no lines and stays null; blank lines stay where they
are; a line shorter than a shingle is one shingle; a text all of whose lines go
becomes empty; rows with a null id keep their text and take no part; rows with
the same id are told apart by their text, and of rows equal in both one keeps what
the first may keep and the others lose all lines that are not blank.  Very long
lines are signed in pieces.  Ties cannot occur, as the order is total.  An empty
table gives an empty result.  Two different lines of one 64-bit code (one pair in
10^19) stay apart: the lines that are not the first of the code stay.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.bloom import bloom_of, passing
from gneiss.llm.components import connected_components
from gneiss.llm.scratch import Scratch
from gneiss.llm.texts import bound_batches, free_name, map_texts, slices

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint32(0xFFFFFFFF)

#: Characters a shingle.  At the least similarity of 0.8 a changed word is found in a
#: line of about 17 words; with nine characters it takes about 23.
WIDTH = 5
#: Shingles that are signed at once.
CHUNK = 1 << 16
#: Bits of a sketch that a pair may differ in: of 64, a pair at 0.8 differs in 6.4 on average.
MOST_BITS = 16
#: What str.split() takes for white space, as a Java pattern of a blank line (fixed values).
BLANK = "^[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]*$"


def shingle_codes(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the character shingles of all lines, repeats included, and where each line's begin.

    A line shorter than a shingle is one shingle.
    """
    padded = [x if len(x) >= width else x + "\0" * (width - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed, size = (codes + np.uint64(1)) * _MIX, 1
    whole, covered = None, 0
    while True:  # codes of 1, 2, 4, ... characters; those in the binary form of the width are strung together
        if width & size:
            whole = mixed if whole is None else (whole[: len(mixed) - covered] ^ (whole[: len(mixed) - covered] >> np.uint64(31))) * _MIX + mixed[covered:]
            covered += size
        if covered == width:
            break
        mixed = (mixed[:-size] ^ (mixed[:-size] >> np.uint64(29))) * _MIX + mixed[size:]
        size *= 2
    sizes = np.array([len(x) for x in padded])
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(codes), bool)
    for k in range(1, width):
        inside[starts + sizes - k] = False
    whole = (whole ^ (whole >> np.uint64(32))) * _MIX
    return whole[inside[: len(whole)]], np.cumsum(sizes - width + 1) - (sizes - width + 1)


class Signer:
    """Band keys and sketches of sets of 64-bit codes, by one hash function dealt into bins."""

    def __init__(self, bands: int = 12, rows: int = 6, seed: int = 5, borrows: int = 6):
        self.bands, self.rows, self.n = bands, rows, bands * rows + 64
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(0, 1 << 63, dtype=np.uint64) | np.uint64(1)
        self.orders = [rng.permutation(self.n) for _ in range(borrows)]

    def bins(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, bins) smallest value in each bin, _EMPTY where there is none."""
        codes = codes * self.salt
        codes ^= codes >> np.uint64(29)
        owner = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(codes))))
        place = owner * np.uint64(self.n) + (((codes >> np.uint64(32)) * np.uint64(self.n)) >> np.uint64(32))
        out = np.full(len(starts) * self.n, _EMPTY)
        np.minimum.at(out, place.view(np.int64), ((codes * _MIX) >> np.uint64(32)).astype(np.uint32))
        return out.reshape(len(starts), self.n)

    def close(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((sets, bands) keys, (sets,) sketches) of bins, each set having some value."""
        full = bins.copy()
        row, bin_ = np.divmod(np.flatnonzero(bins.reshape(-1) == _EMPTY), self.n)
        for order in self.orders:
            lent = bins[row, order[bin_]]
            full[row, bin_] = lent
            row, bin_ = row[lent == _EMPTY], bin_[lent == _EMPTY]
            if not len(row):
                break
        if len(row):  # the next bin that is not empty, around the end
            some, at_row = np.unique(row, return_inverse=True)
            twice = np.concatenate([bins[some], bins[some]], axis=1)
            at = np.where(twice < _EMPTY, np.arange(2 * self.n), 2 * self.n)
            after = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1]
            full[row, bin_] = twice[at_row, after[at_row, bin_]]
        sig = full[:, : self.bands * self.rows].astype(np.uint64).reshape(len(full), self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64) * _MIX + np.zeros((len(sig), 1), np.uint64)
        for k in range(self.rows):
            key = (key ^ (key >> np.uint64(31))) * _MIX + sig[:, :, k]
        low = (full[:, self.bands * self.rows :] & 1).astype(np.uint8)
        return (key * _MIX).view(np.int64), np.packbits(low, axis=1, bitorder="little").view(np.int64).reshape(-1)

    def sign(self, size: np.ndarray, codes) -> tuple[np.ndarray, np.ndarray]:
        """Keys and sketches of sets of so many codes; codes(chosen) gives parts (codes, starts) of those chosen, one set if it is cut."""
        keys, sketches = np.empty((len(size), self.bands), np.int64), np.empty(len(size), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1
        for part in np.split(np.arange(len(size)), cuts):
            if len(part):
                bins = None
                for some, starts in codes(part):
                    found = self.bins(some, starts)
                    bins = found if bins is None else np.minimum(bins, found)
                keys[part], sketches[part] = self.close(bins)
        return keys, sketches


def normal_line(line: str) -> str:
    return " ".join(line.lower().split())


def exact_jaccard(a: str, b: str, width: int) -> float:
    return float(Verifier(width).jaccards([a], [b])[0])


class Verifier:
    """Jaccard similarity of the whole shingle sets of pairs of lines, many pairs at once."""

    PAIRS, CHARS = 1 << 10, 1 << 18

    def __init__(self, width: int):
        self.width = width

    def codes(self, line) -> np.ndarray:
        return np.unique(shingle_codes([line], self.width)[0])

    def jaccards(self, xs: list, ys: list) -> np.ndarray:
        out, at, size = [np.zeros(0)], 0, 0
        for n, (x, y) in enumerate(zip(xs, ys), 1):
            size += len(x) + len(y)
            if size >= self.CHARS or n - at == self.PAIRS or n == len(xs):
                out.append(self._some(xs[at:n], ys[at:n]))
                at, size = n, 0
        return np.concatenate(out)

    def _some(self, xs: list, ys: list) -> np.ndarray:
        codes, starts = shingle_codes(xs + ys, self.width)
        pair = np.repeat(np.tile(np.arange(len(xs), dtype=np.uint64) << np.uint64(54), 2), np.diff(np.append(starts, len(codes))))
        second = int(starts[len(xs)])
        keys = pair | codes >> np.uint64(10)  # the pair in the highest ten bits, the first 54 of a code's bits below
        left, right = (k[np.append(True, k[1:] != k[:-1])] for k in (np.sort(keys[:second]), np.sort(keys[second:])))
        both = np.sort(np.concatenate([left, right]))
        count = [np.bincount((k >> np.uint64(54)).astype(np.int64), minlength=len(xs)) for k in (left, right, both[1:][both[1:] == both[:-1]])]
        return count[2] / (count[0] + count[1] - count[2])


def line_signer(signer: Signer, width: int, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([max(1, len(x) - width + 1) for x in lines])

    def codes(part):
        if len(part) > 1 or size[part[0]] <= 2 * CHUNK:
            yield shingle_codes([lines[n] for n in part], width)
        else:
            line = lines[part[0]]
            for at in range(0, len(line) - width + 1, CHUNK):
                yield shingle_codes([line[at : at + CHUNK + width - 1]], width)

    return signer.sign(size, codes)


def signed_lines(known: DataFrame, signer: Signer, width: int = WIDTH, remembered: int = 100_000) -> DataFrame:
    """(id, h, k, c, c2, s, keys) of the lines that hold more than white space; known has (id, h, text), k counts from 0.

    c and c2 are a hash of the normalised line.  Sketch s and band keys stand only
    with the first line of a class among those a task has lately seen.
    """
    bound_batches(known.sparkSession)
    kind = known.schema["id"].dataType.simpleString()

    def run(batches):
        seen: set = set()
        for batch in batches:
            for part in slices(batch, "text"):
                own, place, digests, normals, fresh = [], [], [], [], []
                if len(seen) > remembered:
                    seen.clear()
                for n, text in enumerate(part.column("text").to_pylist()):
                    for k, line in enumerate((text or "").split("\n")):
                        normal = normal_line(line)
                        if normal:
                            name = xxhash.xxh3_128_digest(normal)
                            own.append(n)
                            place.append(k)
                            digests.append(name)
                            if name not in seen:
                                seen.add(name)
                                fresh.append(len(own) - 1)
                                normals.append(normal)
                if not own:
                    continue
                keys, sketches = line_signer(signer, width, normals)
                names = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                size, s = np.zeros(len(own) + 1, np.int32), np.zeros(len(own), np.int64)
                size[1:][fresh] = signer.bands
                s[fresh] = sketches
                at = pa.array(own)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(keys.reshape(-1)))
                columns = [part.column("id").take(at), part.column("h").take(at), pa.array(place, pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(s), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "k", "c", "c2", "s", "keys"])

    return known.select("id", "h", "text").mapInArrow(run, f"id {kind}, h long, k int, c long, c2 long, s long, keys array<long>")


def candidate_lists(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, c, s, lo, hi): the band lists that hold more than one class, each class once, with the list's extreme codes."""
    postings = signed.where(F.size("keys") > 0).select("keys", "c", "s")
    lists = postings.select(F.explode("keys").alias("key"), "c").groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    lists = scratch.keep(lists.where("lo < hi"))
    bits = signed.sparkSession.sparkContext.broadcast(bloom_of(lists.select("key")))

    def run(batches):
        for batch in batches:
            keys = batch.column("keys")
            flat, sizes = keys.flatten().to_numpy(zero_copy_only=False), np.diff(keys.offsets.to_numpy())
            keep = passing(flat, bits.value)
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes)[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), batch.column("c").take(owner), batch.column("s").take(owner)], names=["key", "c", "s"])

    found = postings.mapInArrow(run, "key long, c long, s long").join(lists, "key").distinct()
    members = scratch.keep(found.select("key", "c", "s", "lo", "hi"))
    scratch.drop(lists)
    return members


def _alike(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MOST_BITS


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _verified(pairs: DataFrame, texts: DataFrame, least: float, make) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough."""
    left = texts.select(F.col("c").alias("a"), F.col("normal").alias("ta"))
    right = texts.select(F.col("c").alias("b"), F.col("normal").alias("tb"))

    def run(batches):
        verifier = make()
        for batch in batches:
            for part in slices(batch, "ta"):
                keep = verifier.jaccards(part.column("ta").to_pylist(), part.column("tb").to_pylist()) >= least
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def similar_components(members: DataFrame, texts_of, scratch: Scratch, make, least: float = 0.8, longest: int = 40, pivots: int = 4) -> DataFrame:
    """(c, root) of the classes that are linked to others.

    members comes from candidate_lists; texts_of(classes) gives (c, normal) of
    the classes in the column c; make() gives a Verifier of such texts.
    """
    sketches = scratch.keep(members.select("c", "s").distinct())
    star = members.select(F.explode(F.array("lo", "hi")).alias("p"), "c").where("p <> c").select(*_pair("p", "c")).distinct()
    near = star.join(sketches.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    near = near.join(sketches.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    near = scratch.keep(near.where(_alike("sa", "sb")).select("a", "b"))
    # of three classes each has been compared with the two extreme ones
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 3")
    lists = scratch.keep(members.join(sizes, "key").select("key", "c", "s", "n"))
    wanted = near.select(F.explode(F.array("a", "b")).alias("c")).union(lists.select("c")).distinct()
    texts = scratch.keep(texts_of(scratch.keep(wanted)))
    links = scratch.keep(_verified(near, texts, least, make))
    roots = scratch.keep(connected_components(links, scratch))
    pending = _open_lists(lists, roots, scratch)
    long = pending.where(F.col("n") > longest)
    if not long.isEmpty():
        roots = _united(roots, _verified(_pivot_pairs(long, pivots), texts, least, make), scratch)
        pending = _open_lists(lists, roots, scratch)
    if not pending.isEmpty():
        short = pending.where(F.col("n") <= longest)
        other = short.select("key", *(F.col(x).alias(f"{x}2") for x in ("c", "s", "root")))
        pairs = short.join(other, "key").where("c < c2 and root <> root2").where(_alike("s", "s2")).select(*_pair("c", "c2"))
        rest = pairs.union(_prefix_pairs(pending.where(F.col("n") > longest), texts, scratch, least, make)).distinct()
        roots = _united(roots, _verified(scratch.keep(rest), texts, least, make), scratch)
    nodes = roots.select(F.col("node").alias("c"), "root")
    return nodes.union(nodes.select(F.col("root").alias("c"), "root").distinct())


def _united(roots: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of the found links (a, b) and those of roots, taken as stars."""
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)
    return scratch.keep(connected_components(scratch.keep(links), scratch))


def _open_lists(lists: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, c, s, n, root) of the lists whose classes are not all of one component yet."""
    fresh = lists.join(roots, F.col("c") == F.col("node"), "left").select("key", "c", "s", "n", F.coalesce("root", "c").alias("root"))
    fresh = scratch.keep(fresh)
    parts = fresh.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    return scratch.keep(fresh.join(parts, "key"))


def _pivot_pairs(pending: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b) of the classes of each list with some of its classes of other components, chosen by hash."""
    order = [F.xxhash64("c", F.lit(k)) for k in range(count)]
    chosen = pending.groupBy("key").agg(*[F.min_by(F.struct("c", "s", "root"), o).alias(f"p{k}") for k, o in enumerate(order)])
    chosen = chosen.select("key", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(count)]))).alias("p"))
    chosen = chosen.select("key", F.col("p.c").alias("c2"), F.col("p.s").alias("s2"), F.col("p.root").alias("root2"))
    pairs = pending.join(chosen, "key").where("c <> c2 and root <> root2").where(_alike("s", "s2"))
    return pairs.select(*_pair("c", "c2")).distinct()


#: Classes of a list that are compared with as many others at once; 64-bit words of a parity
#: sketch, which tells sets apart as long as they may differ in fewer shingles than half its
#: bits, and of the folded sketch that is looked at first.
BLOCK = 1024
PARITY_WORDS = 32
FOLDED_WORDS = 8


def parity_words(codes: np.ndarray) -> np.ndarray:
    """A bitmap with the parity of the number of distinct codes in each place."""
    places = 64 * PARITY_WORDS
    odd = np.bincount(((codes >> np.uint64(20)) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


class Block:
    """Some classes of a list: codes, roots, sizes of their shingle sets and parity sketches."""

    def __init__(self, table: pa.Table):
        self.c, self.root, self.size = (table.column(x).to_numpy() for x in ("c", "root", "size"))
        self.words = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY_WORDS)
        self.folded = np.bitwise_xor.reduce(self.words.reshape(len(self.words), -1, FOLDED_WORDS), axis=1)  # parities of fewer places

    def near(self, other: Block, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of different components may be similar enough: no set differs in fewer shingles than its sketch in bits."""
        found = [np.zeros((2, 0), np.int64)]
        step = max(1, (1 << 18) // max(1, len(other.c)))
        for at in range(0, len(self.c), step):
            own = slice(at, at + step)
            small, large = np.minimum(self.size[own, None], other.size), np.maximum(self.size[own, None], other.size)
            i, j = np.nonzero((self.root[own, None] != other.root) & (small >= least * large - 1e-6))
            i += at
            for words in ("folded", "words"):
                apart = np.bitwise_count(getattr(self, words)[i] ^ getattr(other, words)[j]).sum(axis=1, dtype=np.int64)
                keep = apart <= (self.size[i] + other.size[j]) * ((1 - least) / (1 + least)) + 1e-6
                i, j = i[keep], j[keep]
            found.append(np.array([i, j]))
        return tuple(np.concatenate(found, axis=1))


def _prefix_pairs(pending: DataFrame, texts: DataFrame, scratch: Scratch, least: float, make) -> DataFrame:
    """Pairs (a, b) of different components of a list that may be similar enough, none missed.

    Every class of a list meets every other in one task, which holds two blocks of it at
    most.  Only sizes and parity sketches are sent and compared; pairs are dropped where
    the sizes tell that the sets are not similar, or where sketches differ in more bits
    than the sets may differ in shingles.
    """
    rows = scratch.keep(pending.select("c").distinct().join(texts, "c"))

    def sketch(batches):
        verifier = make()
        for batch in batches:
            for part in slices(batch, "normal"):
                codes = [verifier.codes(text) for text in part.column("normal").to_pylist()]
                columns = [part.column("c"), pa.array([len(x) for x in codes], pa.int64()), pa.array([parity_words(x).tobytes() for x in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["c", "size", "parity"])

    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c")
    sketched = scratch.keep(spread.mapInArrow(sketch, "c long, size long, parity binary"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = pending.select("key", "c", "root", F.pmod(F.xxhash64("c"), blocks).cast("int").alias("own"), blocks.alias("blocks")).join(sketched, "c")
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "own", "c", "root", "size", "parity")

    def compare(key, table):
        x, y = (k.as_py() for k in key[1:])
        own = table.column("own").to_numpy()
        first, second = Block(table.filter(pa.array(own == x))), Block(table.filter(pa.array(own == y)))
        i, j = first.near(second, least)
        one, two = first.c[i], second.c[j]
        fresh = one < two if x == y else one != two  # a block with itself has each pair twice
        one, two = one[fresh], two[fresh]
        return pa.table([np.minimum(one, two), np.maximum(one, two)], names=["a", "b"])

    return met.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def first_places(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, id, h, k, c2, n): the first row of each class, and how many it has."""
    first = signed.groupBy("c").agg(F.min(F.struct("id", "h", "k", "c2")).alias("at"), F.count("*").alias("n"))
    return scratch.keep(first.select("c", "at.*", "n"))


def texts_at(known: DataFrame, places: DataFrame, scratch: Scratch, broadcast_bytes: int) -> DataFrame:
    """(text, ks) of the documents with places (id, h, k, c); ks holds the document's (k, c).

    The places are broadcast if their counted size is at most broadcast_bytes;
    otherwise a Bloom filter of the texts' hashes picks the texts that are shuffled.
    """
    bound_batches(known.sparkSession)
    wanted = scratch.keep(places.groupBy("id", "h").agg(F.collect_list(F.struct("k", "c")).alias("ks")))
    size = wanted.agg(F.coalesce(F.sum(64 + 24 * F.size("ks")), F.lit(0))).first()[0]
    wanted_as = wanted.withColumnsRenamed({"id": "id2", "h": "h2"})
    if size <= broadcast_bytes:
        some, wanted_as = known, F.broadcast(wanted_as)
    else:
        bits = known.sparkSession.sparkContext.broadcast(bloom_of(wanted.select("h").distinct()))

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(passing(batch.column("h").to_numpy(zero_copy_only=False), bits.value)))

        some, wanted_as = known.mapInArrow(run, known.schema), wanted_as.hint("merge")
    return some.join(wanted_as, (F.col("id") == F.col("id2")) & (F.col("h") == F.col("h2"))).select("text", "ks")


def line_texts(known: DataFrame, places: DataFrame, scratch: Scratch, broadcast_bytes: int) -> DataFrame:
    """(c, normal) of the lines at places (id, h, k, c)."""
    both = texts_at(known, places, scratch, broadcast_bytes).select(F.struct("text", "ks").alias("both"))

    def make():
        def pick(rows: list) -> list[list]:
            out = []
            for r in rows:
                lines = r["text"].split("\n")
                out.append([{"c": x["c"], "normal": normal_line(lines[x["k"]])} for x in r["ks"]])
            return [out]

        return pick

    found = map_texts(both, "both", "found array<struct<c:long,normal:string>>", make)
    return found.select(F.explode("found").alias("x")).select("x.*").dropDuplicates(["c"])


def known_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text) of the rows with an id."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("h"), F.col(text_col).alias("text"))
    return rows.where("id is not null")


def duplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, least: float = 0.8, width: int = WIDTH, signer: Signer | None = None,
    longest: int = 40, broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """(id, h, k): the lines to drop; h tells rows with the same id apart by their text."""
    scratch = scratch or Scratch(docs.sparkSession)
    known = known_texts(docs, id_col, text_col)
    signed = scratch.keep(signed_lines(known, signer or Signer(), width))
    classes = first_places(signed, scratch)
    members = candidate_lists(signed, scratch)

    def texts_of(wanted: DataFrame) -> DataFrame:
        return line_texts(known, classes.join(wanted, "c").select("id", "h", "k", "c"), scratch, broadcast_bytes)

    roots = similar_components(members, texts_of, scratch, partial(Verifier, width), least, longest)
    grouped = classes.join(roots, "c", "left").where("n > 1 or root is not null")
    grouped = scratch.keep(grouped.select("c", "c2", F.struct("id", "h", "k").alias("at"), F.coalesce("root", "c").alias("root")))
    best = grouped.groupBy("root").agg(F.min("at").alias("best"))
    judged = grouped.join(best, "root").select("c", F.col("c2").alias("first_c2"), "best")
    judged = scratch.keep(judged)
    gone = signed.select("id", "h", "k", "c", "c2").join(judged, "c")
    return gone.where((F.col("c2") == F.col("first_c2")) & (F.struct("id", "h", "k") != F.col("best"))).select("id", "h", "k")


def _by_content(docs: DataFrame) -> list:
    """An order of rows by a hash of all columns that can be hashed, so that it does not depend on where rows lie."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return [F.xxhash64(*hashed)]


def drop_duplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None, broadcast_bytes: int = 32 << 20, **how
) -> DataFrame:
    """docs with the duplicate lines cut out of the text; dropped_col, if named, counts them and replaces a column of its name.

    The lines to cut are broadcast if their counted size is at most
    broadcast_bytes, and joined by shuffle otherwise.
    """
    scratch = Scratch(docs.sparkSession)
    gone = duplicate_lines(docs, id_col, text_col, scratch, broadcast_bytes=broadcast_bytes, **how)
    lines, own_id, own_h, copy = (free_name([*docs.columns, dropped_col or ""], x) for x in ("gone_lines", "gone_id", "gone_h", "copy_number"))
    gone = gone.distinct().groupBy("id", "h").agg(F.collect_list("k").alias(lines)).withColumnsRenamed({"id": own_id, "h": own_h})
    gone = scratch.keep(gone)
    scratch.leave(gone)
    size = gone.agg(F.coalesce(F.sum(64 + 4 * F.size(lines)), F.lit(0))).first()[0]
    gone = F.broadcast(gone) if size <= broadcast_bytes else gone.hint("merge")
    h = F.coalesce(F.xxhash64(text_col), F.lit(0))

    def cut(rows: DataFrame) -> DataFrame:
        return rows.join(gone, (F.col(id_col) == F.col(own_id)) & (h == F.col(own_h)), "left").drop(own_id, own_h)

    twice = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias(own_id), h.alias(own_h)).count().where("count > 1")
    twice = scratch.keep(twice.drop("count"))
    pieces = F.split(F.col(text_col), "\n")
    if twice.isEmpty():
        joined = cut(docs)
    else:  # of rows equal in id and text one is cut like any other, the others keep blank lines only
        same = (F.col(id_col) == F.col(own_id)) & (h == F.col(own_h))
        copies = docs.join(twice, same)
        copies = copies.withColumn(copy, F.row_number().over(Window.partitionBy(own_id, own_h).orderBy(*_by_content(docs)))).drop(own_id, own_h)
        at = F.transform(pieces, lambda x, k: F.when(~x.rlike(BLANK), k))
        later = copies.where(F.col(copy) > 1).drop(copy).withColumn(lines, F.array_compact(at))
        alone = docs.join(twice, same, "left_anti")
        joined = cut(alone).unionByName(cut(copies.where(F.col(copy) == 1).drop(copy))).unionByName(later)
    kept = F.filter(pieces, lambda _, k: ~F.array_contains(F.col(lines), k))
    out = {text_col: F.when(F.col(lines).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))}
    if dropped_col:
        out[dropped_col] = F.when(F.col(lines).isNotNull(), F.size(lines)).otherwise(0).cast("long")
    return joined.withColumns(out).select(*[c for c in docs.columns if c.lower() != (dropped_col or "").lower()], *([dropped_col] if dropped_col else []))
