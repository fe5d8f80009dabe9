"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 8).

A word is a run of word-start marks with what follows it; no piece of the
supported vocabularies crosses a word start, so words merge on their own and
equal words of a task are merged once.  All new words of a batch lie in one
flat array of symbols.  In each round the pair ranks are looked up, the smallest
rank of each word is found with a segmented minimum, and its leftmost
non-overlapping occurrences merge at once; words with no pair left are moved
out, until none remains.  A word in which a merge makes a pair of no larger
rank merges only its leftmost pair in that round, so the outcome is that of
merging one pair at a time.  Words of more than ``LONG`` symbols with such pairs
go through a heap of pairs instead, which keeps them near-linear.

Edge cases: a null text counts as empty and has only the end id; unknown
characters become byte pieces; undecodable bytes decode to U+FFFD each; repeated rows
are encoded alike; of equal ranks the leftmost pair merges; very long texts are encoded
whole, one a batch; an empty table gives an empty result; the columns made replace
columns of docs with their names.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gneiss.llm.texts import bound_batches, slices, without

MARK = "▁"
LONG = 400
NONE = np.int32(2**31 - 1)
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SLOTS_PER_PAIR = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class PieceModel:
    """Lookup arrays of a vocabulary; their size is that of the vocabulary."""

    symbol_of: np.ndarray  # by code point, -1 if unknown
    slot_key: np.ndarray  # open-addressed pairs of symbols
    slot_rank: np.ndarray
    slot_to: np.ndarray
    piece_of: np.ndarray  # by symbol: piece id, or -1 for a character that is no piece
    symbol_text: list
    byte_base: int
    end_id: int
    piece_bytes: np.ndarray  # all pieces' bytes, flat
    piece_at: np.ndarray
    is_byte: np.ndarray


def load_model(path: str) -> PieceModel:
    """Arrays of a sentencepiece BPE model file with identity normalisation and byte fallback."""
    with open(path, "rb") as f:
        data = f.read()
    texts, scores, kinds, flags, charsmap, bpe = [], [], [], {3: 1, 4: 1, 5: 1}, b"", False
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0" * 4))[0])
            kinds.append(piece.get(3, 1))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            charsmap = spec.get(2, b"")
            flags |= {k: spec[k] for k in flags if k in spec}
    if not bpe or charsmap or flags != {3: 1, 4: 0, 5: 1} or kinds.count(6) != 256 or set(kinds) - {1, 2, 3, 6}:
        raise ValueError("needs a BPE model with byte fallback, a dummy prefix and no normalisation")
    normal = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == 1}
    if any(MARK in t.lstrip(MARK) for t in normal):
        raise ValueError("a piece crosses a word start")
    symbols = dict(normal)
    for t in normal:
        for c in t:
            symbols.setdefault(c, len(texts) + len(symbols))
    names = sorted(symbols, key=symbols.get)
    number = {t: n for n, t in enumerate(names)}
    ranks = {s: n for n, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
    keys, rank, to = [], [], []
    for t, i in normal.items():
        for cut in range(1, len(t)):
            a, b = number.get(t[:cut]), number.get(t[cut:])
            if a is not None and b is not None:
                keys.append(a * len(names) + b)
                rank.append(ranks[scores[i]])
                to.append(number[t])
    size = 1 << (len(keys) * _SLOTS_PER_PAIR).bit_length()
    slot_key, slot_rank, slot_to = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
    homes = _slots(np.array(keys, np.int64), size)
    for key, home, r, t in zip(keys, homes.tolist(), rank, to):
        while slot_key[home] >= 0:
            home = (home + 1) % size
        slot_key[home], slot_rank[home], slot_to[home] = key, r, t
    symbol_of = np.full(0x110000, -1, np.int32)
    for t in names:
        if len(t) == 1:
            symbol_of[ord(t)] = number[t]
    first_byte = kinds.index(6)
    if any(texts[first_byte + b] != f"<0x{b:02X}>" for b in range(256)):
        raise ValueError("byte pieces are not in order")
    raw = [b"" if k in (2, 3) else bytes([i - first_byte]) if k == 6 else t.replace(MARK, " ").encode() for i, (t, k) in enumerate(zip(texts, kinds))]
    return PieceModel(
        symbol_of, slot_key, slot_rank, slot_to, np.array([normal.get(t, -1) for t in names], np.int32), names, first_byte, texts.index("</s>"),
        np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.array(kinds) == 6,
    )


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _pairs(m: PieceModel, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and outcome of merging symbols a and b; rank NONE where they don't."""
    rank, to = np.full(len(a), NONE, np.int32), np.zeros(len(a), np.int32)
    todo = np.flatnonzero((a >= 0) & (b >= 0))
    key = a[todo].astype(np.int64) * len(m.symbol_text) + b[todo]
    slot = _slots(key, len(m.slot_key))
    while len(todo):
        held = m.slot_key[slot]
        hit = held == key
        rank[todo[hit]], to[todo[hit]] = m.slot_rank[slot[hit]], m.slot_to[slot[hit]]
        more = ~hit & (held >= 0)
        todo, key, slot = todo[more], key[more], (slot[more] + 1) % len(m.slot_key)
    return rank, to


def _leftmost(chosen: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of each run of adjacent chosen pairs of a word every other one, from the left."""
    at = np.flatnonzero(chosen)
    if not len(at):
        return at
    fresh = np.concatenate([[True], (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - start) % 2 == 0]


def _apply(sym: np.ndarray, word: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sym = sym.copy()
    sym[at] = to[at]
    keep = np.ones(len(sym), bool)
    keep[at + 1] = False
    made = np.zeros(len(sym), bool)
    made[at] = True
    return sym[keep], word[keep], made[keep]


def _ranks(m: PieceModel, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pair that each symbol begins; NONE at the end of a word."""
    rank, to = _pairs(m, sym, np.concatenate([sym[1:], [-1]]).astype(np.int32))
    rank[np.concatenate([word[1:] != word[:-1], [True]])] = NONE
    return rank, to


def merge_words(m: PieceModel, words: list[str]) -> list[np.ndarray]:
    """Symbols of each word after all merges; unknown characters are -2 - code point."""
    if not words:
        return []
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sym = m.symbol_of[codes]
    sym = np.where(sym < 0, -2 - codes, sym).astype(np.int32)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    rank, to = _ranks(m, sym, word)
    done: list = [None] * len(words)
    while len(sym):
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.concatenate([starts, [len(sym)]]))
        over = least == NONE
        if over.any():
            ends = starts + sizes
            for n in np.flatnonzero(over).tolist():
                done[word[starts[n]]] = sym[starts[n] : ends[n]]
            stay = np.repeat(~over, sizes)
            sym, word, rank, to = sym[stay], word[stay], rank[stay], to[stay]
            least, sizes = least[~over], sizes[~over]
            if not len(sym):
                break
        floor = np.repeat(least, sizes)
        at = _leftmost(rank == floor, word)
        made_sym, made_word, made = _apply(sym, word, at, to)
        made_rank, made_to = _ranks(m, made_sym, made_word)
        limit = np.full(len(words), -1, np.int64)
        limit[word] = floor
        touched = made | np.concatenate([made[1:], [False]])
        early = at[:-1][(np.diff(at) == 2) & (word[at[1:]] == word[at[:-1]])]  # meets the next pair before that merges
        early = early[_pairs(m, to[early], sym[early + 2])[0] <= floor[early]]
        risky = np.union1d(made_word[touched & (made_rank <= limit[made_word])], word[early])
        if len(risky):
            many = np.bincount(word[at], minlength=len(words))
            risky = risky[many[risky] > 1]
        if len(risky):
            size = np.bincount(word, minlength=len(words))
            long = risky[size[risky] > LONG]
            for w in long.tolist():
                done[w] = _heap_merge(m, sym[word == w])
            only = np.isin(word[at], risky)
            first = np.concatenate([[True], np.diff(word[at]) != 0])
            at = at[~only | first]
            made_sym, made_word, made = _apply(sym, word, at, to)
            if len(long):
                stay = ~np.isin(made_word, long)
                made_sym, made_word = made_sym[stay], made_word[stay]
            if not len(made_sym):
                break
            made_rank, made_to = _ranks(m, made_sym, made_word)
        sym, word, rank, to = made_sym, made_word, made_rank, made_to
    return done


def _heap_merge(m: PieceModel, sym: np.ndarray) -> np.ndarray:
    """One word, one pair at a time: smallest rank first, then leftmost."""
    s = sym.tolist()
    left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
    rank, to = _ranks(m, sym, np.zeros(len(s), np.int8))
    heap = [(r, i, s[i], s[i + 1], t) for i, (r, t) in enumerate(zip(rank.tolist(), to.tolist())) if r != NONE]
    heapq.heapify(heap)

    def push(i, j):
        if i >= 0 and j >= 0:
            r, t = _pairs(m, np.array([s[i]], np.int32), np.array([s[j]], np.int32))
            if r[0] != NONE:
                heapq.heappush(heap, (int(r[0]), i, s[i], s[j], int(t[0])))

    while heap:
        _, i, a, b, t = heapq.heappop(heap)
        j = right[i]
        if s[i] != a or j < 0 or s[j] != b:
            continue
        s[i], s[j], right[i] = t, None, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        push(left[i], i)
        push(i, right[i])
    return np.array([x for x in s if x is not None], np.int32)


def _piece_ids(m: PieceModel, sym: np.ndarray) -> np.ndarray:
    if len(sym) and sym.min() >= 0:
        ids = m.piece_of[sym]
        if ids.min() >= 0:
            return ids
    out: list[int] = []
    for x in sym.tolist():
        piece = int(m.piece_of[x]) if x >= 0 else -1
        if piece >= 0:
            out.append(piece)
        else:
            raw = (chr(-2 - x) if x < 0 else m.symbol_text[x]).encode("utf-8", "surrogatepass")
            out.extend(m.byte_base + b for b in raw)
    return np.array(out, np.int32)


class Encoder:
    """Encodes batches of texts; remembers words up to a bound, then starts anew."""

    def __init__(self, model: PieceModel, remembered: int = 200_000):
        self.m, self.remembered = model, remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        merged = [_piece_ids(self.m, s) for s in merge_words(self.m, words)]
        size = np.array([len(x) for x in merged], np.int64)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *merged])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each with the end id, and their offsets."""
        if len(self.known) > self.remembered:
            self.forget()
        known, before, order, counts = self.known, len(self.known), [], []
        for text in texts:
            words = _WORD.findall(MARK + text.replace(" ", MARK)) if text else []
            counts.append(len(words))
            order.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        if len(known) > before:
            self.learn(list(known)[before:])
        word = np.concatenate([np.empty(0, np.int64), *order])
        size = self.size[word] if len(word) else word
        ends = np.cumsum(size)
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[word] - (ends - size), size) + np.arange(total)] if total else np.empty(0, np.int32)
        return np.insert(ids, per_text[1:], self.m.end_id), per_text + np.arange(len(texts) + 1)


def _as_text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def decode(m: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of flat ids; the first piece loses one word-start mark, the end id has no text."""
    size = m.piece_at[ids + 1] - m.piece_at[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(m.piece_at[ids] - ends[:-1], size) + np.arange(ends[-1])
    raw = m.piece_bytes[at].tobytes()
    cuts = ends[offsets].tolist()
    out = []
    for a, b, first, past in zip(cuts, cuts[1:], offsets[:-1].tolist(), offsets[1:].tolist()):
        if a < b and raw[a] == 32 and not m.is_byte[ids[first:past][size[first:past] > 0][0]]:
            a += 1
        out.append(_as_text(raw[a:b]))
    return out


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs without the text, with its ids (array<int>, end id last) and the text that they decode to."""
    return _mapped(docs, model_path, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())])


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs without the text, with its ids (array<int>, end id last)."""
    return _mapped(docs, model_path, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])


def _mapped(docs: DataFrame, model_path: str, text_col: str, fields: list) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast(vars(load_model(model_path)))  # bounded by the vocabulary
    bound_batches(spark)
    kept = [c for c in without(docs.columns, [f.name for f in fields]) if c != text_col]
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        encoder = Encoder(PieceModel(**model.value))
        for batch in batches:
            for rows in slices(batch, text_col):
                ids, offsets = encoder.encode(rows.column(text_col).to_pylist())
                columns = [rows.column(c).cast(arrow.field(c).type) for c in kept]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                columns.append(lists.cast(arrow.field(len(kept)).type))
                if len(fields) > 1:
                    columns.append(pa.array(decode(encoder.m, ids, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def digests(encoded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Token count and SHA-256 of the ids and the decoded text in place of both."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    made = [ids_col, decoded_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    return encoded.select(
        *without(encoded.columns, made),
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(decoded_col, 256).alias("decoded_sha256"),
    )
