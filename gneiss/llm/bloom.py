"""Bloom filters over 64-bit keys, for dropping most unwanted rows before a shuffle.

A filter has about sixteen bits a key up to MOST_WORDS words (16 MB); of more keys
it lets more pass, and none is built where it would let nearly everything pass.
An exact join follows wherever one is used, so it changes speed and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)
MOST_WORDS = 1 << 21


def _words_of(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = keys.view(np.uint64) * _MIX
    mask = np.zeros(len(mixed), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63))
    return ((mixed >> np.uint64(32)) % np.uint64(words)).astype(np.int64), mask


def bloom_of(keys: DataFrame, most_words: int = MOST_WORDS) -> np.ndarray:
    """A filter over the only column (long, not null) of keys; at most 8 * most_words bytes come to the driver.

    The result is empty, which lets everything pass, if there are more than ten keys a word.
    """
    name = keys.columns[0]
    count = keys.count()
    if count > 10 * most_words:
        return np.zeros(0, np.uint64)
    words = min(most_words, 1 << max(8, (count // 4).bit_length()))

    def run(batches):
        for batch in batches:
            word, mask = _words_of(batch.column(name).to_numpy(zero_copy_only=False), words)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    table = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[table.column("word").to_numpy()] = table.column("mask").to_numpy()
    return bits.view(np.uint64)


def passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    if not len(bits):
        return np.ones(len(keys), bool)
    word, mask = _words_of(keys, len(bits))
    return (bits[word] & mask) == mask
