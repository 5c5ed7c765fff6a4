"""What the corpus operators share: reading texts, Arrow batches in bounded pieces, hashed lookup tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that one step inside a task works on at once (a single longer text is one step).
STEP_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """Document ids and texts only, so that other columns, whatever their names, never meet ours. NULL texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def text_key() -> Column:
    """Tells rows that share a doc_id apart by their text."""
    return F.xxhash64("text")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without NULLs, and where each value starts (one more for the end)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut by rows, each piece with at most ``limit`` bytes of text or a single row."""
    for batch in batches:
        texts = batch.column(column)
        bounds = bytes_of(texts)[1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class HashTable:
    """Numpy open addressing: the place of an integer key among the keys it was built from, or -1."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.asarray(keys, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.places[slot[won]] = keys[left[won]], left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Keys are 0 or more."""
        slot = self._slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.places[slot], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[open_]
            found[open_[hit]] = self.places[slot[hit]]
            on = ~hit & (held != -1)
            open_, slot = open_[on], slot[on]
        return found
