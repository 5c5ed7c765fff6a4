"""Exact deduplication by an extendible-hash index on shared files.

Texts are equal when they are identical without the white space ``[\\x20\\x09-\\x0D]``. The index is built so:

1. A histogram of the distinct hashes by their first ``SLOT_BITS`` bits sizes the directory. It starts with one
   bucket; an overfull bucket splits by one more bit, and the directory doubles when that bucket is as deep
   as the directory itself. A directory has at most ``2 ** SLOT_BITS`` slots however large the input;
   buckets still overfull there just hold longer files.
2. Each scan task folds equal texts of a few megabytes to one entry, so that a text held by a third of all rows
   reaches its owner as a few entries a task.
3. Owner tasks hold ranges of hashes, sorted. An owner chains the different texts of one hash, comparing
   bytes, and writes a record for each link of a chain to the file of its bucket.

Rows then look their records up: the directory names the bucket of a hash, and the bucket's records are met by hash and
digest. Of equal texts the row with the most code points stays,
then the smallest doc_id (NULL last), then the smallest hash of the original text; of rows alike in all of
that (repeated rows) exactly one stays. NULL counts as empty. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.session import fresh_path, materialise

from .common import steps, text_key, whole_texts

SLOT_BITS = 16
#: Distinct hashes that a bucket holds before it splits.
CAPACITY = 20_000

WHITE_SPACE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def directory(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bucket of each slot of the finished directory, and the local depth of each bucket.

    ``counts`` holds the distinct hashes of each of the finest slots, in the order of their first bits.
    """
    deepest = len(counts).bit_length() - 1
    before = np.append(0, np.cumsum(counts))
    slots, depth = np.zeros(1, np.int32), 0
    prefix, local = [0], [0]
    open_ = [0]
    while open_:
        b = open_.pop()
        first, end = prefix[b] << (deepest - local[b]), (prefix[b] + 1) << (deepest - local[b])
        if local[b] == deepest or before[end] - before[first] <= capacity:
            continue
        if local[b] == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        local[b] += 1
        prefix[b] <<= 1
        prefix.append(prefix[b] + 1)
        local.append(local[b])
        new = len(local) - 1
        slots[prefix[new] << (depth - local[new]) : (prefix[new] + 1) << (depth - local[new])] = new
        open_ += [b, new]
    return slots, local


def _rank(points: int, doc_id: int | None, key: int) -> tuple:
    return (-points, doc_id is None, doc_id or 0, key)


_ENTRY = "owner int, bucket int, h long, norm binary, n long, points long, doc_id long, text_key long"
_RECORD = "bucket int, h long, link int, text_sha256 string, group_size long, keep_points long, keep_id long, keep_key long"


def _fold(owners: np.ndarray, slots: np.ndarray):
    """Entries of the rows: equal texts of a step as one."""

    def task(batches):
        for batch in steps(batches, column="norm"):
            found: dict[tuple, list] = {}
            for h, norm, points, doc_id, key in zip(*(batch.column(c).to_pylist() for c in ("h", "norm", "points", "doc_id", "text_key")), strict=True):
                entry, rank = found.setdefault((h, norm), [0, None]), _rank(points, doc_id, key)
                entry[0] += 1
                if entry[1] is None or rank < entry[1]:
                    entry[1] = rank
            if not found:
                continue
            h = np.array([k[0] for k in found], np.int64)
            at = (h >> (64 - SLOT_BITS)) & ((1 << SLOT_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(owners[at].astype(np.int32)),
                    pa.array(slots[at * len(slots) >> SLOT_BITS].astype(np.int32)),
                    pa.array(h),
                    pa.array([k[1] for k in found], pa.binary()),
                    pa.array([e[0] for e in found.values()], pa.int64()),
                    pa.array([-e[1][0] for e in found.values()], pa.int64()),
                    pa.array([None if e[1][1] else e[1][2] for e in found.values()], pa.int64()),
                    pa.array([e[1][3] for e in found.values()], pa.int64()),
                ],
                ["owner", "bucket", "h", "norm", "n", "points", "doc_id", "text_key"],
            )

    return task


def _chain(batches):
    """An owner's entries, sorted by hash, to one record for each different text of a hash."""
    current, bucket, links = None, 0, []

    def records() -> list[tuple]:
        return [
            (bucket, current, k, hashlib.sha256(norm).hexdigest(), n, -rank[0], None if rank[1] else rank[2], rank[3])
            for k, (norm, n, rank) in enumerate(links)
        ]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        names = ["bucket", "h", "link", "text_sha256", "group_size", "keep_points", "keep_id", "keep_key"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    for batch in steps(batches, column="norm"):
        rows = []
        for h, at, norm, n, points, doc_id, key in zip(*(batch.column(c).to_pylist() for c in ("h", "bucket", "norm", "n", "points", "doc_id", "text_key")), strict=True):
            if h != current:
                rows += records()
                current, bucket, links = h, at, []
            rank = _rank(points, doc_id, key)
            for link in links:
                if link[0] == norm:
                    link[1], link[2] = link[1] + n, min(link[2], rank)
                    break
            else:
                links.append([norm, n, rank])
        if rows:
            yield out(rows)
    if links:
        yield out(records())


def build_index(docs: DataFrame, capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame]:
    """(rows with their hash, digest and bucket, index records); both read tables in the shared folder."""
    spark = docs.sparkSession
    texts = whole_texts(docs, text_key().alias("text_key")).withColumn("norm", normalised(F.col("text"))).withColumn("h", hash_of(F.col("norm")).cast("long"))
    keyed = materialise(
        texts.select("doc_id", F.length("text").cast("long").alias("points"), F.sha2("norm", 256).alias("text_sha256"), "text_key", "h"), "exact-rows"
    )
    slot = F.shiftrightunsigned("h", 64 - SLOT_BITS)
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for row in keyed.select("h").distinct().groupBy(slot.alias("slot")).count().collect():  # at most 2 ** SLOT_BITS rows
        counts[row["slot"]] = row["count"]
    slots, _ = directory(counts, capacity)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = np.minimum((np.cumsum(counts) - counts) * tasks // max(1, int(counts.sum())), tasks - 1)
    entries = texts.select("doc_id", F.length("text").cast("long").alias("points"), "text_key", F.col("norm").cast("binary").alias("norm"), "h").mapInArrow(
        _fold(owners, slots), _ENTRY
    )
    owned = entries.repartitionById(tasks, F.col("owner")).sortWithinPartitions("h")
    path = fresh_path(spark, "exact-index")
    owned.mapInArrow(_chain, _RECORD).write.partitionBy("bucket").parquet(path)
    depth = len(slots).bit_length() - 1
    listed = spark.createDataFrame(list(enumerate(slots.tolist())), "slot long, bucket int")  # at most 2 ** SLOT_BITS rows
    at = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    found = keyed.withColumn("slot", at).join(F.broadcast(listed), "slot").drop("slot")
    return found, spark.read.schema(_RECORD).parquet(path)


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, keep_id, group_size, kept, text_sha256."""
    keyed, index = build_index(docs, capacity, hash_of)
    found = keyed.join(index.drop("link"), ["bucket", "h", "text_sha256"])
    alike = Window.partitionBy("doc_id", "text_sha256", "text_key").orderBy("points")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key")) & (F.row_number().over(alike) == 1)
    return found.select("doc_id", "text_key", "keep_id", "group_size", best.alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, kept: DataFrame, *more: str) -> DataFrame:
    """The rows of ``docs`` named by (doc_id, text_key) in ``kept``, once each, and the columns ``more`` of ``kept``."""
    names = kept.select(F.col("doc_id").cast("long").alias("_kept_id"), F.col("text_key").alias("_kept_key"), *more)
    once = names.dropDuplicates(["_kept_id", "_kept_key"])
    keyed = docs.withColumns({"_row_id": F.col("doc_id").cast("long"), "_row_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    met = keyed.join(once, F.col("_row_id").eqNullSafe(F.col("_kept_id")) & (F.col("_row_key") == F.col("_kept_key")))
    alike = Window.partitionBy("_row_id", "_row_key").orderBy(F.lit(0))
    return met.withColumn("_nth", F.row_number().over(alike)).where("_nth = 1").select(*docs.columns, *more)
