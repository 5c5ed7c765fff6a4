"""Removal of repeated byte strings by suffix arrays over shards of the corpus.

Every byte covered by a ``length``-byte string that also starts anywhere else goes; strings are judged on the input,
overlaps count, and strings never cross texts. Each string (window) has one anchor: the least hash of ``GRAM``
bytes in it, the leftmost of equals. Equal windows have equal anchors at the same place, so all work is split by
anchor, and nothing is lost:

1. A segment is a run of windows of a text with one anchor. Segments alike in all bytes, that occur more than
   once, repeat as a whole; this settles copies, however many, by counting.
2. Where one anchor has different segments, one of each goes to the anchor's shard. A task takes its shards
   from Spark's disk-backed sort in blocks, and sorts the suffixes of a block by induced sorting: queues of tuples
   (suffix, common prefix), from the sorted LMS suffixes to all (see ``induced``). Windows whose neighbours
   share ``length`` bytes with them repeat.
3. An anchor with over ``CROWD`` different segments (say, a line in front of a third of all texts) is split anew:
   its windows by where the anchor is in them, in classes of 64, 8, 1 places, and by the bytes that all windows
   of the class share. Classes of one are whole windows, and settled by counting.

Texts are shuffled once, into files bucketed by row, where one of each repeated row stands for all; every
list of places meets its texts there, and only the list moves. A task works on ``STEP`` windows at once; long texts
are cut into steps that overlap by all but one byte of a window, so that none is missed.

NULL and empty texts have no bytes; shorter texts than ``length`` stay as they are. Repeated rows are copies like any
others: all their bytes go if they are long enough. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.session import fresh_path, materialise

from .common import bytes_of, steps, text_key, whole_texts
from .induced import sorted_suffixes

LENGTH = 400
GRAM = 32
#: Different segments of an anchor that one block may hold; bytes of a block; windows of a step.
CROWD = 1000
BLOCK = 1 << 19
STEP = 1 << 18
CLASSES = (64, 8, 1)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(8240117).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE_BITS = 28


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at each place, a polynomial modulo 2**64; equal bytes have equal hashes anywhere."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    total = np.append(np.uint64(0), np.cumsum(_BYTES[data] * _powers(_BASE, n), dtype=np.uint64))
    out = (total[gram:] - total[:-gram]) * _powers(_BASE_INVERSE, n - gram + 1)
    return (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of the window that starts at each place, and the hash of every gram."""
    hashes = gram_hashes(data, gram)
    wide = length - gram + 1
    n = len(hashes) - wide + 1
    if n < 1:
        return np.zeros(0, np.int64), hashes
    packed = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.append(packed, np.full(-len(packed) % wide, ~np.uint64(0))).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])
    return (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64), hashes


_FOUND = "key long, one long, two long, doc_id long, text_key long, start int, windows int, lead int, weight long"
_COLUMNS = [x.split()[0] for x in _FOUND.split(", ")]


def _batch(doc_id, text_key_, columns: list[np.ndarray], weight) -> pa.RecordBatch:
    key, one, two, start, windows, lead = columns
    arrays = [pa.array(x) for x in (key, one, two)] + [doc_id, text_key_]
    arrays += [pa.array(x.astype(np.int32)) for x in (start, windows, lead)] + [pa.array(weight)]
    return pa.RecordBatch.from_arrays(arrays, _COLUMNS)


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each stretch of bytes and of its anchor's place in it."""
    from xxhash import xxh3_128_digest

    both = b"".join([xxh3_128_digest(data[a:b], k) for a, b, k in zip(starts.tolist(), ends.tolist(), lead.tolist(), strict=True)])
    halves = np.frombuffer(both, "<i8").reshape(-1, 2)
    return halves[:, 0].astype(np.int64), halves[:, 1].astype(np.int64)


def _segments(length: int, gram: int):
    """Segments of every text by the windows' anchors."""

    def found(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, lo: int) -> Iterator[pa.RecordBatch]:
        """Segments of the windows that start in the step from ``lo`` on."""
        data = data[lo : lo + STEP + length - 1]
        anchors, hashes = window_anchors(data, length, gram)
        if not len(anchors):
            return
        place = np.arange(lo, lo + len(anchors))
        text = np.searchsorted(bounds, place, "right") - 1
        ok = place + length <= bounds[text + 1]
        first = ok.copy()
        first[1:] &= (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            return
        last = np.flatnonzero(ok & np.append(first[1:] | ~ok[1:], True))
        windows = last - start + 1
        lead = anchors[start] - start
        one, two = _digests(data.tobytes(), start, last + length, lead)
        of = pa.array(text[start])
        yield _batch(
            part.column("doc_id").take(of),
            part.column("text_key").take(of),
            [hashes[anchors[start]].view(np.int64), one, two, lo + start - bounds[text[start]], windows, lead],
            np.ones(len(start), np.int64),
        )

    def task(batches):
        for part in steps(batches, STEP):
            data, bounds = bytes_of(part.column("text"))
            for lo in range(0, len(data), STEP):
                yield from found(part, data, bounds, lo)

    return task


def _classes(length: int, width: int):
    """Segments of crowded anchors cut by where the anchor is in a window, keyed by the bytes that all windows share."""
    from xxhash import xxh3_64_intdigest

    def task(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py().encode()
                doc_id, tkey = batch.column("doc_id").slice(row, 1), batch.column("text_key").slice(row, 1)
                rows: list[tuple] = []
                for item in batch.column("items")[row].as_py():
                    anchor = item["start"] + item["lead"]
                    lo = item["start"]
                    while lo < item["start"] + item["windows"]:
                        kind = (anchor - lo) // width
                        hi = min(item["start"] + item["windows"], anchor - kind * width + 1)
                        core = text[anchor - kind * width : anchor - (kind + 1) * width + 1 + length]
                        rows.append((xxh3_64_intdigest(core, kind) - (1 << 63), lo, hi - lo, anchor - lo, item["weight"]))
                        lo = hi
                key, start, windows, lead, weight = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                one, two = _digests(text, start, start + windows - 1 + length, lead)
                of = pa.array(np.zeros(len(rows), np.int64))
                yield _batch(doc_id.take(of), tkey.take(of), [key, one, two, start, windows, lead], weight)

    return task


def _cut(length: int):
    """The bytes of the segments listed beside each text."""

    def task(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py().encode()
                items = batch.column("items")[row].as_py()
                of = pa.array(np.zeros(len(items), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["key"] for x in items], pa.int64()),
                        batch.column("doc_id").slice(row, 1).take(of),
                        batch.column("text_key").slice(row, 1).take(of),
                        pa.array([x["start"] for x in items], pa.int32()),
                        pa.array([x["weight"] for x in items], pa.int64()),
                        pa.array([text[x["start"] : x["start"] + x["windows"] - 1 + length] for x in items], pa.binary()),
                    ],
                    ["key", "doc_id", "text_key", "start", "weight", "data"],
                )

    return task


_RANGE = "doc_id long, text_key long, start int, windows int"


def repeated_windows(texts: list[bytes], weight: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(text, first window, number of windows) of the runs of windows that occur more than once, weights counted."""
    order, common, starts = sorted_suffixes(texts, length)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.minimum(np.searchsorted(starts, order, "right") - 1, len(texts) - 1)
    whole = order - starts[text] + length <= size[text]
    group = np.cumsum(common < length)
    total = np.bincount(group[whole], weights=weight[text[whole]], minlength=int(group[-1]) + 1)
    again = np.zeros(int(size.sum()) + len(texts) + 2, bool)
    again[order[whole & (total[group] > 1)]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    of = np.searchsorted(starts, edge[0::2], "right") - 1
    return list(zip(of.tolist(), (edge[0::2] - starts[of]).tolist(), (edge[1::2] - edge[0::2]).tolist(), strict=True))


def _sort_blocks(length: int):
    """Runs of repeated windows of segments seen once, from shards sorted by anchor."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = repeated_windows([r[4] for r in rows], np.array([r[3] for r in rows]), length)
        out = [(rows[k][0], rows[k][1], rows[k][2] + first, n) for k, first, n in found if rows[k][3] == 1]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "text_key", "start", "windows"])

    def task(batches):
        rows: list[tuple] = []
        held, key_now = 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text_key", "start", "weight", "data")), strict=True):
                if key != key_now and held >= BLOCK:
                    yield from solve(rows)
                    rows, held = [], 0
                key_now = key
                rows.append(tuple(row))
                held += len(row[4])
        if rows:
            yield from solve(rows)

    return task


def _at() -> Column:
    """One key, never NULL, of rows with one id and one text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key").cast("string"))


def _bucketed(texts: DataFrame) -> DataFrame:
    """The texts by ``at``, each row once, as bucketed files in the shared folder; the catalog does not keep them."""
    spark = texts.sparkSession
    buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh_path(spark, "texts")
    name = path.rpartition("/")[2].replace("-", "_")
    named = texts.withColumn("at", _at())
    again = materialise(named.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at"), "again")
    once = named.join(again, "at", "left_anti").unionByName(named.join(again, "at", "left_semi").dropDuplicates(["at"]))
    once.repartition(buckets, "at").write.bucketBy(buckets, "at").option("path", path).saveAsTable(name, format="parquet")
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the entry only: the files have a path of their own
    return stored


def _with_texts(stored: DataFrame, items: DataFrame, column: str) -> DataFrame:
    """``items`` (doc_id, text_key and an array in ``column``) beside their texts."""
    listed = items.select(_at().alias("at"), column)
    return stored.join(listed, "at").select("doc_id", "text_key", "text", column)


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of each text as an array: never more than the text has segments, as copies come once."""
    return rows.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*columns)).alias("items"))


def repeated_ranges(
    texts: DataFrame, stored: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, text_key, start, windows): runs of windows that occur more than once, as a table.
    ``stored`` are the same texts as ``_bucketed`` keeps them."""
    found = texts.mapInArrow(_segments(length, gram), _FOUND)
    out = None
    for width in (*CLASSES, None):
        found = materialise(found, "segments")
        groups = materialise(
            found.groupBy("key", "one", "two").agg(
                F.sum("weight").alias("weight"), F.min(F.struct("doc_id", "text_key", "start", "windows", "lead")).alias("first")
            ),
            "groups",
        )
        copied = groups.where("weight > 1").select("key", "one", "two")
        ranges = found.join(copied, ["key", "one", "two"]).select("doc_id", "text_key", "start", "windows")
        mixed = groups.groupBy("key").agg(F.count("*").alias("different")).where("different > 1")
        firsts = materialise(groups.join(mixed, "key").select("key", "different", "weight", "first.*"), "firsts")
        few = _listed(firsts.where(F.col("different") <= crowd), "key", "start", "windows", "weight")
        cut = _with_texts(stored, materialise(few, "few"), "items").mapInArrow(
            _cut(length), "key long, doc_id long, text_key long, start int, weight long, data binary"
        )
        sorted_ = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_blocks(length), _RANGE)
        ranges = materialise(ranges.union(sorted_).distinct(), "ranges")
        out = ranges if out is None else out.union(ranges)
        many = firsts.where(F.col("different") > crowd)
        if width is None or many.isEmpty():
            return out
        listed = materialise(_listed(many, "start", "windows", "lead", "weight"), "crowded")
        found = _with_texts(stored, listed, "items").mapInArrow(_classes(length, width), _FOUND)
    return out


def _removed(length: int):
    """What is left of texts beside the runs of windows that repeat in them."""

    def task(batches):
        for batch in batches:
            rows = []
            for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                edges = np.zeros(len(data) + 1, np.int64)
                for x in items:
                    edges[x["start"]] += 1
                    edges[x["start"] + x["windows"] - 1 + length] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
                rows.append((int(gone.sum()), spans, data[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ],
                ["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return task


_LEFT = "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key, n_removed, n_spans, kept_sha256 and kept (the bytes left) of the texts that lose any; of
    repeated rows, which lose alike, one."""
    texts = whole_texts(docs, text_key().alias("text_key"))
    stored = _bucketed(texts)
    ranges = materialise(_listed(repeated_ranges(texts, stored, length, gram, crowd), "start", "windows"), "removals")
    return _with_texts(stored, ranges, "items").mapInArrow(_removed(length), _LEFT)


def removal_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts = whole_texts(docs, text_key().alias("text_key"))
    rows = texts.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    left = without_repeats(docs, length, gram, crowd).drop("kept")
    a, b = rows.alias("a"), left.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    zero = F.lit(0).cast("long")
    return a.join(b, same, "left").select(
        "a.doc_id",
        "a.n_bytes",
        F.coalesce("b.n_removed", zero).alias("n_removed"),
        F.coalesce("b.n_spans", zero).alias("n_spans"),
        F.coalesce("b.kept_sha256", "a.sha").alias("kept_sha256"),
    )
