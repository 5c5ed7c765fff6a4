"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into longer phrases, ``LEVELS`` times. At each level
runs of one symbol become one symbol; deterministic coin tossing (the lowest bit in which a symbol differs from
the one before, and its value there, again and again) gives labels under 6, unlike their neighbours; phrases
start at local maxima of the labels. Where a phrase starts depends on a few neighbours only, so equal
substrings get equal phrases inside, wherever they stand. A phrase's name is a 64-bit hash of its symbols,
hence the same in every task without any shared dictionary.

The fingerprint holds a 16-bit mark (0: none) for each of 64 ranges of names, ``BINS`` of them for each level: that of the
range's least name, in hexadecimal. Most ranges are of the longest phrases, which tell texts apart; those of the shorter
ones let short texts, with a longest phrase or two, share what they have in common. Likeness is the share of equal
marks among the ranges in which either text has a name: an estimate of the texts' common share of phrases. Equal texts have
equal fingerprints.

NULL and empty texts have no phrases: a fingerprint of zeros, like another one to 1 and any other text to 0.
Neighbours go by descending doc_id, NULL ids last, repeated ids by text; after the last comes the first (a
single row is its own neighbour). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.session import materialise

from .common import steps, text_key, whole_texts

#: Ranges of the names of each level, from the shortest phrases to the longest.
BINS = (6, 14, 44)
LEVELS = len(BINS)

_RANDOM = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def _coin() -> np.ndarray:
    """Label of each (symbol before, symbol) of one byte."""
    before, now = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    differ = before ^ now
    place = np.bitwise_count((differ & -differ) - 1).astype(np.int64)
    return np.where(differ == 0, 0, 2 * place + ((now >> np.minimum(place, 8)) & 1)).astype(np.uint8).ravel()


_COIN = _coin()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text, and where each text starts among them. Texts are not empty."""
    n = len(names)
    first = np.zeros(n, bool)
    first[starts] = True
    new = np.ones(n, bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new |= first
    kept = np.flatnonzero(new)
    run = np.diff(np.append(kept, n))
    symbol, first = names[kept], first[kept]
    if symbol.dtype == np.uint8:
        label, hashed = symbol, _RANDOM[symbol]
    else:
        before = np.empty_like(symbol)
        before[1:] = symbol[:-1]
        before[first] = ~symbol[first]
        differ = symbol ^ before
        place = np.minimum(np.bitwise_count((differ & -differ) - np.uint64(1)), 63)
        label = (2 * place + ((symbol >> place) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
        hashed = symbol
    if (run > 1).any():
        hashed = hashed + (run - 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for _ in range(3):
        pair = np.empty(len(label), np.uint16)
        pair[1:] = label[:-1]
        pair[first] = label[first] ^ 1
        label = _COIN[(pair << 8) | label]
    begin = first.copy()
    begin[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, len(label)))
    place = np.arange(len(label)) - np.repeat(at, size)
    name = _mix(np.add.reduceat(hashed * _POWERS[place % 64], at) + size.astype(np.uint64))
    return name, np.flatnonzero(first[at])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of marks for each text."""
    marks = np.zeros((len(texts), sum(BINS)), np.uint16)
    full = np.flatnonzero([len(x) > 0 for x in texts])
    if len(full):
        names = np.frombuffer(b"".join(texts), np.uint8)
        starts = np.append(0, np.cumsum([len(texts[k]) for k in full])[:-1])
        for level, bins in enumerate(BINS):
            names, starts = _phrases(names, starts)
            text = np.repeat(full, np.diff(np.append(starts, len(names)))).astype(np.uint64)
            range_ = ((names >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
            place = text * np.uint64(sum(BINS)) + np.uint64(sum(BINS[:level])) + range_
            value = np.maximum((names >> np.uint64(20)) & np.uint64(0xFFFF), np.uint64(1))
            both = np.sort((place << np.uint64(16)) | value)
            least = np.append(True, (both[1:] >> np.uint64(16)) != (both[:-1] >> np.uint64(16)))
            marks.reshape(-1)[(both[least] >> np.uint64(16)).astype(np.int64)] = (both[least] & np.uint64(0xFFFF)).astype(np.uint16)
    return marks


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of marks, 0 to 1."""
    either = ((a > 0) | (b > 0)).sum(1)
    return np.where(either == 0, 1.0, ((a == b) & (a > 0)).sum(1) / np.maximum(either, 1))


def _hex(marks: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in marks]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text."""

    def task(batches):
        for part in steps(batches):
            marks = fingerprints(part.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_hex(marks))], ["doc_id", "fingerprint"])

    return whole_texts(docs).mapInArrow(task, "doc_id long, fingerprint string")


_FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the start of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _judged(ids: list, texts: list[str], following: list[str], marks: np.ndarray, next_marks: np.ndarray) -> list[pa.Array]:
    new = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    new_marks = fingerprints(new)
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
        pa.array(_hex(marks), pa.string()),
        pa.array(_hex(new_marks), pa.string()),
        pa.array(likeness(marks, new_marks)),
        pa.array(likeness(marks, next_marks)),
    ]


def _along(batches):
    """Rows of a sorted part, each judged beside the row after it; the first and last row also as they are."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None

    def ends(kind: str, doc_id, text: str) -> pa.RecordBatch:
        empty = [pa.nulls(1, pa.field("x", t).type) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([kind]), pa.array([text], pa.string()), pa.array([doc_id], pa.int64()), *empty],
            ["part", "kind", "text", *_NAMES],
        )

    for step in steps(batches):
        ids, texts = step.column("doc_id").to_pylist(), step.column("text").to_pylist()
        marks = fingerprints([x.encode() for x in texts])
        if held is None:
            yield ends("first", ids[0], texts[0])
        else:
            ids, texts, marks = [held[0], *ids], [held[1], *texts], np.vstack([held[2], marks])
        if len(ids) > 1:
            found = _judged(ids[:-1], texts[:-1], texts[1:], marks[:-1], marks[1:])
            n = len(ids) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(["row"] * n), pa.nulls(n, pa.string()), *found], ["part", "kind", "text", *_NAMES]
            )
        held = ids[-1], texts[-1], marks[-1:]
    if held is not None:
        yield ends("last", held[0], held[1])


def _pairs(batches):
    for batch in batches:
        ids, texts, following = (batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))
        marks, next_marks = (fingerprints([x.encode() for x in xs]) for xs in (texts, following))
        yield pa.RecordBatch.from_arrays(_judged(ids, texts, following, marks, next_marks), _NAMES)


def beside_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness; see the module for the order.

    Texts are sorted once by range of doc_id. Within a task each row meets the next one as they stream by; only
    the last row of each part meets the first of the next part by a join, as many rows as there are parts.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    descending = F.col("doc_id").desc_nulls_last()
    parts = whole_texts(docs, text_key().alias("text_key")).repartitionByRange(n, descending).sortWithinPartitions(descending, "text_key")
    seen = materialise(parts.mapInArrow(_along, f"part int, kind string, text string, {_FOUND}"), "neighbours")
    firsts = seen.where("kind = 'first'")
    in_order = Window.partitionBy(F.lit(0)).orderBy("part")  # one narrow row for each part
    least = F.min("part").over(Window.partitionBy(F.lit(0)))
    after = firsts.select("part", F.coalesce(F.lead("part").over(in_order), least).alias("after"))
    following = after.join(firsts.select(F.col("part").alias("after"), F.col("text").alias("following")), "after")
    lasts = seen.where("kind = 'last'").select("part", "doc_id", "text").join(following, "part").select("doc_id", "text", "following")
    return seen.where("kind = 'row'").select(*_NAMES).unionByName(lasts.mapInArrow(_pairs, _FOUND))
