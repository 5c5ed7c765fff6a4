"""SimHash near-duplicates by BK-trees over shards of the distinct fingerprints.

A bit of a fingerprint is 1 if it is set in over half of the hashes (XXH64, seed 42) of the text's word
shingles, repeats included. Fingerprints within ``RADIUS`` bits link; a component of links is a group.

The 64 bits are cut into ``RADIUS + 2`` blocks. Two fingerprints within the radius agree on at least two whole
blocks, so each is a member of one shard for every pair of blocks, and no link is lost. A shard's members
form a BK-tree, children keyed by their Hamming distance to the parent; queries follow only the edges
within the radius of their own distance. Shards with over ``TREE`` members are dealt into trees of about
that many, and every tree is sent to a task for each part of the shard that asks it, so that no task holds
more than two parts. (Trees travel by shuffle: fingerprints of all documents may not pass the driver.)
A task emits a spanning forest of the links it finds, never all pairs; copies have met in one fingerprint before.

Fewer words than a shingle: the whole sequence is the one shingle. No words, as in NULL and empty texts:
fingerprint zero, linked like any other. Repeated rows are in one group. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.session import materialise

from .common import steps, text_key, whole_texts
from .components import components

SHINGLE = 3
RADIUS = 3
#: Members of a shard that form one tree.
TREE = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes of the fingerprint, highest bit first. Words end at [\\x20\\x09-\\x0D]; A-Z count as a-z."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return bytes(8)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        digests = b"".join([xxh64_digest(whole[a:b], 42) for a, b in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)])
        count += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * count > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key and fp (the fingerprint's bits as a signed long) of every whole text."""

    def task(batches):
        for part in steps(batches):
            marks = b"".join([fingerprint(x, shingle) for x in part.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(np.frombuffer(marks, ">i8").astype(np.int64))], ["doc_id", "text_key", "fp"]
            )

    return whole_texts(docs, text_key().alias("text_key")).mapInArrow(task, "doc_id long, text_key long, fp long")


class Tree:
    """A BK-tree over distinct fingerprints, built and asked for many at a time."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.children: dict[int, list[tuple[int, int]]] = {}  # of a node: distance and node
        todo = [np.arange(len(marks))]
        while todo:
            members = todo.pop()
            node, rest = int(members[0]), members[1:]
            distance = np.bitwise_count(marks[rest] ^ marks[node])
            order = np.argsort(distance, kind="stable")
            cuts = np.flatnonzero(np.diff(distance[order])) + 1
            for child in np.split(rest[order], cuts) if len(rest) else []:
                self.children.setdefault(node, []).append((int(np.bitwise_count(marks[child[0]] ^ marks[node])), int(child[0])))
                if len(child) > 1:
                    todo.append(child)

    def within(self, asked: np.ndarray, radius: int):
        """(node, places in ``asked`` within the radius) of every node that has any."""
        todo = [(0, np.arange(len(asked)))] if len(self.marks) else []
        while todo:
            node, asking = todo.pop()
            distance = np.bitwise_count(asked[asking] ^ self.marks[node]).astype(np.int16)
            near = asking[distance <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children.get(node, ()):
                on = asking[np.abs(distance - edge) <= radius]
                if len(on):
                    todo.append((child, on))


def forest(tree: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect whatever lies within the radius between the two sets."""
    every = np.unique(np.append(tree, asked))
    label = np.arange(len(every))
    of_tree, of_asked = np.searchsorted(every, tree), np.searchsorted(every, asked)
    for node, near in Tree(tree).within(asked, radius):
        met = np.unique(np.append(label[of_asked[near]], label[of_tree[node]]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _keys(radius: int) -> list:
    """A member's shard for every pair of blocks; no two pairs share a shard."""
    cuts = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    blocks = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    pairs = enumerate(combinations(range(radius + 2), 2))
    return [F.lit(k << 58) + blocks[i] * F.lit(1 << (cuts[j + 1] - cuts[j])) + blocks[j] for k, (i, j) in pairs]


def links(marks: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Links (a, b) that connect every two of the distinct fingerprints ``fp`` within the radius."""
    sharded = marks.select("fp", F.explode(F.array(*_keys(radius))).alias("key"))
    crowded = materialise(sharded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    members = sharded.join(crowded, "key")
    parts = F.ceil(F.col("n") / tree).cast("int")
    dealt = members.select("key", "fp", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("met"))
    units = dealt.select("key", F.least("own", "met").alias("one"), F.greatest("own", "met").alias("two"), "own", "fp")

    def task(batches):
        held = None

        def solve(unit: pa.RecordBatch):
            key = [unit.column(c).to_numpy() for c in ("key", "one", "two")]
            own, fp = unit.column("own").to_numpy(), unit.column("fp").to_numpy().view(np.uint64)
            new = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
            a, b = [], []
            for lo, hi in zip([0, *new], [*new, len(fp)], strict=True):
                if hi - lo > 1:
                    x, y = forest(fp[lo:hi][own[lo:hi] == key[1][lo]], fp[lo:hi][own[lo:hi] == key[2][lo]], radius)
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("key", "one", "two")]
            same = np.all([batch.column(c).to_numpy() == x for c, x in zip(("key", "one", "two"), last, strict=True)], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = batch.slice(cut)
            if cut:
                yield from solve(batch.slice(0, cut))
        if held is not None:
            yield from solve(held)

    dealt_out = units.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "own", "fp")
    return dealt_out.mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, fingerprint (hex), root (a fingerprint that names the group)
    and component_id, the smallest doc_id of the group."""
    marked = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), radius, tree))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(placed.join(groups, "root").select("fp", "root", "component_id"), "groups")
    return marked.join(named, "fp").select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")
