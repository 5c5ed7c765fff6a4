"""Induced sorting of all suffixes of a block of texts, carrying common-prefix lengths.

Symbols are 0 for the end of the block, 1 between texts, and bytes + 2. Suffixes that start a descent from the left
(LMS) are sorted first: their substrings by one induction from any order, then their names by doubling. One
more induction sorts all suffixes: a queue for each symbol receives, in order, the suffixes that stand before
those just scanned, as tuples of place and common prefix with the tuple before; the common prefix of two
neighbours in a queue is one more than the least on the way between the suffixes that sent them. Tuples beyond
``HELD`` bytes wait in a file among Spark's own spill files until their symbol's turn.
"""

from __future__ import annotations

import os
from tempfile import TemporaryFile

import numpy as np

from .common import ragged

SYMBOLS = 258
#: Bytes of waiting tuples that the queues of one induction keep in memory.
HELD = 4 << 20
_FAR = np.int32(1 << 30)


class _Queues:
    """Tuples (place, common prefix with the tuple before) waiting for each symbol, in order of arrival."""

    def __init__(self):
        self.waiting: list[list[tuple]] = [[] for _ in range(SYMBOLS)]  # arrays, or where in the file and how many
        self.held, self.file = 0, None

    def _put(self, symbol: int, places: np.ndarray, common: np.ndarray):
        size = places.nbytes + common.nbytes
        if self.held + size <= HELD:
            self.held += size
            self.waiting[symbol].append((places, common))
            return
        if self.file is None:
            self.file = TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        at = self.file.seek(0, 2)
        self.file.write(places.tobytes())
        self.file.write(common.tobytes())
        self.waiting[symbol].append((at, len(places)))

    def _got(self, chunk: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(chunk[0], np.ndarray):
            self.held -= chunk[0].nbytes + chunk[1].nbytes
            return chunk
        at, n = chunk
        self.file.seek(at)
        return np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(4 * n), np.int32)

    def send(self, text: np.ndarray, places: np.ndarray, common: np.ndarray, up: bool, symbol: int):
        """Sends what stands before ``places``, if its symbol is above (or else below) ``symbol``, to its queue."""
        before = places - 1
        of = text[before]  # place 0 looks at the end symbol, 0
        out = np.flatnonzero((of > symbol) if up else ((of < symbol) & (places > 0)))
        if not len(out):
            return
        order = out[np.argsort(of[out], kind="stable")]
        to = of[order]
        first = np.append(True, to[1:] != to[:-1])
        lcp = np.ones(len(order), np.int32)
        later = np.flatnonzero(~first)
        if len(later):
            span = np.empty(2 * len(later), np.int64)
            span[0::2], span[1::2] = order[later - 1] + 1, order[later] + 1
            lcp[later] += np.minimum.reduceat(np.append(common, _FAR), span)[0::2]
        starts = np.flatnonzero(first)
        for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
            self._put(to[lo], before[order[lo:hi]], lcp[lo:hi])

    def take(self, text: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """The queue of a symbol, followed by what stands before its tuples with the same symbol, and so on."""
        chunks = [self._got(c) for c in self.waiting[symbol]]
        self.waiting[symbol] = []
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        places, common = np.concatenate([c[0] for c in chunks]), np.concatenate([c[1] for c in chunks])
        all_places, all_common, run = [places], [common], 1
        while True:
            more = np.flatnonzero((text[places - 1] == symbol) & (places > 0))
            if not len(more):
                break
            lcp = np.full(len(more), run, np.int32)
            if len(more) > 1:
                span = np.empty(2 * len(more) - 2, np.int64)
                span[0::2], span[1::2] = more[:-1] + 1, more[1:] + 1
                lcp[1:] = 1 + np.minimum.reduceat(np.append(common, _FAR), span)[0::2]
            places, common, run = places[more] - 1, lcp, run + 1
            all_places.append(places)
            all_common.append(common)
        return np.concatenate(all_places), np.concatenate(all_common)


def _induce(text: np.ndarray, runs: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the common prefix of each with the one before, from the LMS suffixes in order."""
    of = text[seeds]
    cuts = np.searchsorted(of, np.arange(SYMBOLS + 1))
    queues, falling = _Queues(), []
    for symbol in range(SYMBOLS):
        places, common = queues.take(text, symbol)
        falling.append((places, common))
        own = seeds[cuts[symbol] : cuts[symbol + 1]]
        own_common = seed_common[cuts[symbol] : cuts[symbol + 1]].copy()
        if len(own):
            own_common[0] = min(runs[places[-1]], runs[own[0]]) if len(places) else 0
        if len(places) + len(own):
            queues.send(text, np.append(places, own), np.append(common, own_common), True, symbol)
    queues, rising = _Queues(), []
    for symbol in range(SYMBOLS - 1, -1, -1):
        places, common = queues.take(text, symbol)
        rising.append((places, common))
        down, down_common = falling[symbol]
        # from the greatest: rising suffixes as they came, then falling ones backwards
        turned = np.append(np.int32(0), down_common[:0:-1]) if len(down) else down_common
        if len(down) and len(places):
            turned[0] = min(runs[places[-1]], runs[down[-1]])
        if len(places) + len(down):
            queues.send(text, np.append(places, down[::-1]), np.append(common, turned), False, symbol)
    order, lcp = [], []
    for symbol in range(SYMBOLS):
        (down, down_common), (up, up_common) = falling[symbol], rising[SYMBOLS - 1 - symbol]
        if len(down):
            order.append(down)
            lcp.append(np.append(np.int32(0), down_common[1:]))
        if len(up):
            order.append(up[::-1])
            meet = min(runs[down[-1]], runs[up[-1]]) if len(down) else 0
            lcp.append(np.append(np.int32(meet), up_common[:0:-1]))
    return np.concatenate(order), np.concatenate(lcp)


def sorted_suffixes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order, common prefix with the suffix before, where each text starts).

    Order and common prefixes are right as far as ``depth`` symbols; of suffixes alike beyond, any may come first.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.int16) + 2
    text[starts + size] = 1
    text[-1] = 0
    n = len(text)
    # runs of one symbol: rising (S) if the symbol after the run is greater
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    length = np.diff(np.append(-1, ends))
    rises = np.append(text[ends[:-1] + 1] > text[ends[:-1]], True)
    runs = np.repeat(ends + 1, length).astype(np.int32) - np.arange(n, dtype=np.int32)
    heads = ends - length + 1
    lms = heads[1:][rises[1:] & ~rises[:-1]].astype(np.int32)
    if not len(lms):
        lms = np.array([n - 1], np.int32)
    del ends, length, rises, heads
    # 1. the substrings between LMS places, in order by induction, get names
    by_symbol = lms[np.argsort(text[lms], kind="stable")]
    order, _ = _induce(text, runs, by_symbol, np.zeros(len(lms), np.int32))
    number = np.full(n, -1, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    ranked = number[order]
    ranked = ranked[ranked >= 0]
    del order, number
    if len(ranked) < len(lms):  # the end symbol sends nothing and is sent by nothing
        ranked = np.append(len(lms) - 1, ranked)
    stretch = np.diff(np.append(lms, n - 1)) + 1
    alike = stretch[ranked[1:]] == stretch[ranked[:-1]]
    pairs = np.flatnonzero(alike)
    if len(pairs):
        each = stretch[ranked[pairs]]
        a, b = ragged(lms[ranked[pairs]], each), ragged(lms[ranked[pairs + 1]], each)
        alike[pairs] = np.logical_and.reduceat(text[a] == text[b], np.cumsum(each) - each)
    rank = np.empty(len(lms), np.int64)
    rank[ranked] = np.append(0, np.cumsum(~alike))
    # 2. the names are doubled until they tell all apart or reach beyond the depth
    levels, reach = [rank], 1
    while rank.max() + 1 < len(rank) and 2 * reach <= depth:
        key = (rank + 1) * (len(rank) + 2)
        key[:-reach] += rank[reach:] + 1
        _, rank = np.unique(key, return_inverse=True)
        levels.append(rank)
        reach *= 2
    sorted_lms = np.argsort(rank, kind="stable")
    a, b = sorted_lms[:-1], sorted_lms[1:]
    count = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + count, b + count
        same = (x < len(lms)) & (y < len(lms))
        same[same] = levels[k][x[same]] == levels[k][y[same]]
        count += same << k
    reached = np.append(lms, n - 1)
    common = (reached[np.minimum(a + count, len(lms))] - lms[a]).astype(np.int64)
    live = np.flatnonzero(common < depth)
    while len(live):
        x, y = lms[a[live]] + common[live], lms[b[live]] + common[live]
        on = (x < n) & (y < n)
        on[on] = text[x[on]] == text[y[on]]
        live = live[on]
        common[live] += 1
        live = live[common[live] < depth]
    # 3. all suffixes by induction from the sorted ones
    order, lcp = _induce(text, runs, lms[sorted_lms], np.append(0, common).astype(np.int32))
    return order, lcp, starts
