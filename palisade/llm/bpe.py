"""Byte-level BPE encoding and decoding.

Texts are cut by the splitting pattern; the pieces not met before go, by length, into padded numpy
matrices of token ids. In each round every row merges its leftmost pair of least rank, found through a
hashed pair table, and closes the gap; rows without a pair leave the matrix. Pieces longer than the widest
matrix merge by a heap of (rank, place), which does the same merges in the same order in n log n steps.

NULL and empty texts have no ids and decode to no bytes. Repeated rows, equal texts and any other columns
make no difference: each row is encoded by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import HashTable, ragged, steps, whole_texts

#: Widths of the matrices, in bytes of a piece; and cells of one matrix.
WIDTHS = (4, 8, 16, 32, 64, 128, 256, 512)
CELLS = 1 << 18
#: Distinct stretches of text whose ids a task remembers between steps.
REMEMBERED = 100_000

_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class Vocabulary:
    """The tokens, and the rank of the token that each pair of tokens makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        self.table = HashTable(np.fromiter(pairs.keys(), np.int64, len(pairs)))
        self.made = np.append(np.fromiter(pairs.values(), np.int32, len(pairs)), _NONE)
        by_id = sorted((rank, token) for token, rank in ranks.items())
        self.token_length = np.zeros(by_id[-1][0] + 1, np.int64)
        self.token_start = np.zeros(by_id[-1][0] + 1, np.int64)
        ids = np.array([rank for rank, _ in by_id])
        lengths = np.array([len(token) for _, token in by_id])
        self.token_length[ids], self.token_start[ids] = lengths, np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(token for _, token in by_id), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a pair of which one side is padding (-1) has none."""
        key = left.astype(np.int64) << 24 | right
        out = self.made[self.table.find(np.where((left < 0) | (right < 0), np.int64(1) << 60, key))]
        return out

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """The rows of a matrix padded with -1 on the right, all merges done."""
        done = np.full_like(ids, -1)
        row = np.arange(len(ids))
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            best = rank.argmin(1)
            least = rank[np.arange(len(row)), best]
            on = least != _NONE
            if not on.all():
                done[row[~on], : ids.shape[1]] = ids[~on]
                row, ids, rank, best, least = row[on], ids[on], rank[on], best[on], least[on]
                if not len(row):
                    break
            at, wide = np.arange(len(row)), ids.shape[1]
            ids[at, best] = least
            if wide > 2:
                cells = np.arange(1, wide - 1)
                np.copyto(ids[:, 1:-1], ids[:, 2:].copy(), where=cells > best[:, None])
                np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=cells - 1 >= best[:, None])
            ids[:, -1], rank[:, -1] = -1, _NONE  # every row is one shorter
            rank[at, best] = self.pair_ranks(least, np.where(best + 1 < wide, ids[at, np.minimum(best + 1, wide - 1)], -1))
            before = np.flatnonzero(best > 0)
            rank[before, best[before] - 1] = self.pair_ranks(ids[before, best[before] - 1], least[before])
            if wide > 2:
                ids, rank = ids[:, :-1], rank[:, :-1]
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap."""
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [*first.tolist(), int(_NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r != _NONE]
        heapq.heapify(heap)
        one = np.zeros(1, np.int32)

        def pair(i: int, j: int) -> int:
            return int(self.pair_ranks(one + ids[i], one + ids[j])[0]) if j < n else int(_NONE)

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], ids[j], rank[j] = r, -1, int(_NONE)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    rank[k] = pair(k, after[k])
                    if rank[k] != _NONE:
                        heapq.heappush(heap, (rank[k], k))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, and where those of each piece start and how many they are.

        A piece that is itself a token is that token.
        """
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start, length = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        tokens = np.flatnonzero(whole >= 0)
        start[tokens], length[tokens] = np.arange(len(tokens)), 1
        flat, used = [whole[tokens].astype(np.int32)], len(tokens)
        low = 1
        for width in WIDTHS:
            members = np.flatnonzero((whole < 0) & (size > low) & (size <= width))
            low = width
            for at in range(0, len(members), rows := CELLS // width):
                part = members[at : at + rows]
                matrix = np.full((len(part), width), -1, np.int32)
                matrix[np.arange(width) < size[part][:, None]] = self.bytes_to_id[np.frombuffer(b"".join([pieces[k] for k in part.tolist()]), np.uint8)]
                merged = self.merge_matrix(matrix)
                length[part] = (merged >= 0).sum(1)
                start[part] = used + np.cumsum(length[part]) - length[part]
                flat.append(merged[merged >= 0])
                used += len(flat[-1])
        for k in np.flatnonzero(size > WIDTHS[-1]).tolist():
            if whole[k] < 0:
                flat.append(self.merge_long(pieces[k]))
                start[k], length[k] = used, len(flat[-1])
                used += len(flat[-1])
        return np.concatenate(flat), start, length

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a run of ids, and the number of bytes of each."""
        length = self.token_length[ids]
        return self.token_bytes[ragged(self.token_start[ids], length)], length


#: All characters that any engine takes for white space.
_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_BEFORE_SPACE = [c + " " for c in _WHITE]


def cut(text: str, findall) -> list[str]:
    """Stretches of the text that the pattern splits alike alone and in place; none is empty.

    A match has white space at its start only, so one starts at each space that follows no white space.
    Where a space does follow white space (or the text has a NUL), the stretches are the matches themselves.
    """
    if "\0" in text or any(x in text for x in _BEFORE_SPACE):
        return findall(text)
    return text.replace(" ", "\0 ").removeprefix("\0").split("\0") if text else []


class _Memory:
    """Ids of the stretches met so far, as one flat array; forgotten when too many."""

    def __init__(self, vocabulary: Vocabulary, findall):
        self.vocabulary, self.findall = vocabulary, findall
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, stretches: list[str]) -> np.ndarray:
        """Where the ids of each stretch are, after learning the new ones."""
        place = np.fromiter(map(self.place.get, stretches, repeat(-1)), np.int64, len(stretches))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = list({stretches[k] for k in missing.tolist()})
            if len(self.place) + len(new) > REMEMBERED:
                self.clear()
                self._learn(list(set(stretches)))
                return np.fromiter(map(self.place.__getitem__, stretches), np.int64, len(stretches))
            self._learn(new)
            place[missing] = np.fromiter((self.place[stretches[k]] for k in missing.tolist()), np.int64, len(missing))
        return place

    def _split(self, stretches: list[str]) -> tuple[list[str], np.ndarray]:
        """All pieces one after the other, and how many each stretch has.

        Stretches joined by line ends are split at once; none of them is empty, has a line end, or a space at its end.
        """
        pieces = self.findall("\n".join(stretches))
        breaks = [k for k, p in enumerate(pieces) if p == "\n"]
        if len(breaks) != len(stretches) - 1:
            raise ValueError("the splitting pattern joins a line end between stretches with its neighbours")
        return [p for p in pieces if p != "\n"], np.diff([-1, *breaks, len(pieces)]) - 1

    def _learn(self, new: list[str]):
        plain = [x for x in new if x.isprintable() and not x.endswith(" ")]
        other = [x for x in new if not x.isprintable() or x.endswith(" ")]
        pieces, count = self._split(plain) if plain else ([], np.zeros(0, np.int64))
        more = [self.findall(x) for x in other]
        count = np.append(count, np.fromiter(map(len, more), np.int64, len(more)))
        flat, start, length = self.vocabulary.encode_pieces([p.encode() for p in chain(pieces, *more)])
        ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(count))]
        self.start = np.append(self.start, len(self.flat) + ends[:-1])
        self.length = np.append(self.length, np.diff(ends))
        self.flat = np.append(self.flat, flat[ragged(start, length)])
        self.place.update(zip(plain + other, range(len(self.place), len(self.place) + len(new)), strict=True))


_CODED, _BOTH = "doc_id long, ids array<int>", "doc_id long, ids array<int>, decoded binary"


def _encoding(shared, pattern: str):
    def task(batches):
        import regex

        findall = regex.compile(pattern).findall
        memory = _Memory(shared.value, findall)
        for part in steps(batches):
            stretches = [cut(text, findall) for text in part.column("text").to_pylist()]
            count = np.fromiter(map(len, stretches), np.int64, len(stretches))
            place = memory.places(list(chain.from_iterable(stretches)))
            length = memory.length[place]
            ids = memory.flat[ragged(memory.start[place], length)]
            ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(count))]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return task


def _decoding(shared):
    def task(batches):
        vocabulary = shared.value
        for batch in batches:
            at = 0
            bounds = batch.column("ids").offsets.to_numpy().astype(np.int64)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 19), "right")) - 1)
                part, at = batch.slice(at, to - at), to
                lists = part.column("ids")
                each = np.diff(lists.offsets.to_numpy().astype(np.int64))
                data, length = vocabulary.decode(lists.flatten().to_numpy())
                ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(each))]
                texts = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], ["doc_id", "ids", "decoded"])

    return task


def _shared(docs: DataFrame, ranks: dict[bytes, int]):
    """The vocabulary is broadcast; it does not grow with the data."""
    return docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return whole_texts(docs).mapInArrow(_encoding(_shared(docs, ranks), pattern), _CODED)


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for. NULL ids stand for no bytes."""
    whole = coded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return whole.mapInArrow(_decoding(_shared(coded, ranks)), _BOTH)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``decode`` of ``encode``, in one Python worker a task: ids go from one to the other without a way through the JVM."""
    shared = _shared(docs, ranks)
    encoding, decoding = _encoding(shared, pattern), _decoding(shared)
    return whole_texts(docs).mapInArrow(lambda batches: decoding(encoding(batches)), _BOTH)
