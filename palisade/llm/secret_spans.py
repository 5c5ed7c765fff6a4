"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits and ``_ + / -``. Each is tagged B (a secret begins), I (goes on) or O, by

* its shape: length, kinds of characters, share of digits, hexadecimal digits only, the prefix ``AKIA``;
* its neighbours: shapes of the tokens on both sides, what separates it from the one before, and whether one
  of the two tokens before it is a word that announces secrets;
* its file: the text's length, its share of digits, whether it has announcing words at all.

The field is trained by its likelihood on windows around the patterns' own finds in a bounded sample of
documents (about ``SAMPLE_ROWS`` rows, drawn by a hash of doc_id; ``WINDOW`` tokens to each side) and on windows
elsewhere in every eighth of them. Decoding is Viterbi's, exact: where tag O beats the others by more than all transitions
could make good, the best path passes O, and the stretches between such tokens are decoded by themselves.

The patterns' spans always stay; the field adds spans (kind ``field``) that touch none of them. Spans count code
points, ends exclusive, and never cross texts. NULL and empty texts have no spans. Repeated rows are
scanned alike. An empty table gives an empty result; without any find in the sample the field adds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import steps, whole_texts

SAMPLE_ROWS = 20_000
WINDOW = 8
KINDS = ("assign", "access", "hex", "field")

# The patterns and the least lengths of what they find.
ASSIGN = rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ with at least 24 characters
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
ANNOUNCING = rb"(?i)password|passwd|passphrase|pwd|secret|token|api_?key|credential|bearer|auth"

_ASSIGN, _ACCESS, _HEX, _ANNOUNCING = map(re.compile, (ASSIGN, ACCESS, HEX, ANNOUNCING))


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns' finds, in bytes."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(data)]
    return sorted(found)


# ── tokens and their features ──────────────────────────────────────

_WORD, _LOWER, _UPPER, _DIGIT, _HEXDIGIT, _SIGN, _HIGH = (1 << k for k in range(7))


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for c in range(256):
        ch = chr(c)
        table[c] |= _LOWER * ("a" <= ch <= "z") | _UPPER * ("A" <= ch <= "Z") | _DIGIT * ("0" <= ch <= "9")
        table[c] |= _HEXDIGIT * (ch in "0123456789abcdef") | _SIGN * (ch in "_+/-") | _HIGH * (c >= 128)
        table[c] |= _WORD * (table[c] > 0)
    return table


_CLASS = _classes()
_LENGTHS = np.array([0, 3, 5, 7, 10, 14, 18, 20, 24, 32, 40, 64])

#: Sizes of the features, in the order of ``_features``.
SIZES = (len(_LENGTHS) + 1, 32, 6, 2, 2, 32, 32, 5, 3, 4, 4, 2)


@dataclass
class Tokens:
    """Tokens of a step's texts, joined by NULs: their bytes' bounds, their text, and a row of features each."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    features: np.ndarray


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(np.int32(0), np.cumsum(mask, dtype=np.int32))
    return total[ends] - total[starts]


def tokens(joined: bytes, bounds: np.ndarray) -> Tokens:
    """``bounds``: where each text starts in ``joined``; each ends before the NUL before the next one."""
    data = np.frombuffer(joined, np.uint8)
    kind = _CLASS[data]
    word = np.concatenate([[0], (kind & _WORD).astype(np.int8), [0]])
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    text = np.searchsorted(bounds, starts, "right") - 1
    length = ends - starts
    lower, upper, digit, hexa, sign, high = (_sums((kind & c) > 0, starts, ends) for c in (_LOWER, _UPPER, _DIGIT, _HEXDIGIT, _SIGN, _HIGH))
    size = np.searchsorted(_LENGTHS, length, "left")
    shape = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (sign > 0) + 16 * (high > 0)
    share = np.where(digit == 0, 0, np.where(digit == length, 5, 1 + np.minimum(3, 4 * digit // np.maximum(length, 1))))
    only_hex = (hexa == length) & (length >= 16)
    padded = np.append(data, np.zeros(4, np.uint8))
    key = np.all([padded[starts + k] == c for k, c in enumerate(b"AKIA")], axis=0) & (length >= 8)
    n = len(starts)
    first = np.ones(n, bool)
    first[1:] = text[1:] != text[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], after[:-1] = shape[:-1], shape[1:]
    before[first], after[last] = 0, 0
    gap_from = np.append(0, ends[:-1])[:n]
    assign = _sums((data == 61) | (data == 58), gap_from, starts) > 0
    quote = _sums((data == 34) | (data == 39), gap_from, starts) > 0
    gap = np.where(first, 4, assign + 2 * quote)
    announced = np.zeros(n + 2, np.int64)
    found = np.array([m.start() for m in _ANNOUNCING.finditer(joined)], np.int64)
    at = np.searchsorted(starts, found, "right") - 1
    announced[at[at >= 0]] = 1
    words = announced[:n]
    near = np.zeros(n, np.int64)
    near[2:][words[:-2] > 0] = 1
    near[1:][words[:-1] > 0] = 2
    near[first] = 0
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    near[second & (near == 1)] = 0
    sizes = np.diff(np.append(bounds, len(joined) + 1)) - 1
    of_size = np.searchsorted([200, 2000, 20000], sizes, "right")
    digits = np.bincount(text, weights=digit, minlength=len(bounds))
    of_digits = np.searchsorted([0.001, 0.02, 0.1], digits / np.maximum(sizes, 1), "right")
    has = np.bincount(text, weights=words, minlength=len(bounds)) > 0
    columns = (size, shape, share, only_hex, key, before, after, gap, near, of_size[text], of_digits[text], has[text])
    return Tokens(starts, ends, text, np.stack([c.astype(np.uint8) for c in columns], 1) if n else np.zeros((0, len(SIZES)), np.uint8))


# ── the field ──────────────────────────────────────────────────────

O, B, I = range(3)
_OFFSETS = np.append(0, np.cumsum(SIZES)[:-1])


@dataclass
class Field:
    weights: np.ndarray  # of each feature value, for each tag
    moves: np.ndarray  # of a tag after another one

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for k, offset in enumerate(_OFFSETS):
            out += self.weights[offset : offset + SIZES[k]][features[:, k]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(features: np.ndarray, tags: np.ndarray, rounds: int = 100, rate: float = 0.3, shrink: float = 1e-3) -> Field:
    """Gradient ascent on the log-likelihood of windows (n, length, features) with their tags, -1 beyond a text's end."""
    field = Field(np.zeros((sum(SIZES), 3)), np.zeros((3, 3)))
    field.moves[O, I] = -2.0
    if not len(features):
        return field
    n, length, _ = features.shape
    there = tags >= 0
    gold = np.zeros((n, length, 3))
    gold[np.nonzero(there) + (tags[there],)] = 1
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    flat = features.astype(np.int64) + _OFFSETS
    squares = [np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)]
    for _ in range(rounds):
        score = np.where(there[..., None], field.scores(features.reshape(n * length, -1)).reshape(n, length, 3), 0.0)
        ahead, back = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            moved = _log_sum(ahead[:, t - 1, :, None] + field.moves, 1) + score[:, t]
            ahead[:, t] = np.where(there[:, t, None], moved, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            moved = _log_sum(field.moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(there[:, t + 1, None], moved, 0.0)
        whole = _log_sum(ahead[:, -1], 1)
        tag = np.exp(ahead + back - whole[:, None, None]) * there[..., None]
        pair = ahead[:, :-1, :, None] + field.moves + (score[:, 1:] + back[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        moves = np.where(there[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0).sum((0, 1))
        miss = (gold - tag).reshape(n * length, 3)
        slope = np.zeros_like(field.weights)
        for k in range(len(SIZES)):
            for t in range(3):
                slope[:, t] += np.bincount(flat[..., k].ravel(), weights=miss[:, t], minlength=len(slope))
        for value, change, square in ((field.weights, slope, squares[0]), (field.moves, gold_moves - moves, squares[1])):
            change = change / n - shrink * value
            square += change**2
            value += rate * change / np.sqrt(square)
    return field


def viterbi(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of stretches (n, length, 3) that stand between tokens tagged O."""
    n, length, _ = score.shape
    best = score[:, 0] + moves[O]
    came = np.zeros((n, length, 3), np.int8)
    for t in range(1, length):
        both = best[:, :, None] + moves
        came[:, t] = both.argmax(1)
        best = both.max(1) + score[:, t]
    tags = np.zeros((n, length), np.int8)
    tags[:, -1] = (best + moves[:, O]).argmax(1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
    return tags


def decode(field: Field, features: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Best tags of all tokens; each text begins and ends as if beside a token tagged O."""
    score = field.scores(features)
    moves = field.moves
    gain = (moves[:, :, None] + moves[None, :, :]).max() - (moves[:, O, None] + moves[None, O, :]).min()
    tags = np.zeros(len(score), np.int8)
    open_ = np.flatnonzero(score[:, O] - score[:, 1:].max(1) <= gain)
    if not len(open_):
        return tags
    cut = np.flatnonzero((np.diff(open_) != 1) | (text[open_[1:]] != text[open_[:-1]])) + 1
    at = open_[np.append(0, cut)]
    length = np.diff(np.append(np.append(0, cut), len(open_)))
    for size in np.unique(length):
        first = at[length == size]
        rows = max(1, (1 << 18) // int(size))
        for k in range(0, len(first), rows):
            cells = first[k : k + rows, None] + np.arange(size)
            tags[cells] = viterbi(score[cells], moves)
    return tags


def tag_bases(found: Tokens, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Tags by the patterns' finds: the token a secret starts in is B, further ones in it I."""
    tags = np.zeros(len(found.starts), np.int8)
    for _, _, end, secret in reversed(spans):
        lo, hi = np.searchsorted(found.ends, secret, "right"), np.searchsorted(found.starts, end, "left")
        if lo < hi:
            tags[lo], tags[lo + 1 : hi] = B, I
    return tags


# ── on Spark ───────────────────────────────────────────────────────


def _joined(part: pa.RecordBatch) -> tuple[bytes, np.ndarray]:
    texts = part.column("text").cast(pa.binary()).to_pylist()
    bounds = np.append(0, np.cumsum([len(x) + 1 for x in texts]))[:-1]
    return b"\0".join(texts), bounds


def _find_windows(batches):
    """Windows around the finds; only texts with a find are cut into tokens."""
    return _windows(batches, finds_only=True)


def _windows(batches, finds_only: bool = False):
    """Windows of features and tags around the finds of each text, and one elsewhere in an eighth of the texts."""
    wide = 2 * WINDOW + 1
    for part in steps(batches):
        joined, bounds = _joined(part)
        if finds_only:
            having = np.unique(np.searchsorted(bounds, [a for a, *_ in base_spans(joined)], "right") - 1)
            if not len(having):
                continue
            part = part.take(pa.array(having))
            joined, bounds = _joined(part)
        found = tokens(joined, bounds)
        tags = tag_bases(found, base_spans(joined))
        ids = part.column("doc_id").to_pylist()
        n = np.bincount(found.text, minlength=len(ids))
        begin = np.cumsum(n) - n
        elsewhere = (begin + n * 7 // 11)[(n > 0) & (n % 8 == 1)]
        centres = np.unique(np.concatenate([np.flatnonzero(tags == B), elsewhere[:0] if finds_only else elsewhere]))
        cells = centres[:, None] + np.arange(-WINDOW, WINDOW + 1)
        if not len(centres):
            continue
        inside = (cells >= 0) & (cells < len(tags))
        cells = np.clip(cells, 0, max(0, len(tags) - 1))
        inside &= found.text[cells] == found.text[centres][:, None]
        # within the text, a window's tokens come first and its padding last
        order = np.argsort(~inside, axis=1, kind="stable")
        cells, inside = np.take_along_axis(cells, order, 1), np.take_along_axis(inside, order, 1)
        seen = np.where(inside, tags[cells], -1).astype(np.int8)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[k] for k in found.text[centres]], pa.int64()),
                pa.array(centres - begin[found.text[centres]]),
                pa.array([x.tobytes() for x in found.features[cells]], pa.binary()),
                pa.array([x.tobytes() for x in seen], pa.binary()),
            ],
            ["doc_id", "at", "features", "tags"],
        )
        assert cells.shape[1] == wide


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """The field, from windows of about ``rows`` documents, and around finds of all the others; the driver gets those
    windows only, at most ``4 * rows``, an eighth of ``rows`` of them (one at least) from the others."""
    texts = whole_texts(docs)
    share = min(1 << 20, (rows << 20) // max(1, texts.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share
    more = max(1, rows // 8)

    def least(part: DataFrame, windows, limit: int) -> pa.Table:
        found = part.mapInArrow(windows, "doc_id long, at long, features binary, tags binary")
        return found.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at", "features").limit(limit).toArrow()

    got = least(texts.where(drawn), _windows, 4 * rows - more)
    if share < 1 << 20:
        got = pa.concat_tables([got, least(texts.where(~drawn), _find_windows, more)])
    wide = 2 * WINDOW + 1
    features = np.frombuffer(b"".join(got.column("features").to_pylist()), np.uint8).reshape(-1, wide, len(SIZES))
    tags = np.frombuffer(b"".join(got.column("tags").to_pylist()), np.int8).reshape(-1, wide)
    if not (tags == B).any():
        return train(features[:0], tags[:0])
    return train(features, tags)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans (array of kind, start, end; by start, then kind) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    trained = bool(field.weights.any())

    def task(batches):
        for part in steps(batches):
            joined, bounds = _joined(part)
            spans = [(a, kind, b) for a, kind, b, _ in base_spans(joined)]
            if trained:
                found = tokens(joined, bounds)
                tags = decode(shared.value, found.features, found.text)
                taken = np.zeros(len(joined) + 1, np.int32)
                for a, _, b in spans:
                    taken[a] += 1
                    taken[b] -= 1
                taken = np.append(0, np.cumsum(np.cumsum(taken) > 0))
                begin = np.flatnonzero(tags == B)
                for k in begin.tolist():
                    last = k
                    while last + 1 < len(tags) and tags[last + 1] == I and found.text[last + 1] == found.text[k]:
                        last += 1
                    a, b = int(found.starts[k]), int(found.ends[last])
                    if taken[a] == taken[b]:
                        spans.append((a, 3, b))
            points = np.append(0, np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
            out: list[list] = [[] for _ in range(part.num_rows)]
            for a, kind, b in sorted(spans):
                text = int(np.searchsorted(bounds, a, "right")) - 1
                zero = points[bounds[text]]
                out[text].append({"kind": KINDS[kind], "start": int(points[a] - zero), "end": int(points[b] - zero)})
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return whole_texts(docs).mapInArrow(task, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def find_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs))
