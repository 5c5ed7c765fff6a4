"""Locally consistent parsing: local consistency, neighbours, edited texts."""

import hashlib
import random

import awkward
import numpy as np

from palisade.llm import fingerprints as lcp


def names(text: bytes, levels: int) -> list[int]:
    found, starts = np.frombuffer(text, np.uint8), np.array([0])
    for _ in range(levels):
        found, starts = lcp._phrases(found, starts)
    return found.tolist()


def test_equal_substrings_share_interior_names():
    random.seed(1)
    middle = bytes(random.choice(b"abcdefgh  .") for _ in range(3000))
    a, b = names(b"0123456789" + middle + b"tail", 3), names(b"other start" * 5 + middle + b"!" * 40, 3)
    shared = names(middle, 3)
    for found in (a, b):
        assert len(set(shared[5:-5]) - set(found)) == 0


def test_phrases_cover_and_stay_short():
    random.seed(2)
    for text in (bytes(random.choice(b"ab") for _ in range(2000)), b"a" * 500, b"ab" * 400, bytes(range(256)) * 3, b"x"):
        first, _ = lcp._phrases(np.frombuffer(text, np.uint8), np.array([0]))
        runs = 1 + sum(x != y for x, y in zip(text, text[1:], strict=False))
        assert runs / 14 <= len(first) <= runs / 2 + 1


def test_alone_and_together_alike():
    texts = [(t or "").encode() for t in awkward.texts()]
    together = lcp.fingerprints(texts)
    for k, text in enumerate(texts):
        assert (lcp.fingerprints([text])[0] == together[k]).all()


def test_likeness():
    random.seed(3)
    text = bytes(random.choice(b"abcdefghijk lmnop") for _ in range(6000))
    other = bytes(random.choice(b"abcdefghijk lmnop") for _ in range(6000))
    marks = lcp.fingerprints([text, other, text[:4000] + other[:2000], b"shift " + text, b"", b""])
    near = [float(lcp.likeness(marks[:1], marks[k : k + 1])[0]) for k in range(6)]
    assert near[0] == 1 and near[1] < 0.1 and 0.3 < near[2] < 0.7 and near[3] > 0.9 and near[4] == 0
    assert lcp.likeness(marks[4:5], marks[5:6])[0] == 1


def test_short_texts_share_what_they_have_in_common():
    """Two thirds of a text of twenty characters or more always leave a mark."""
    random.seed(4)
    words = "the of and to in is that for on with der die das und ist la le les de que el y en un señor".split()
    near = {}
    for size in (20, 30, 50, 100, 400):
        texts = [" ".join(random.choice(words) for _ in range(size))[:size] for _ in range(300)]
        new = [lcp.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
        one, other = (lcp.fingerprints([t.encode() for t in ts]) for ts in (texts, new))
        near[size] = lcp.likeness(one, other)
        assert near[size].min() > 0 and lcp.likeness(one[:-1], one[1:]).mean() < near[size].mean() / 2
    assert all(0.35 < n.mean() < 0.7 for n in near.values())


def order(row):
    return (row[0] is None, -(row[0] or 0))


def test_beside_next(spark):
    unique = {r[0]: r for r in awkward.rows() if r[0] != 7}
    rows = sorted(unique.values(), key=order)
    docs = spark.createDataFrame(rows, awkward.SCHEMA)
    got = {r.doc_id: r for r in lcp.beside_next(docs).collect()}
    assert len(got) == len(rows)
    for k, row in enumerate(rows):
        text, after = row[1] or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        r = got[row[0]]
        marks = lcp.fingerprints([text.encode(), new.encode(), after.encode()])
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == tuple(lcp._hex(marks)[:2])
        assert r.near_edited == lcp.likeness(marks[:1], marks[1:2])[0] and r.near_next == lcp.likeness(marks[:1], marks[2:])[0]


def test_repeated_rows_single_rows_and_empty_tables(spark):
    assert lcp.beside_next(awkward.frame(spark)).count() == len(awkward.rows())
    assert lcp.beside_next(awkward.empty(spark)).collect() == []
    one = lcp.beside_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(1, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    assert lcp.fingerprint_documents(awkward.frame(spark)).count() == len(awkward.rows())
