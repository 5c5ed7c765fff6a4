"""Repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import awkward
import numpy as np
import pytest

from palisade.llm import induced, repeats
from palisade.llm.induced import sorted_suffixes


def brute_suffixes(texts):
    symbols = [s for t in texts for s in (*(x + 2 for x in t), 1)] + [0]
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(symbols) and symbols[a + k] == symbols[b + k]:
            k += 1
        common.append(k)
    return order[1:], common[1:]  # without the end symbol


@pytest.mark.parametrize("held", [induced.HELD, 100, 0])
@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256)), b"\x00\xff"])
def test_induced_sorting(alphabet, held, monkeypatch):
    """Also with queues that wait on disk."""
    monkeypatch.setattr(induced, "HELD", held)
    random.seed(len(alphabet))
    for _ in range(60):
        texts = [bytes(random.choice(alphabet) for _ in range(random.choice([0, 1, 2, 5, 20, 60]))) for _ in range(random.randint(1, 5))]
        texts += texts[:2] * random.randint(0, 1)
        order, common, _ = sorted_suffixes(texts, 10**6)
        want, lcp = brute_suffixes(texts)
        assert order.tolist() == want
        assert common[1:].tolist() == lcp[1:]


def test_windows_alike_have_anchors_at_the_same_place():
    random.seed(5)
    data = np.frombuffer(bytes(random.choice(b"ab") for _ in range(3000)), np.uint8)
    anchors, hashes = repeats.window_anchors(data, 30, 6)
    place = {}
    for p, a in enumerate(anchors.tolist()):
        assert p <= a <= p + 24
        assert place.setdefault(data[p : p + 30].tobytes(), (a - p, hashes[a])) == (a - p, hashes[a])


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(hash(x[k : k + length]) for _, x in data for k in range(len(x) - length + 1))
    out = Counter()
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if count[hash(x[k : k + length])] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        out[i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages():
    random.seed(9)
    words = ["ab", "ba", "aab", "bab", "é", "cc", "x"]
    shared = ["".join(random.choice(words) for _ in range(60)) for _ in range(3)]
    for _ in range(60):
        parts = [
            random.choice([random.choice(shared), "".join(random.choice("abcdefghij") for _ in range(30)), "".join(random.choice(words) for _ in range(20))])
            for _ in range(random.randint(0, 4))
        ]
        yield "".join(parts)


@pytest.mark.parametrize("gram, crowd", [(8, 2000), (8, 3), (16, 1)])
def test_repeats_in_passages(spark, gram, crowd):
    rows = list(enumerate([*passages(), "a" * 200, "a" * 90, None]))
    got = repeats.removal_report(spark.createDataFrame(rows, "doc_id long, text string"), 40, gram, crowd).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 40)


def test_texts_of_several_steps(spark):
    """The registered lengths, texts that are cut into steps, and repeats across the cuts."""
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(900_000))
    cut = repeats.STEP
    spans = [(100, 700), (cut - 450, cut - 50), (cut - 399, cut + 1), (2 * cut - 300, 2 * cut + 900), (5000, 5399), (len(long) - 500, len(long))]
    rows = [(0, long), *[(k + 1, "new " + long[a:b] + f" and {k}") for k, (a, b) in enumerate(spans)], (50, None), (51, "x" * 1000)]
    want = brute(rows, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in repeats.removal_report(docs).collect()) == want
    assert Counter(tuple(r) for r in repeats.removal_report(docs, crowd=2).collect()) == want


def test_planted_passages_at_the_registered_length(spark):
    """Passages of over 50 words in three documents each: those of 400 bytes or more go, shorter ones and clean documents stay whole."""
    rng = random.Random(21)

    def prose(n, size):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(size)) for _ in range(n))

    planted = [prose(n, size) for n, size in [(51, 5), (52, 6), (60, 7), (120, 6)]]
    short, long = [{p for p in planted if (len(p.encode()) >= 400) == whole} for whole in (False, True)]
    assert len(short) == 2 and len(long) == 2
    rows, holds = [], {}
    for p in [*planted * 3, *[""] * 12]:
        holds[len(rows)] = p
        rows.append((len(rows), f"{prose(rng.randint(5, 200), 6)}\n{p}\n{prose(rng.randint(5, 200), 6)}"))
    got = repeats.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 400)
    for r in got:
        p = holds[r.doc_id]
        assert r.n_bytes == len(rows[r.doc_id][1].encode())  # of the whole text, whatever goes
        assert r.n_spans == (p in long) and (r.n_removed >= len(p.encode()) if p in long else r.n_removed == 0)


def test_texts_do_not_stay_in_the_catalog(spark):
    repeats.removal_report(spark.createDataFrame([(1, "x" * 1000)], "doc_id long, text string")).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts")]


def test_awkward_rows(spark):
    rows = [(i, t and t[:9000], *rest) for i, t, *rest in awkward.rows()]
    docs = spark.createDataFrame(rows, awkward.SCHEMA)
    got = repeats.removal_report(docs, 100, 8).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 100)
    assert repeats.removal_report(awkward.empty(spark)).collect() == []
