"""Line dedup and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import awkward
import pytest
from pyspark.sql import functions as F

from palisade.llm import lines, queries, variants

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ── line dedup ──────────────────────────────────────────────────────


def brute_lines(rows, min_points, min_docs):
    held, last = defaultdict(set), {}
    split = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    for i, own in split:
        for line in own:
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_points:
                held[key].add(i)
    often = {k for k, ids in held.items() if len(ids) >= min_docs}
    last = {k: max(i for i in held[k] if i is not None) for k in often}
    out = Counter()
    for i, own in split:
        keys = [line.strip(SPACE).translate(LOWER) for line in own]
        kept = [line for line, k in zip(own, keys, strict=True) if k not in often or i == last[k]]
        out[i, len(own), len(own) - len(kept), "\n".join(kept)] += 1
    return out


def found_lines(df, *options):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(df, *options).collect())


def line_rows():
    rng = random.Random(2)
    shared = ["All of this line is shared by many documents, é 漢字", "x" * 40, "y" * 39, "Ünder forty points but é", "  the same line " + "again " * 6, "z" * 5000]
    frame = [s.upper() for s in shared] + [f"\t{s} \r" for s in shared] + ["", " ", "a line of its own"]
    rows = []
    for k in range(300):
        own = [rng.choice(shared + frame) if rng.random() < 0.7 else f"line {rng.random()} of document {k} " * 2 for _ in range(rng.randint(0, 12))]
        rows.append((None if k % 37 == 5 else k // 2 if k % 11 == 3 else k, "\n".join(own) if k % 29 else None))
    return rows + rows[:40]


@pytest.mark.parametrize("options", [(40, 5), (1, 2), (40, 120), (10**6, 2)])
def test_lines_against_brute_force(spark, options):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_lines(df, *options) == brute_lines(rows, *options)


def test_lines_of_awkward_rows(spark):
    assert found_lines(awkward.frame(spark), 20, 2) == brute_lines(awkward.rows(), 20, 2)
    assert found_lines(awkward.empty(spark)) == Counter()


def test_line_dedup_stays_in_the_jvm(spark):
    texts = lines.whole_texts(awkward.frame(spark), lines.text_key().alias("text_key"))
    for df in (lines.dedup_lines(awkward.frame(spark)), lines.exploded(texts, 40), lines.dropped_lines(texts)):
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


def test_line_dedup_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for (i, n, gone, t) in brute_lines(rows, 40, 5).elements())
    assert Counter(map(tuple, queries.QUERIES["op12_line_dedup"](spark, sf).collect())) == want


# ── spelling variants ───────────────────────────────────────────────


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows, shortest=7, least=2):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def brute_variants(n):
    less = defaultdict(set)
    for w in n:
        for s in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            less[s].add(w)
    beside = defaultdict(set)
    for group in less.values():
        for a in group:
            beside[a] |= {b for b in group if b != a and near(a, b)}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return out


def word_rows(seed=4):
    """Many words of few letters, some of them far more frequent than their neighbours."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aábé") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    words += ["aaaaaaab"[k:] + "aaaaaaab"[:k] for k in range(8)] + ["x" * 300, "x" * 299, "ÀÉÎõü×÷"]
    chains = ["commonword", "comonword", "comonwrd", "comonwrdx"]
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words) for _ in range(30))
        text += " " + " ".join(w for j, w in enumerate(chains) for _ in range([40, 3, 1, 1][j]) if j < 2 or k < [0, 0, 90, 4][j])
        rows.append((k, text.upper() if k % 7 == 0 else text.replace(" ", ",\n") if k % 3 else text))
    return rows + [(None, "nothing commonword"), (5, None), (5, ""), *rows[:9]]


def found_variants(df, *options):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(df, *options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("options", [(100_000, 200_000), (40, 7), (3, 5)])
def test_variants_against_brute_force(spark, options):
    """In one shard; in many, with salted visitors; and with nodes that stay crowded to the last level."""
    rows = word_rows()
    want = brute_variants(brute_words(rows))
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)
    assert found_variants(spark.createDataFrame(rows, "doc_id long, text string"), *options) == want


def test_letters_in_another_order_stay_crowded(spark):
    """Words of the same letters share a node on every level, so that one goes by strings without a code point."""
    rng = random.Random(1)
    words = {"".join(rng.sample("aaaabbbb", 8)) for _ in range(400)} | {"".join(rng.sample("aaaabbb", 7)) for _ in range(200)}
    rows = [(k, w) for k, w in enumerate(sorted(words))] * 2
    routed = variants.shards(variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string")), 10)
    assert routed.where("member").groupBy("node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= 20
    assert found_variants(spark.createDataFrame(rows, "doc_id long, text string"), 10, 10) == brute_variants(brute_words(rows))


def test_variants_of_awkward_rows(spark):
    assert found_variants(awkward.frame(spark), 5, 5) == brute_variants(brute_words(awkward.rows()))
    assert found_variants(awkward.empty(spark)) == set()


def test_variants_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_variants(brute_words(rows))
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.QUERIES["op13_spelling_variants"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_levels_tell_all_letters_apart_in_the_end():
    levels = variants.nested_cells(variants.BY_FREQUENCY, 99)
    assert len(levels) == 26 and all(len(own) >= 1 for _, own in levels[1:])
    assert variants.LEVELS == levels[: variants.DEPTH]
