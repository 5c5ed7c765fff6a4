"""Budgets and prefixes of the mixture against a plain recursive account."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import awkward
import pytest
from pyspark.sql import functions as F

from palisade.llm import mixing

WEIGHTS = {"d0": 3, "en": 5, "d1/de": 4}


def water(budget, children):
    """Budget of each child (name, capacity, weight): full ones first, the rest by weight, whole tokens."""
    left, out = sorted(children, key=lambda c: (c[1] / c[2], c[0])), {}
    while left and left[0][1] * sum(c[2] for c in left) <= budget * left[0][2]:
        name, cap, _ = left.pop(0)
        out[name], budget = cap, budget - cap
    total, upto = sum(c[2] for c in left), 0
    for name, _, w in left:
        out[name] = budget * (upto + w) // total - budget * upto // total
        upto += w
    return out


def expected(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for k, (doc_id, domain, lang, source, tokens) in enumerate(rows):
        leaves[domain or "", lang or "", source or ""].append((k, doc_id, tokens))
    tokens = {leaf: sum(t for *_, t in members) for leaf, members in leaves.items()}

    def weight(path):
        return weights.get("/".join(path), weights.get(path[-1], 1))

    goal = min(sum(tokens.values()) * share.numerator // share.denominator, epochs * sum(tokens.values()))
    given = {(): goal}
    for level in range(3):
        below = {}
        for parent, budget in given.items():
            names = {leaf[: level + 1] for leaf in leaves if leaf[:level] == parent}
            caps = [(n, epochs * sum(v for leaf, v in tokens.items() if leaf[: level + 1] == n), weight(n)) for n in names]
            below |= water(budget, caps)
        given = below
    copies = {}
    for leaf, members in leaves.items():
        whole = given[leaf] // tokens[leaf] if tokens[leaf] else 0
        rest, running = given[leaf] - whole * tokens[leaf], 0
        order = lambda m: (hashlib.md5(f"{seed}:{whole}:{'' if m[1] is None else m[1]}".encode()).hexdigest(), m[2])  # noqa: B023, E731
        for k, _, t in sorted(members, key=order):
            running += t
            copies[k] = whole + (running <= rest)
    return given, copies


def table(n):
    return [(k, f"d{k % 3}", ["en", "de", None][k * k % 7 % 3], f"s{0 if k % 3 else k % 5}", k * 37 % 50) for k in range(n)]


@pytest.mark.parametrize("share, epochs", [(Fraction(1, 2), 2), (Fraction(3, 2), 2), (Fraction(9), 3), (Fraction(0), 1)])
def test_mixture(spark, share, epochs):
    rows = table(400)
    docs = spark.createDataFrame([(r[0], "x " * r[4], *r[1:4]) for r in rows], "doc_id long, text string, domain string, lang string, source string")
    got = mixing.mix(docs, F.col("domain"), WEIGHTS, share, epochs, 5).collect()
    given, copies = expected(rows, WEIGHTS, share, epochs, 5)
    assert {r.doc_id: r.copies for r in got} == copies
    total = sum(r[4] for r in rows)
    assert sum(given.values()) == min(total * share.numerator // share.denominator, epochs * total)
    taken = Counter()
    for r in got:
        taken[r.domain, r.lang, r.source] += r.copies * r.n_tokens
    assert all(v <= given[leaf] for leaf, v in taken.items())


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", "s", 100), ("a", "y", "s", 10), ("b", "x", "s", 1000)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(frame, {}, Fraction(100, 1110), 1).collect()}
    assert got == {("a", "x"): 40, ("a", "y"): 10, ("b", "x"): 50}


def test_awkward_rows_and_taken_rows(spark):
    docs = awkward.frame(spark)
    mixed = mixing.mix(docs, F.lit(None).cast("string"), {}, Fraction(3, 2), 2, 1)
    got = mixed.collect()
    rows = awkward.rows()
    assert len(got) == len(rows)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    assert sorted(r.n_tokens for r in got) == sorted(words)
    taken = mixing.taken_rows(docs, mixed)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in got)
    assert Counter(r.doc_id for r in taken.collect()) == Counter({k: n for k, n in _copies(got).items() if n})
    assert mixing.mix(awkward.empty(spark), F.lit("d")).collect() == []


def _copies(rows):
    out = Counter()
    for r in rows:
        out[r.doc_id] += r.copies
    return out
