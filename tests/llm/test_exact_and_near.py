"""Exact and near duplicates against brute force."""

import hashlib
import re
from collections import defaultdict

import awkward
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palisade.llm import components, exact, simhash


def expected_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id or 0, text, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(m[:3] for m in members)
        keep_id = None if keep[1] else keep[2]
        for m in members:
            out.append((m[4], keep_id, len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    hash_of = (lambda norm: F.crc32(norm) % 5) if weak else F.xxhash64
    got = exact.exact_duplicates(awkward.frame(spark), capacity=4, hash_of=hash_of).collect()
    assert by_text([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]) == by_text(expected_exact(awkward.rows()))
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_directory_doubles_and_covers():
    counts = np.zeros(1 << 6, np.int64)
    counts[5], counts[40:44] = 100, 7
    slots, local = exact.directory(counts, 10)
    assert len(slots) == 1 << max(local)
    for bucket, depth in enumerate(local):
        mine = np.flatnonzero(slots == bucket)
        assert len(mine) == len(slots) >> depth and (np.diff(mine) == 1).all()
        held = counts[mine[0] * 64 // len(slots) : (mine[-1] + 1) * 64 // len(slots)].sum()
        assert held <= 10 or depth == 6
    assert exact.directory(np.zeros(8, np.int64), 1)[1] == [0]


def test_keep_rows_once_each_with_all_columns(spark):
    docs = awkward.frame(spark)
    out = exact.keep_rows(docs, exact.exact_duplicates(docs).where("kept"))
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in awkward.rows()})


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, radius):
    """Smallest index reachable from each."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(marks))]


def test_near_duplicates(spark):
    rows = awkward.rows()
    got = simhash.near_duplicates(awkward.frame(spark)).collect()
    assert len(got) == len(rows)
    marks = [brute_fingerprint(t) for _, t, *_ in rows]
    groups = defaultdict(list)
    for k, root in enumerate(brute_groups(marks, 3)):
        groups[root].append(k)
    expected = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        expected += [(rows[k][0], f"{marks[k]:016x}", min(ids) if ids else None) for k in members]
    assert by_text([(r.doc_id, r.fingerprint, r.component_id) for r in got]) == by_text(expected)


def clustered(n):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, n // 8, dtype=np.int64)
    marks = centres[rng.integers(0, len(centres), n)]
    for _ in range(3):
        marks = marks ^ (np.int64(1) << rng.integers(0, 63, n))
    return np.unique(marks)


@pytest.mark.parametrize("tree", [4096, 5])
def test_links_connect_all_within_the_radius(spark, tree):
    marks = clustered(300)
    links = simhash.links(spark.createDataFrame([(int(m),) for m in marks], "fp long"), tree=tree)
    roots = {r.node: r.root for r in components.components(links).collect()}
    got = [roots.get(int(m), int(m)) for m in marks]
    groups = brute_groups([int(m) & (1 << 64) - 1 for m in marks], 3)
    assert len(set(groups)) < len(groups)
    assert len({*zip(got, groups, strict=True)}) == len(set(got)) == len(set(groups))


def test_tree_follows_edges_within_the_radius():
    marks = clustered(200).view(np.uint64)
    tree = simhash.Tree(marks)
    for node, children in tree.children.items():
        edges = [edge for edge, _ in children]
        assert len(edges) == len(set(edges)) and all(int(marks[node] ^ marks[c]).bit_count() == e for e, c in children)
    got = {(node, int(q)) for node, near in tree.within(marks, 6) for q in near}
    assert got == {(i, j) for i in range(len(marks)) for j in range(len(marks)) if int(marks[i] ^ marks[j]).bit_count() <= 6}


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)}


def test_empty_tables(spark):
    assert exact.exact_duplicates(awkward.empty(spark)).collect() == []
    assert simhash.near_duplicates(awkward.empty(spark)).collect() == []
