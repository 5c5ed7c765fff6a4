"""Embedding whitening against numpy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, whitened string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "clash", "clash", "clash") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def expected(vectors):
    """(x of the rows that remain, fit list, eigenvalues, eigenvectors, trace)"""
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), float)
    v = np.cov(fit.T, bias=True).reshape(fit.shape[1], -1)
    values, turn = np.linalg.eigh(v)
    return np.array(x), fit, values[::-1], turn[:, ::-1], np.trace(v)


def check(df, vectors, count=4):
    x, fit, values, turn, trace = expected(vectors)
    n, total = len(fit), fit.sum(axis=0).astype(int)
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in range(len(x)) for c in range(1, count + 1)]
    white = np.array([r.whitened for r in rows]).reshape(len(x), count)
    want = (x - total / n) @ turn[:, :count] / np.sqrt(values[:count])
    sign = np.sign((white * want).sum(axis=0))
    assert np.allclose(white * sign, want, rtol=1e-8, atol=1e-9)
    for r in rows:
        exact = sum((n * int(c) - int(t)) ** 2 for c, t in zip(x[r.vec_id], total, strict=True))
        assert r.n == n and r.deviation == (exact if exact < 2**63 else None)
        assert abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-10 and 0 <= r.identity_error < 1e-9


def some(rows, size, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    return ((rng.standard_normal((rows, size)) * np.linspace(1.5, 0.5, size)) @ np.linalg.qr(rng.standard_normal((size, size)))[0] * scale).tolist()


@pytest.mark.parametrize("size", [4, 7, 60])
def test_against_numpy(spark, size):
    vectors = some(300, size)
    vectors += vectors[:50] * 3  # repeated vectors weigh once
    check(whitening.whiten(frame(spark, vectors)), vectors)


def test_rows_that_are_left_out(spark):
    good = some(60, 5)
    bad = [None, [1.0, None, 1.0, 1.0, 1.0], [math.nan] * 5, [1.0, 2.0, math.inf, 0.0, 0.0], [-math.inf] * 5, [], [1.0, 2.0], [1.0] * 6]
    df = frame(spark, good + bad)
    check(whitening.whiten(df), good)
    twice = whitening.whiten(df.union(df).union(frame(spark, [good[0]], [None])))
    assert twice.where("vec_id = 3").count() == 8 and twice.where("vec_id is null").count() == 4


def test_negative_zero_and_floor(spark):
    vectors = [[-0.0, 0.0039, -0.0039, 1.0], [0.0, -1.0, 0.5, 2.0], [0.25, 0.125, 0.5, -2.0]] + some(20, 4)
    check(whitening.whiten(frame(spark, vectors)), vectors)


@pytest.mark.parametrize("vectors, count", [([], 0), ([None, None], 0), ([[1.0, 2.0]] * 5, 0), ([[]] * 3, 0), ([[1.0], [2.0]], 1), ([[1.0, 1.0], [2.0, 2.0], [5.0, 5.0]], 1)])
def test_few_components(spark, vectors, count):
    out = whitening.whiten(frame(spark, vectors))
    assert out.columns == [c.split()[0] for c in whitening._WHITE.split(", ")]
    found = out.collect()
    assert {r.component for r in found} == set(range(1, count + 1)) and len(found) == count * len(vectors)
    assert all(r.identity_error < 1e-9 for r in found)


def test_entries_beyond_64_bits(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [0.0, 5.0], [1e12, 1.0]]
    found = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.vec_id for r in found} == {0, 1, 2, 3}
    assert all(r.deviation is None for r in found)
    big = [[1e4 * k, float(k * k)] for k in range(-20, 20)]
    check(whitening.whiten(frame(spark, big)), big, 2)


@pytest.mark.parametrize(
    "spectrum",
    [np.linspace(1, 1.5, 130), 1 / np.arange(1, 131) ** 2, np.r_[5.0, 4, 3, 2, np.full(126, 1.0)], np.r_[3.0, 2, np.zeros(128)], np.ones(130), np.zeros(130), np.r_[np.full(8, 7.0), np.linspace(1, 2, 122)]],
)
def test_iteration_alone(spectrum):
    """Flat, falling, tied and empty spectra wider than the block, by products only."""
    turn = np.linalg.qr(np.random.default_rng(9).standard_normal((130, 130)))[0]
    matrix = (turn * spectrum) @ turn.T
    passes = []
    values, vectors = whitening.leading(lambda q: passes.append(1) or matrix @ q, 130, 4, block=24)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], atol=1e-12 * max(spectrum))
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert np.linalg.norm(matrix @ vectors - vectors * values) <= 1e-9 * max(spectrum)


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    found = queries.QUERIES["op11_embedding_whitening"](spark, sf)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    order = {r.vec_id: k for k, r in enumerate(rows)}
    found = found.withColumn("vec_id", F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("vec_id")].cast("long"))
    check(found, [r.embedding for r in rows])
