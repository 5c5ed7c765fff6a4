"""Whitening of embeddings by Chebyshev-filtered subspace iteration over distributed passes.

Entries become integers, floor(256 * entry), and each distinct vector is kept once: the fit list, a written table of n
vectors. Only products of its covariance with a narrow block Q are ever formed: a pass over the list sums
(x - mean)' ((x - mean) Q) in the tasks, and Spark adds up the tasks' sums row by row; so at most dimension x ``BLOCK``
numbers come to the driver, however many vectors there are.

A filter is a Chebyshev polynomial of the covariance, by its three-term recurrence, a pass for each degree; it damps the
interval below the block's least Ritz value. Then QR and Rayleigh-Ritz. The leading pairs are certified when all of their
residuals |V u - e u| are under ``CERTIFIED`` of the greatest eigenvalue, or (if rounding stops them before) have ceased
to fall and are under ``ROUNDED`` of it. If neither comes within ``ROUNDS`` filters, that is an error, not a result.

Vectors that are NULL or hold a NULL or non-finite entry are left out, and so are those of another length than
most (ties: the longest). Repeated vectors and rows count once in the fit and come out as often as they went in; NULL ids
pass through. Components whose variance is under ``LEAST`` of the first one's are none; so a table without rows, or
with only one distinct vector, gives an empty result. Entries beyond 64 bits are cut to their bounds; a squared
deviation beyond them is NULL. Tied eigenvalues have any orthonormal vectors of their space.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.session import materialise

COMPONENTS = 4
BLOCK = 48
DEGREE = 6
ROUNDS = 200
CERTIFIED, ROUNDED, LEAST = 1e-14, 1e-10, 1e-12
_INT = 1 << 63


@dataclass(frozen=True)
class Fit:
    """``total``: exact sums of each dimension over the ``n`` vectors; ``vectors``: a column for each component."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(t, self.n)) for t in self.total])


def integral(table: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and x of the rows with whole vectors of the common length."""
    entries = F.col(vector).cast("array<double>")
    whole = F.forall("entries", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col(key).cast("long").alias("vec_id"), entries.alias("entries")).where(F.col("entries").isNotNull() & whole)
    size = rows.groupBy(F.size("entries").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.where(F.size("entries") == (size["size"] if size else 0))
    return rows.select("vec_id", F.transform("entries", lambda c: F.floor(c * 256)).alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = batch.column("x")
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _sums(batches):
    """(i, total, n): exact sums of each dimension."""
    total, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch)
        far = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        part = x.sum(axis=0) if far * len(x) < _INT else x.astype(object).sum(axis=0)
        total, n = part.astype(object) + (0 if total is None else total), n + len(x)
    if n:
        kinds = [pa.int32(), pa.decimal128(38, 0), pa.int64()]
        from decimal import Decimal

        rows = [range(len(total)), [Decimal(int(t)) for t in total], [n] * len(total)]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["i", "total", "n"])


def _product(mean: np.ndarray, block: np.ndarray):
    """(i, c0, c1, ..., own): rows of X'X Q for centred rows, and the squares of each dimension."""

    def task(batches):
        out = np.zeros((len(mean), block.shape[1] + 1))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch) - mean
                out[:, :-1] += x.T @ (x @ block)
                out[:, -1] += np.einsum("ij,ij->j", x, x)
        names = ["i", *[f"c{k}" for k in range(block.shape[1])], "own"]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean), dtype=np.int32)), *map(pa.array, out.T)], names)

    return task


def _added(rows: DataFrame) -> np.ndarray:
    sums = [F.sum(c).alias(c) for c in rows.columns[1:]]
    return np.array([r[1:] for r in sorted(rows.groupBy("i").agg(*sums).collect())])


def _gram(mean: np.ndarray, scaled: np.ndarray):
    """Rows of W'W for whitened rows W."""

    def task(batches):
        out = np.zeros((scaled.shape[1],) * 2)
        for batch in batches:
            if batch.num_rows:
                w = (_matrix(batch) - mean) @ scaled
                out += w.T @ w
        names = ["i", *[f"c{k}" for k in range(len(out))]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *map(pa.array, out.T)], names)

    return task


def _schema(columns: list[str]) -> str:
    return ", ".join(["i int", *[f"{c} double" for c in columns]])


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, and the norms of their residuals, of an orthonormal basis and its image."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, want: int, block: int = BLOCK, degree: int = DEGREE):
    """The ``want`` greatest eigenvalues and vectors of a positive semidefinite matrix known by its ``product`` with a block."""
    basis = np.linalg.qr(np.random.default_rng(20110).standard_normal((size, min(size, block))))[0]
    image = product(basis)
    values, vectors, off = _ritz(basis, image)
    low, best = 0.0, np.inf
    if basis.shape[1] < size:  # where the spectrum ends below, from the block and its image together
        more = image[:, : size - basis.shape[1]]
        far = product(more)
        both, scale = np.linalg.qr(np.hstack([basis, more]))
        firm = np.abs(np.diag(scale)) > 1e-8 * max(values[0], 1)
        if firm.all():
            ends, _, end_off = _ritz(both, np.linalg.solve(scale.T, np.hstack([image, far]).T).T)
            low = max(0.0, float(ends[-1] - end_off[-1]))
    for _ in range(ROUNDS):
        worst = off[:want].max(initial=0.0)
        if worst <= CERTIFIED * values[0] or (worst <= ROUNDED * values[0] and worst > best / 2):
            return values[:want], vectors[:, :want]
        if worst > best / 2:
            low = 0.0
        best = min(best, worst)
        high = values[-1]
        low = min(low, high / 2) if low >= high else low
        centre, reach = (high + low) / 2, (high - low) / 2
        if reach <= 0:  # nothing is known to be damped: a plain power step
            centre, reach = 0.0, max(values[0], np.finfo(float).tiny)
        sigma = first = reach / (values[0] - centre)
        before, now = vectors, (product(vectors) - centre * vectors) * (sigma / reach)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (product(now) - centre * now) * (2 * after / reach) - (sigma * after) * before
            sigma = after
        basis = np.linalg.qr(now)[0]
        values, vectors, off = _ritz(basis, product(basis))
    raise ArithmeticError(f"not certified after {ROUNDS} filters: residual {worst} at eigenvalue {values[0]}")


def fit(rows: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Fit:
    """Mean and leading components of the distinct vectors x of ``rows``."""
    listed = materialise(rows.select("x").distinct(), "fit")
    sums = listed.mapInArrow(_sums, "i int, total decimal(38,0), n long")
    found = sorted(sums.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())
    if not found:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    n, total = found[0]["n"], [int(r["total"]) for r in found]
    mean, trace = np.array([float(Fraction(t, n)) for t in total]), [0.0]

    def product(q: np.ndarray) -> np.ndarray:
        names = [f"c{k}" for k in range(q.shape[1])] + ["own"]
        out = _added(listed.mapInArrow(_product(mean, q), _schema(names))) / n
        trace[0] = float(out[:, -1].sum())
        return out[:, :-1]

    values, vectors = leading(product, len(mean), min(components, len(mean)), block)
    real = (values > 0) & (values > LEAST * values[0])
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return Fit(n, total, values, vectors, trace[0], 0.0)
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    scaled = vectors / np.sqrt(values)
    gram = _added(listed.mapInArrow(_gram(mean, scaled), _schema([f"c{k}" for k in range(len(values))]))) / n
    return Fit(n, total, values, vectors, trace[0], float(np.abs(gram - np.eye(len(values))).max()))


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(found: Fit):
    count, mean, scaled = len(found.values), found.mean, found.vectors / np.sqrt(found.values)
    explained, furthest = found.values / found.trace, max(map(abs, found.total))

    def deviations(x: np.ndarray) -> list:
        far = max(abs(int(x.max())), abs(int(x.min()))) * found.n + furthest
        if x.shape[1] * far * far < _INT:
            return ((found.n * x - np.array(found.total, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((found.n * x.astype(object) - np.array(found.total, object)) ** 2).sum(axis=1)
        return [int(d) if d < _INT else None for d in exact]

    def task(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * count, found.n)),
                pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), count))),
                pa.array(((x - mean) @ scaled).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * count, found.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _WHITE.split(", ")])

    return task


def whiten(table: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each remaining row and component: vec_id, component (from 1), n, deviation (sum of (n x - S)^2), whitened, explained
    (share of the variance) and identity_error (of the fit list's whitened covariance)."""
    rows = integral(table, vector, key)
    found = fit(rows, components)
    if not len(found.values):
        return table.sparkSession.createDataFrame([], _WHITE)
    return rows.mapInArrow(_whitened(found), _WHITE)
