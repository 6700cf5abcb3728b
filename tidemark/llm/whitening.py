"""Whitening of embeddings: leading principal components by a randomised range finder over all centred rows.

Entries become whole numbers, x = floor(256 * c), and the model is fitted to each distinct vector once, so copies weigh
nothing. Sums are exact. The range finder starts from ``components + OVERSAMPLE`` random directions; a power pass multiplies them by the
covariance, as a sum over rows of (x - mean)((x - mean)'Q), each task adding up its own rows and one row per cell
leaving it. Rayleigh-Ritz in the range gives components and their residuals. Passes go on while residuals
shrink fast enough to get below TOLERANCE within PASSES; where they don't (a flat spectrum, as of unstructured vectors), the range
is expanded to all dimensions by one more pass, and its components are those of the whole covariance. A last pass measures the covariance of
the whitened rows.

What the driver gets is of the size of the model (dimensions x directions), whatever the number of rows.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, as are empty ones and those of another
length than most distinct ones (of equally many, the longest). Entries outside of what a long holds take its bounds; a deviation that a
long can't hold is null. Components whose eigenvalue is 0 up to rounding can't be whitened and are left out: vectors that are all
equal give no rows, nor does an empty table. Repeated rows and rows without id each give their own rows. Ties between
eigenvalues leave the basis of their space open; it is the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, spread, written

COMPONENTS, OVERSAMPLE, PASSES = 4, 8, 10
#: Largest residual of a component, as a share of the largest eigenvalue: some units in the last place.
TOLERANCE = 64 * np.finfo(float).eps
SCALE, SEED = 256, 11


class Model(NamedTuple):
    """n distinct vectors with sums; axes (dimensions x components), their eigenvalues, the covariance's trace; whether all dimensions were needed."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    expanded: bool
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes / np.sqrt(self.values)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: usable vectors as whole numbers."""
    v = F.col("v")
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0) & ~odd)
    return own.select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE)).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An array column of lists of d longs as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(fit: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of part(rows), an array of one size, added up in tasks first and then on executors by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(matrix(b.column(0), d)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    cells = fit.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells.num_rows)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out


def exact_sums(fit: DataFrame, d: int) -> list[int]:
    """Sums by dimension, as integers of any size: of upper and lower halves of the longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], names=["dim", "hi", "lo"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, "dim long, hi long, lo long").groupBy("dim").agg(whole("hi"), whole("lo")).collect()
    return [(int(r["hi"]) << 32) + int(r["lo"]) for r in sorted(rows, key=lambda r: r["dim"])]


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes, eigenvalues by falling size, residual norms) of the covariance within the range of q."""
    t = q.T @ vq
    values, u = np.linalg.eigh((t + t.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    axes = q @ u
    return axes, values, np.linalg.norm(vq @ u - axes * values, axis=0)


def hopeless(before: float, now: float, left: int, bound: float) -> bool:
    """Whether residuals that went from before to now won't get below bound in the passes left."""
    rate = now / before if before else 1.0
    return rate >= 1 or now * rate**left > bound


def fit_model(fit: DataFrame, d: int, n: int, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Model:
    """The model of distinct vectors (x, of d entries)."""
    sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    k, size = min(components, d), min(d, components + oversample)

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        """(covariance times q, its trace)"""

        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.append(c.T @ (c @ q), np.einsum("ij,ij->", c, c))

        out = summed(fit, d, part) / n
        return out[:-1].reshape(d, -1), float(out[-1])

    q, before, done, trace = np.linalg.qr(np.random.default_rng([SEED, d]).standard_normal((d, size)))[0], 0.0, False, 0.0
    for i in range(passes if size < d else 0):
        vq, trace = product(q)
        axes, values, residuals = ritz(q, vq)
        now, bound = float(residuals[:k].max()), TOLERANCE * float(values[0])
        done = now <= bound
        if done or i and hopeless(before, now, passes - 1 - i, bound):
            break
        q, before = np.linalg.qr(vq)[0], now
    if not done:
        vq, trace = product(np.eye(d))
        axes, values, _ = ritz(np.eye(d), vq)
    real = values[:k] > d * np.finfo(float).eps * max(trace, 0.0)
    model = Model(n, sums, axes[:, :k][:, real], values[:k][real], trace, not done, 0.0)
    return model._replace(identity_error=identity_error(fit, d, model))


def identity_error(fit: DataFrame, d: int, model: Model) -> float:
    """The largest entry, by size, of the whitened rows' covariance less the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.append(w.T @ w, w.sum(0))

    out = summed(fit, d, part) / model.n
    mean = out[-k:]
    return float(np.abs(out[:-k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n x - sum)^2 for each row; None where a long can't hold it."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
    if most**2 * x.shape[1] < 1 << 63:
        c = n * x - np.array(sums, np.int64)
        return (c * c).sum(1).tolist()
    about = ((x.astype(float) * n - np.array([float(s) for s in sums])) ** 2).sum(1)
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) if a < 2.0**63 * 1.001 else None for row, a in zip(x.tolist(), about))
    return [None if e is None or e >= 1 << 63 else e for e in exact]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(x, each distinct vector of the commonest length once, as a written table; that length; their number)."""
    fit = written(rows.select("x").distinct())
    by = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (by["d"], by["n"]) if by else (0, 0)
    return fit.where(F.size("x") == d), d, n


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = quantised(spread(vectors.select(id_col, vector_col)), id_col, vector_col)
    with small_batches(vectors.sparkSession):
        fit, d, n = distinct_vectors(rows)
        if not n:
            return vectors.sparkSession.createDataFrame([], _OUT)
        model = fit_model(fit, d, n, components, oversample, passes)
        discard(fit)
    k, explained = len(model.values), model.values / model.trace if model.trace else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = matrix(b.column(1), d), b.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)),
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))], names=[c.split()[0] for c in _OUT.split(", ")])

    return rows.where(F.size("x") == d).mapInArrow(run, _OUT)
