"""Running mean and deviation of whole vectors: moments that merge, scanned over the blocks of a stream.

The moments of a stretch of rows are, by dimension, the number of values, their mean and the sum of squared distances from it.
Two stretches merge by the distance of their means, so nothing is subtracted that is large where the result is
small; a mean is kept as an unevaluated sum of two doubles, so values far from zero that drift keep their digits. A
block's moments are one row. They are carried over the blocks as a tree (nodes of PARTS blocks), then every row gets
the merge of those before its block and of the rows before it inside, all rows of a block at once: stretches of one, two,
four ... rows. Vectors are never taken apart into rows.

Entries that are null or not finite count for nothing. Vectors may differ in length; missing dimensions count for nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import PARTS, dealt, many

#: Rows of a block, which is what one task holds at a time.
BLOCK = 1 << 12


class Moments(NamedTuple):
    """Of one or more stretches (rows): counts, means (high and low part) and squared distances, by dimension (columns)."""

    n: np.ndarray
    high: np.ndarray
    low: np.ndarray
    m2: np.ndarray

    def take(self, at: slice | np.ndarray) -> Moments:
        return Moments(*(a[at] for a in self))

    def padded(self, d: int) -> Moments:
        return Moments(*(np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in self))

    @property
    def mean(self) -> np.ndarray:
        """NaN where there are no values."""
        return np.where(self.n > 0, self.high + self.low, np.nan)

    @property
    def var(self) -> np.ndarray:
        return np.divide(self.m2, self.n, out=np.full(self.n.shape, np.nan), where=self.n > 0)


def none(rows: int, d: int) -> Moments:
    return Moments(*np.zeros((4, rows, d)))


def single(x: np.ndarray) -> Moments:
    """Each row of x as a stretch of its own."""
    there = np.isfinite(x)
    return Moments(there.astype(float), np.where(there, x, 0.0), np.zeros(x.shape), np.zeros(x.shape))


def merge(a: Moments, b: Moments) -> Moments:
    """The moments of a and b together."""
    n = a.n + b.n
    gap = (b.high - a.high) + (b.low - a.low)
    step = gap * np.divide(b.n, n, out=np.zeros(n.shape), where=n > 0)
    low = a.low + step
    high = a.high + low
    back = high - a.high
    low = (a.high - (high - back)) + (low - back)
    only = a.n == 0
    return Moments(n, np.where(only, b.high, high), np.where(only, b.low, low), np.where(only, b.m2, a.m2 + b.m2 + gap * step * a.n))


def running(m: Moments) -> Moments:
    """Row i: the merge of rows 0 .. i, by stretches that double."""
    k = 1
    while k < len(m.n):
        both = merge(m.take(slice(None, -k)), m.take(slice(k, None)))
        m = Moments(*(np.concatenate([own[:k], new]) for own, new in zip(m, both)))
        k *= 2
    return m


def earlier(first: Moments, m: Moments) -> Moments:
    """Row i: the merge of first (one row) and rows 0 .. i - 1 of m."""
    inside = running(m)
    shifted = Moments(*(np.concatenate([np.zeros((1, a.shape[1])), a[:-1]]) for a in inside))
    return merge(first, shifted)


_STATE = "rows long, n array<double>, high array<double>, low array<double>, m2 array<double>"
_ARROW = [("rows", pa.int64()), *((k, pa.list_(pa.float64())) for k in Moments._fields)]


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of doubles as rows, NaN where an entry is null or a list is shorter than the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    out = np.full((len(sizes), int(sizes.max(initial=0))), np.nan)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lists(x: np.ndarray, sizes: np.ndarray | None = None) -> pa.ListArray:
    """Rows as a column of lists, NaN as null, each cut to its own size."""
    keep = np.ones(x.shape, bool) if sizes is None else np.arange(x.shape[1])[None] < sizes[:, None]
    flat, ends = x[keep], np.cumsum(keep.sum(1))
    return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(flat, pa.float64(), mask=np.isnan(flat)))


def _states(t: pa.Table) -> tuple[np.ndarray, Moments]:
    return t["rows"].to_numpy(), Moments(*(np.nan_to_num(_rows(t[k])) for k in Moments._fields))


def _table(block: np.ndarray, rows: np.ndarray, m: Moments) -> pa.Table:
    return pa.table([pa.array(block, pa.int64()), pa.array(rows, pa.int64()), *map(_lists, m)], schema=pa.schema([("b", pa.int64()), *_ARROW]))


def _total(t: pa.Table) -> pa.Table:
    """A node's moments from its blocks'."""
    t = t.sort_by("b")
    rows, m = _states(t)
    return _table(t["p"].to_numpy()[:1], rows.sum(keepdims=True), running(m).take(slice(-1, None)))


def _roots(t: pa.Table) -> pa.Table:
    """What lies before each block of the only node."""
    return _children(t, t.slice(0, 0))


def _children(t: pa.Table, above: pa.Table) -> pa.Table:
    """What lies before each block of a node: before the node, and of the blocks before it."""
    t = t.sort_by("b")
    rows, m = _states(t)
    d = m.n.shape[1]
    start, first = 0, none(1, d)
    if above.num_rows:
        own, first = _states(above)
        start, d = int(own[0]), max(d, first.n.shape[1])
    return _table(t["b"].to_numpy(), start + np.append(0, np.cumsum(rows)[:-1]), earlier(first.padded(d), m.padded(d)))


def _before(each: DataFrame, levels: int) -> DataFrame:
    """b and the moments of all earlier blocks, of one row of moments a block."""
    own = each.withColumn("p", F.floor(F.col("b") / PARTS))
    if levels == 1:
        return own.groupBy("p").applyInArrow(_roots, "b long, " + _STATE)
    up = _before(own.groupBy("p").applyInArrow(_total, "b long, " + _STATE), levels - 1).withColumnRenamed("b", "p")
    return own.groupBy("p").cogroup(up.groupBy("p")).applyInArrow(_children, "b long, " + _STATE)


def _own(t: pa.Table) -> pa.Table:
    """A block's moments from its rows."""
    m = single(_rows(t["x"]))
    while len(m.n) > 1:
        odd = m.take(slice(len(m.n) // 2 * 2, None))
        m = merge(m.take(slice(0, len(m.n) // 2 * 2, 2)), m.take(slice(1, None, 2)))
        m = Moments(*(np.concatenate([a, b]) for a, b in zip(m, odd)))
    return _table(t["b"].to_numpy()[:1], np.array([t.num_rows]), m)


def _inside(t: pa.Table, before: pa.Table) -> pa.Table:
    """Each row of a block with the moments of all rows before it."""
    t = t.sort_by("idx")
    x, (rows, first) = _rows(t["x"]), _states(before)
    sizes = np.array([n or 0 for n in t["x"].combine_chunks().value_lengths().to_pylist()])
    d = max(x.shape[1], first.n.shape[1])
    m = earlier(first.padded(d), single(np.pad(x, ((0, 0), (0, d - x.shape[1])), constant_values=np.nan)))
    place = int(rows[0]) + np.arange(t.num_rows)
    return pa.table([t["idx"], pa.array(place), t["x"], *(_lists(a, sizes) for a in (m.mean, m.var))], schema=_INSIDE)


_INSIDE = pa.schema([("idx", pa.int64()), ("pos", pa.int64()), ("x", pa.list_(pa.float64())), ("mean", pa.list_(pa.float64())), ("var", pa.list_(pa.float64()))])


def prefix_moments(stream: DataFrame, size: int = BLOCK, deep: bool | None = None) -> DataFrame:
    """idx, pos, x, mean, var of a stream (idx, features): statistics of strictly earlier rows, by dimension (population variance; null before there are any), and their number."""
    rows = stream.select(F.col("idx").cast("long").alias("idx"), F.col("features").cast("array<double>").alias("x"))
    deep = many(stream.select("idx"), size) if deep is None else deep
    own = dealt(rows, "idx", size, stream.select("idx"), deep, "b").select("b", "idx", "x")
    carry = _before(own.groupBy("b").applyInArrow(_own, "b long, " + _STATE), 2 if deep else 1)
    return own.groupBy("b").cogroup(carry.groupBy("b")).applyInArrow(_inside, "idx long, pos long, x array<double>, mean array<double>, var array<double>")
