"""Nearest neighbours over the last rows of a stream, with features scaled by their running mean and deviation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import prefix_moments

NEIGHBOURS, WINDOW = 5, 1000
#: Rows of a tile, whose distances to another tile are one matrix product.
TILE = 256


def scaler(stream: DataFrame) -> DataFrame:
    """idx, dim, x, mean, var: statistics of strictly earlier rows (population variance; null before there are any), one row a dimension."""
    own = prefix_moments(stream).select("idx", F.posexplode(F.arrays_zip("x", "mean", "var")).alias("dim", "c"))
    return own.select("idx", "dim", "c.x", "c.mean", "c.var")


class Tiles:
    """The rows of two blocks in order, cut into tiles with a pivot (their mean) and a radius around it."""

    def __init__(self, z: np.ndarray, pos: np.ndarray) -> None:
        self.z, self.pos, self.square = z, pos, (z * z).sum(1)
        self.starts = np.arange(0, len(z), TILE)
        self.pivot = np.add.reduceat(z, self.starts) / np.diff(np.append(self.starts, len(z)))[:, None]
        self.radius = np.sqrt([((z[s : s + TILE] - p) ** 2).sum(1).max() for s, p in zip(self.starts, self.pivot)])

    def rows(self, tile: int) -> slice:
        return slice(self.starts[tile], min(self.starts[tile] + TILE, len(self.z)))

    def apart(self, tile: int) -> np.ndarray:
        """How far the nearest rows of a tile and of each tile are apart at least, by the triangle inequality."""
        between = np.sqrt(((self.pivot - self.pivot[tile]) ** 2).sum(1))
        return np.maximum(0, between - self.radius - self.radius[tile])

    def near(self, tile: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of the tile, earlier row) that hold the k nearest of each row among the window before it, with a few more.

        The k-th smallest product distance bounds what can be among the k nearest, with room for its rounding and for
        distances that are equal when they are rounded. Tiles go by their distance; those beyond every bound are never compared.
        """
        own = self.rows(tile)
        pos, square = self.pos[own], self.square[own]
        apart = self.apart(tile)
        slack = 1e-11 * (square + self.square.max())
        best = np.full((len(pos), k), np.inf)
        rows, others, squares = [], [], []
        bound = np.full(len(pos), np.inf)
        for t in sorted(range(tile + 1), key=lambda t: (apart[t], -t)):
            at = self.rows(t)
            if self.pos[at][-1] < pos[0] - window:
                continue
            if apart[t] ** 2 > bound.max():
                break
            d = square[:, None] + self.square[None, at] - 2 * (self.z[own] @ self.z[at].T)
            d[(self.pos[None, at] >= pos[:, None]) | (self.pos[None, at] < pos[:, None] - window)] = np.inf
            best = np.partition(np.hstack([best, d]), k - 1, axis=1)[:, :k]
            bound = (np.sqrt(np.maximum(best.max(1), 0) + slack) + 2e-6) ** 2 + slack
            i, j = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
            rows.append(i), others.append(j + at.start), squares.append(d[i, j])
        i, j, d = (np.concatenate(x) for x in (rows, others, squares))
        ok = d <= bound[i]
        return i[ok] + own.start, j[ok]


def nearest(z: np.ndarray, pos: np.ndarray, idx: np.ndarray, first: int, k: int, window: int) -> tuple[np.ndarray, ...]:
    """(idx, other, rank, distance) for the rows from first on, of rows sorted by place."""
    tiles = Tiles(z, pos)
    pairs = [tiles.near(t, k, window) for t in range(len(tiles.starts)) if tiles.rows(t).stop > first]
    i, j = (np.concatenate(x) for x in zip(*pairs))
    i, j = i[i >= first], j[i >= first]
    d = np.round(np.sqrt(((z[j] - z[i]) ** 2).sum(1)), 6)
    o = np.lexsort((-idx[j], d, i))
    i, j, d = i[o], j[o], d[o]
    turn = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    rank = np.arange(len(i)) - np.repeat(turn, np.diff(np.append(turn, len(i)))) + 1
    few = rank <= k
    return idx[i[few]], idx[j[few]], rank[few], d[few]


_SCALED = "idx long, pos long, z array<double>"


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, mean, var = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "mean", "var"))
        sd = np.sqrt(var)
        z = np.divide(x - mean, sd, out=np.zeros(len(x)), where=sd > 0)
        z[~np.isfinite(z)] = 0
        ends = np.cumsum([n or 0 for n in b.column("x").value_lengths().to_pylist()])
        yield pa.RecordBatch.from_arrays([b.column("idx"), b.column("pos"), pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(z))], names=["idx", "pos", "z"])


def standardised(stream: DataFrame) -> DataFrame:
    """idx, pos, z: each vector less the mean before it, over the deviation before it; 0 where there is none, or an entry is null or not finite."""
    return prefix_moments(stream).mapInArrow(_scaled, _SCALED)


def neighbours(stream: DataFrame, k: int = NEIGHBOURS, window: int = WINDOW) -> DataFrame:
    """idx, other, rank, distance of the k nearest among the ``window`` rows before each, the newer one on ties.

    The window counts rows, not values of idx, so gaps in idx don't shorten it. Rows meet by block: each goes to its own block of ``window`` rows and to the next, so every task holds two blocks at
    most whatever the stream's length. Each query is scaled with the statistics before it, its neighbours alike.
    Distances are rounded to 6 places before they are ordered. Vectors must be of one length.
    """
    b = F.floor(F.col("pos") / window)
    dealt = standardised(stream).withColumn("block", F.explode(F.array(b, b + 1)))

    def found(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        pos, idx = t["pos"].to_numpy(), t["idx"].to_numpy()
        z = t["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(pos), -1)
        first = int(np.searchsorted(pos, int(t["block"][0].as_py()) * window))
        own = nearest(z, pos, idx, first, k, window) if first < len(pos) else (np.zeros(0),) * 4
        return pa.table([pa.array(c, t) for c, t in zip(own, _FOUND.types)], schema=_FOUND)

    return dealt.groupBy("block").applyInArrow(found, "idx long, other long, rank int, distance double")


_FOUND = pa.schema([("idx", pa.int64()), ("other", pa.int64()), ("rank", pa.int32()), ("distance", pa.float64())])


def single_scale(stream: DataFrame) -> DataFrame:
    """idx, scale: the mean over dimensions of the deviation (of a sample) of strictly earlier rows; null before two of them."""
    there = F.filter("var", lambda v: v.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, v: a + F.sqrt(v)) / F.nullif(F.size(there), F.lit(0))
    return prefix_moments(stream).select("idx", F.when(F.col("pos") > 1, mean * F.sqrt(F.col("pos") / (F.col("pos") - 1))).alias("scale"))


def vote(found: DataFrame, stream: DataFrame, weighted: bool = True) -> DataFrame:
    """idx, label, pred: the label with most votes of the neighbours, that of the nearest on ties; null without any.

    A vote weighs the inverse of its distance, and one at distance 0 decides alone; with weighted off all weigh alike.
    """
    labels = stream.select(F.col("idx").alias("other"), F.col("label").alias("their"))
    weight = F.when(F.col("distance") > 0, 1 / F.col("distance")) if weighted else F.lit(1.0)
    exact = F.max(F.when(F.col("distance") == 0, -F.col("rank"))) if weighted else F.lit(None).cast("int")
    votes = found.join(labels, "other").groupBy("idx", "their").agg(exact.alias("exact"), F.round(F.sum(weight), 6).alias("n"), F.min("rank").alias("best"))
    top = votes.groupBy("idx").agg(F.max(F.struct(F.coalesce("exact", F.lit(-(1 << 30))).alias("exact"), "n", (-F.col("best")).alias("neg"), "their")).alias("t"))
    return stream.join(top, "idx", "left").select("idx", "label", F.col("t.their").alias("pred"))
