"""Near-dedup of embeddings by iterative quantisation and multi-index Hamming tables, reranked on the vectors.

From a bounded sample (SAMPLE vectors, by a hash of the id) principal axes and a rotation are learned that bring unit
vectors close to the corners of the binary cube. A vector's code is the signs of its rotated coordinates; no mean is
subtracted, for where vectors share a direction that would widen the angles of near pairs beyond what the tables and
the Hamming bound are made for. The rotation is fitted to the centred sample, so it doesn't turn the shared direction
into a corner, where all codes would be alike; still, the stronger it is, the larger the buckets. Independent starts
give several rotations; each code is cut into substrings, one table each. Two vectors meet in a table if they have the
label and the table's substring in common. Substrings have two bits more than the number of vectors of the largest label
needs, so that unlike vectors seldom meet at any size, and there are as many tables as a pair of cosine 0.93 needs to miss
all with probability MISS (``tables_for``: 20 of 12 bits for up to 1,024 vectors, 31 of 15 for 8,192, 60 of 20 for
262,144, about the 0.18th power of the number). Within buckets the whole codes prune pairs by Hamming distance, and cosine in double precision on the original vectors decides. A pair that meets in several
tables counts in the first only, so link counts add up without the pairs ever being gathered; from each bucket only
counts and a spanning forest of its links leave the task. All rows are indexed. Equal vectors of a label are collapsed
into one with a weight. Large buckets are dealt into blocks.

At cosine 0.97 a pair is missed with a probability below a tenth of MISS.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, and rows without a label,
link with nothing: n_links 0 and their own component. Vectors of different length never link. Repeated rows count as
different vectors of one id. Vectors without a vec_id take part in links like others, also as the only link between two
with one, but are never a component_id: theirs is null, and kept true, if no vector of their component has an id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocked, components, real_id, spread, stand_in, whole_groups, written

COSINE = 0.93
SAMPLE, ROUNDS = 8192, 30
WIDTH, LEAST_BITS, MISS = 64, 12, 0.008
BLOCK = 1024
#: Rows of a group up to which its pairs are listed together with those of other groups; larger ones are compared as a matrix.
SMALL = 64


class Index(NamedTuple):
    """How codes are cut: bits of a substring, tables, and codes, which hold them."""

    bits: int
    tables: int
    codes: int

    @property
    def hamming(self) -> int:
        """Bits of all codes that may differ: twice what cosine 0.93 makes likely, over five standard deviations away."""
        return math.ceil(2 * self.codes * WIDTH * math.acos(COSINE) / math.pi)


def tables_for(vectors: int) -> Index:
    """The index for as many different vectors of one label."""
    bits = min(WIDTH, max(LEAST_BITS, (max(1, vectors) - 1).bit_length() + 2))
    agree = (1 - math.acos(COSINE) / math.pi) ** bits
    tables = math.ceil(math.log(MISS) / math.log(1 - agree))
    return Index(bits, tables, math.ceil(tables / (WIDTH // bits)))


def itq(x: np.ndarray, seed: int) -> np.ndarray:
    """Projection of d x WIDTH from unit vectors x."""
    d = x.shape[1]
    rng = np.random.default_rng([seed, d])
    if len(x) < 2:
        return np.linalg.qr(rng.standard_normal((max(d, WIDTH), max(d, WIDTH))))[0][:d, :WIDTH]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :WIDTH]
    if d < WIDTH:  # fewer dimensions than bits: each axis takes part in several bits
        axes = np.hstack([axes, rng.standard_normal((d, WIDTH - d)) / math.sqrt(d)])
    v = (x - x.mean(0)) @ axes
    r = np.linalg.qr(rng.standard_normal((WIDTH, WIDTH)))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return axes @ r


class Coder:
    """Codes of vectors, with rotations for each length of vector in the sample."""

    def __init__(self, sample: list[np.ndarray], codes: int) -> None:
        by: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v / np.linalg.norm(v))
        self.n = codes
        self.maps = {d: [itq(np.array(x), seed) for seed in range(codes)] for d, x in by.items()}

    def of(self, d: int) -> list[np.ndarray]:
        return self.maps.get(d) or _plain(d, self.n)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, codes) of 64-bit codes for unit vectors of one length."""
        powers = np.uint64(1) << np.arange(WIDTH, dtype=np.uint64)
        return np.stack([((x @ p > 0).astype(np.uint64) * powers).sum(1) for p in self.of(x.shape[1])], 1)


@lru_cache(8)
def _plain(d: int, codes: int) -> list[np.ndarray]:
    return [itq(np.zeros((0, d)), seed) for seed in range(codes)]


def substrings(codes: np.ndarray, index: Index) -> np.ndarray:
    """(rows, tables) of substrings."""
    mask, per = np.uint64((1 << index.bits) - 1), WIDTH // index.bits
    return np.stack([(codes[:, t // per] >> np.uint64(t % per * index.bits)) & mask for t in range(index.tables)], 1)


def usable(v: object) -> np.ndarray | None:
    """The vector in double precision, or None if it links with nothing."""
    if v is None or not len(v) or any(c is None for c in v):
        return None
    x = np.asarray(v, np.float64)
    return x if np.isfinite(x).all() and 0 < (n := np.linalg.norm(x)) < np.inf else None


def forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the smallest index reachable from each row."""
    lab = np.arange(len(near))
    while True:
        new = np.minimum(lab, np.where(near, lab[None], len(lab)).min(1, initial=len(lab)))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


class _Rows:
    """Rows of whole groups, sorted by group, as arrays."""

    def __init__(self, rows: pa.Table, index: Index) -> None:
        self.g, self.rep, self.weight, self.own, self.other, self.label, self.table = (rows[c].to_numpy() for c in ("g", "rep", "weight", "own", "other", "label", "table"))
        self.index = index
        self.codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint64).reshape(len(self.rep), index.codes)
        raw = rows["vec"].to_pylist()
        self.size = np.array([len(r) for r in raw])
        self.x = np.zeros((len(raw), self.size.max() // 8))
        for i, r in enumerate(raw):
            self.x[i, : len(r) // 8] = np.frombuffer(r)
        self.sub = substrings(self.codes, index)

    def small(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of groups of few rows: all at once, the pairs of rows one apart, two apart and so on."""
        left = np.repeat(ends, ends - starts)  # where the group of each row ends
        at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]) if len(starts) else np.zeros(0, np.int64)
        p, q = [], []
        for d in range(1, int((ends - starts).max(initial=1))):
            ok = at + d < left
            p.append(at[ok])
            q.append(at[ok] + d)
        p, q = np.concatenate([*p, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*q, np.zeros(0, np.int64)]).astype(np.int64)
        ok = (self.label[p] == self.label[q]) & (self.size[p] == self.size[q]) & (self.table[p] == self.table[q]) & ((self.own[p] != self.own[q]) | (self.own[p] == self.other[p]))
        p, q = p[ok], q[ok]
        same = self.sub[p] == self.sub[q]
        ok = same.argmax(1) == self.table[p]  # met here, and not before
        ok &= same[np.arange(len(p)), self.table[p]]
        p, q = p[ok], q[ok]
        ok = np.bitwise_count(self.codes[p] ^ self.codes[q]).sum(1, dtype=np.int64) <= self.index.hamming
        p, q = p[ok], q[ok]
        ok = np.einsum("ij,ij->i", self.x[p], self.x[q]) >= COSINE
        return p[ok], q[ok]

    def large(self, start: int, end: int) -> np.ndarray:
        """Links of one group as a symmetric matrix."""
        s = slice(start, end)
        codes, sub, x = self.codes[s], self.sub[s], self.x[s]
        t, n = int(self.table[start]), end - start
        near = np.zeros((n, n), bool)
        for i in range(0, n, 256):
            k = slice(i, i + 256)
            own = (self.label[s][k, None] == self.label[None, s]) & (self.size[s][k, None] == self.size[None, s]) & (self.table[s][k, None] == self.table[None, s])
            own &= (sub[k, t, None] == sub[None, :, t]) & (x[k] @ x.T >= COSINE)
            apart = np.zeros(own.shape, np.uint16)
            for c in range(codes.shape[1]):
                apart += np.bitwise_count(codes[k, c, None] ^ codes[None, :, c])
            own &= apart <= self.index.hamming
            for j in range(t):  # met before
                own &= sub[k, j, None] != sub[None, :, j]
            near[k] = own
        np.fill_diagonal(near, False)
        if not (self.own[s] == self.other[s]).all():
            near &= self.own[s][:, None] != self.own[None, s]
        return near


def _buckets(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From each group the number of links of its rows, and rows whose links join them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            rows = _Rows(t, index)
            starts = np.flatnonzero(np.append(True, rows.g[1:] != rows.g[:-1]))
            ends = np.append(starts[1:], len(rows.g))
            few = ends - starts <= SMALL
            p, q = rows.small(starts[few], ends[few])
            out = [(np.append(rows.rep[p], rows.rep[q]), np.append(rows.weight[q], rows.weight[p]), np.append(rows.rep[q], rows.rep[p]))]
            for a, b in zip(starts[~few], ends[~few]):
                near = rows.large(a, b)
                links = near @ rows.weight[a:b]
                some = np.flatnonzero(links)
                if len(some):
                    own = rows.rep[a:b]
                    out.append((own[some], links[some], own[forest(near)[some]]))
            for rep, links, root in out:
                if len(rep):
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(root)], names=["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    src = spread(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label")))
    picked = src.where("v is not null and label is not null").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE).select("v")
    sample = [x for r in picked.toLocalIterator() if (x := usable(r["v"])) is not None]
    largest = src.where("v is not null and label is not null").groupBy("label").agg(F.approx_count_distinct(F.xxhash64("v")).alias("n")).agg(F.max("n")).first()[0] or 0
    index = tables_for(largest)
    coder = vectors.sparkSession.sparkContext.broadcast(Coder(sample, index.codes))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [usable(v.as_py()) if g is not None else None for v, g in zip(b.column(1), b.column(2).to_pylist())]
            unit = [None if x is None else x / np.linalg.norm(x) for x in xs]
            codes: list[bytes | None] = [None] * len(xs)
            for d in {len(x) for x in unit if x is not None}:
                at = [i for i, x in enumerate(unit) if x is not None and len(x) == d]
                for i, c in zip(at, coder.value.codes(np.array([unit[i] for i in at]))):
                    codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([None if x is None else xxhash.xxh3_128_digest(x.tobytes()) for x in xs], pa.binary()),
                pa.array([None if x is None else x.tobytes() for x in unit], pa.binary()), pa.array(codes, pa.binary())], names=["vec_id", "label", "digest", "vec", "codes"])

    rows = written(src.select("vec_id", "v", "label").mapInArrow(coded, "vec_id long, label long, digest binary, vec binary, codes binary"))
    top = F.lit(rows.agg(F.max("vec_id")).first()[0]).cast("long")
    reps = rows.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"), F.first("codes").alias("codes"))
    reps = written(reps.withColumn("rep", stand_in(F.col("rep"), top)))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sub = substrings(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, index.codes), index)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sub.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["rep", "label", "subs"])

    keys = reps.select("rep", "label", "codes").mapInArrow(tables, "rep long, label long, subs array<long>").select("rep", "label", F.posexplode("subs").alias("table", "sub"))
    bucket = ["label", "table", "sub"]
    sizes = keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keys.join(sizes, bucket).join(reps.select("rep", "label", "weight", "vec", "codes"), ["rep", "label"])
    dealt = blocked(met, F.xxhash64(*bucket), F.col("size"), F.col("rep"), BLOCK).select("g", "rep", "weight", "own", "other", "label", F.col("table").cast("int").alias("table"), "codes", "vec").repartition("g").sortWithinPartitions("g")
    found = written(dealt.mapInArrow(_buckets(index), "rep long, links long, root long"))
    comps = written(components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        reps.select("label", "digest", "rep", "weight").join(counts, "rep", "left").join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), real_id(F.coalesce("component", "rep"), top).alias("component"))
    )
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
