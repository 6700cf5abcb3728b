"""Quality by Bradley-Terry pairwise ranking.

Numeric features describe each whole text (case, symbols, repetition, line shapes). Preference pairs set a labelled
good document against a labelled bad one; logistic loss on the difference of their features learns a weight for each
feature, whose weighted sum ranks documents. The threshold is a quantile of the labelled scores, at the share of bad
labels, and the score maps it to 0.3.

Learned from every labelled row that is not held out, and from all pairs of a good and a bad one: the loss of a row
against all of the other label depends on its score and on the other label's scores alone, so sums of rows by label and
score give the gradient; scores are BINS places, and a row between two counts for both in proportion. Each step is one pass over the
features; a task makes sums of a fixed size, which are added up on executors, so that the driver gets PARTIALS of them at most, however
many tasks there are. The threshold and the medians are found by halving ranges over all
scores, to 1e-11. An id counts once: of several labels the smallest, of several texts the one of smallest features.

Defined cases: null and empty texts have the features of an empty text and score like others. Repeated rows and null
ids are scored like others. Without labels of both classes every document scores 0.5.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, held_out, spread, written
from .linear import sigmoid

#: Places of scores for the gradient, bins for the curvature, and the score beyond which all count at the last place.
BINS, COARSE, RANGE = 4096, 128, 60.0
RIDGE = 1e-4
#: Partial sums that a step brings to the driver at most.
PARTIALS = 4
FEATURES = "log_words upper_share symbol_share digit_share symbol_ends long_words short_words repeat_share top_share run_share pipe_share line_repeat compress mean_length".split()

_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" or _b >= 128 else 3 if _c.isdigit() else 4 if _b in WHITE else 5 if _c in ".,;:'\"-()?" else 6


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    if not (words := raw.split()):
        return [0.0] * len(FEATURES)
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7)
    letters, solid = kinds[1] + kinds[2], len(raw) - kinds[4]
    # Multi-byte letters in upper case are counted as lower case; the share is over all letters.
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = np.array([w[-1] for w in words], np.uint8)
    sizes = np.array([len(w) for w in words])
    return [
        float(np.log1p(n)), float(kinds[1] / max(1, letters)), float(kinds[6] / solid), float(kinds[3] / solid), float((_KIND[ends] == 6).mean()),
        float((sizes > 14).mean()), float((sizes < 3).mean()), 1 - len(count) / n, max(count.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        count[b"|"] / n, 1 - len(set(lines)) / len(lines), min(1.0, len(zlib.compress(raw, 1)) / len(raw)), float(min(sizes.mean(), 40) / 10),
    ]


def widen(x: np.ndarray) -> np.ndarray:
    """Features and their square roots: a little junk inside a long text counts more than in proportion."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0))])


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, spread: float) -> None:
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((widen(x) - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(sigmoid((self.strength(x) - self.cut) / self.spread + np.log(0.3 / 0.7)))


#: Sums of f(features, labels) over parts that hold each labelled row once, one array a part.
Passes = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], list[np.ndarray]]


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    wide = widen(x)
    return np.concatenate([[(y == 0).sum(), (y == 1).sum()], wide.sum(0), (wide * wide).sum(0)])


def _binned(m: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By label and score: rows and sums of their features; by label and coarse bin the products of their features."""
    z = ((widen(x) - m.mean) / m.scale).clip(-8, 8)
    d = z.shape[1]
    at = ((z @ m.weights).clip(-RANGE, RANGE) + RANGE) * ((BINS - 1) / (2 * RANGE))
    low = np.minimum(at.astype(np.int64), BINS - 2)
    key, part = y * BINS + low, at - low
    sums = np.stack([np.bincount(key, v * (1 - part), 2 * BINS) + np.bincount(key + 1, v * part, 2 * BINS) for v in (np.ones(len(z)), *z.T)], 1)
    squares = np.zeros((2 * COARSE, d, d))
    wide = key // (BINS // COARSE)
    for k in np.unique(wide):
        own = z[wide == k]
        squares[k] = own.T @ own
    return np.concatenate([sums.ravel(), squares.ravel()])


def _step(m: Model, sums: np.ndarray) -> np.ndarray:
    """Newton's step for the mean loss over all pairs of a good and a bad row."""
    d = len(m.weights)
    cut = 2 * BINS * (d + 1)
    fine, squares = sums[:cut].reshape(2, BINS, d + 1), sums[cut:].reshape(2, COARSE, d, d)
    place = np.linspace(-RANGE, RANGE, BINS)

    def against(rows: list[np.ndarray], score: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and sums of features of bad and good bins, and how likely each bad one is put before each good one."""
        return rows[0][:, 0], rows[0][:, 1:], rows[1][:, 0], rows[1][:, 1:], np.asarray(sigmoid(score[0][:, None] - score[1][None, :]))

    n0, z0, n1, z1, p = against([r[r[:, 0] > 0] for r in fine], [place[r[:, 0] > 0] for r in fine])
    pairs = n0.sum() * n1.sum()
    grad = ((p @ n1) @ z0 - (n0 @ p) @ z1) / pairs + RIDGE * m.weights
    thick = fine.reshape(2, COARSE, -1, d + 1)
    n0, z0, n1, z1, p = against(list(thick.sum(2)), list((thick[..., 0] * place.reshape(COARSE, -1)).sum(2) / np.maximum(thick[..., 0].sum(2), 1e-9)))
    p = p * (1 - p)
    cross = z0.T @ p @ z1
    curve = (np.tensordot(p @ n1, squares[0], 1) + np.tensordot(n0 @ p, squares[1], 1) - cross - cross.T) / pairs
    return np.linalg.solve(curve + (RIDGE + 1e-9) * np.eye(d), grad)


def _at_ranks(passes: Passes, m: Model, ranks: list[tuple[int, int]]) -> list[float]:
    """Of (label or -1 for both, k): the score with k smaller ones in that order, to 1e-11 of the largest possible score."""
    most = 8 * float(np.abs(m.weights).sum()) + 1
    low, left = np.full(len(ranks), -most), np.array([k for _, k in ranks], np.float64)
    wide, n = 2 * most, 4096
    while wide > 1e-11 * most:
        def counts(x: np.ndarray, y: np.ndarray, low: np.ndarray = low, wide: float = wide) -> np.ndarray:
            s = m.strength(x)
            out = []
            for (label, _), a in zip(ranks, low):
                at = np.floor((s[(y == label) | (label < 0)] - a) * (n / wide)).astype(np.int64)
                out.append(np.bincount(at[(at >= 0) & (at < n)], minlength=n))
            return np.concatenate(out).astype(np.float64)

        total = np.cumsum(np.sum(passes(counts), 0).reshape(len(ranks), n), 1)
        own = np.minimum((total <= left[:, None]).sum(1), n - 1)
        left = left - np.where(own > 0, total[np.arange(len(ranks)), own - 1], 0)
        low, wide = low + own * (wide / n), wide / n
    return (low + wide / 2).tolist()


def ranked(passes: Passes, shares: dict[int, float] | None = None) -> Model:
    """Bradley-Terry over all pairs. shares: of each label, for the quantile, if other than those of the rows."""
    sums = np.sum(passes(_moments), 0)
    (bad, good), d = sums[:2], len(FEATURES) * 2
    mean = sums[2 : d + 2] / max(1, bad + good)
    scale = np.sqrt(np.maximum(sums[d + 2 :] / max(1, bad + good) - mean * mean, 0)) + 1e-6
    if not bad or not good:
        return Model(mean, scale, np.zeros(d), np.log(0.3 / 0.7), 1.0)
    m = Model(mean, scale, np.zeros(d), 0.0, 1.0)
    for _ in range(60):
        step = _step(m, np.sum(passes(lambda x, y, m=m: _binned(m, x, y)), 0))
        m = Model(mean, scale, m.weights - step * min(1.0, 5 / (np.abs(step).max() + 1e-12)), 0.0, 1.0)
        if np.abs(step).max() < 1e-4:
            break
    else:
        warnings.warn(f"quality: after 60 steps a weight still moves by {np.abs(step).max():.2g}", stacklevel=2)
    n = int(bad + good)
    share = shares[0] / (shares[0] + shares[1]) if shares else bad / n
    at = min(max(int(np.ceil(share * n - 1e-9)) - 1, 0), n - 1)
    low, high, fair, poor = _at_ranks(passes, m, [(-1, at), (-1, min(at + 1, n - 1)), (1, int(good) // 2), (0, int(bad) // 2)])
    cut = (low + high) / 2 if high - low > 1e-8 else low - 1e-8  # equal scores on both sides count as good
    return Model(mean, scale, m.weights, cut, max(1e-3, (fair - poor) / 8))


def rank(x: np.ndarray, y: np.ndarray, shares: dict[int, float] | None = None) -> Model:
    return ranked(lambda f: [f(x, y.astype(np.int64))], shares)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _packed(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([zstandard.compress(sums.astype(np.float64).tobytes(), 1)], pa.binary())], names=["sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all packed sums of a partition; none of an empty one."""
    total = None
    for b in batches:
        for x in b.column(0):
            own = np.frombuffer(zstandard.decompress(x.as_py()))
            total = own.copy() if total is None else total + own
    if total is not None:
        yield _packed(total)


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>"))


def learned(rows: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows that are not held out."""
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    train = written(rows.join(own, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).sortWithinPartitions("doc_id"))

    tasks = train.rdd.getNumPartitions()

    def passes(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = f(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64))
            for b in batches:
                total = total + f(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            yield _packed(total)

        sums = train.select("x", "label").mapInArrow(run, "sums binary")
        if tasks > PARTIALS:
            sums = sums.withColumn("at", F.spark_partition_id() % PARTIALS).repartition(PARTIALS, "at").select("sums").mapInArrow(_added, "sums binary")
        got = [np.frombuffer(zstandard.decompress(r["sums"])) for r in sums.collect()]
        return got or [f(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64))]

    return ranked(passes)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return learned(featured(docs), labels)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = featured(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
    model = learned(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
