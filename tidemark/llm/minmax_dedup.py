"""Near-dedup by min-max hashing over word shingles, with every link confirmed on full sets.

A text's set holds the hashes of its distinct 5-word shingles. Each permutation gives two values, the smallest and the
largest element under it, so 64 evaluations give a signature of 128 values, cut into 32 bands of 4. Two large sets of
similarity 0.75 miss all bands with probability below 0.00001. In small sets minimum and maximum depend on each other, so
sets of up to SMALL shingles have exact keys besides: of n shingles the floor(n / 4) + 1 smallest hashes, of which two
sets of similarity 0.75 or more always have one in common. Equal sets are first collapsed into one representative
(their smallest doc_id), so copies are never paired. Links are then found in rounds, and pairs of texts already joined
are skipped: first each representative with the bucket leader it shares most bands with, then within buckets that still
hold several components the most alike partner of each, in two rounds. Last, the texts of all pairs that are left meet in their first common bucket with their full sets,
where pairs are confirmed in the task and only links leave it. In buckets pairs are compared by
their signatures (one byte a value); only those whose estimate is not clearly too low (six and a half standard errors, a
chance of 4e-11) are confirmed on full sets. Buckets are dealt into blocks, so none is gathered whole: the rows of a
bucket's largest component go to one block each, all others to every block, so a large bucket that is all but joined
costs its rows once. Nothing is dropped or capped.

Defined cases: texts that are null, empty or without words have n_shingles 0 and link with nothing. A text of fewer
than five words is one shingle. Repeated rows are copies of each other, with the same component_id and, if it is theirs,
both kept. Rows without an id link like others, also as the only link between two that have one, but are never a
component_id: kept is false for them, unless no row of their component has an id; then component_id is null and kept true. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, real_id, runs, small_batches, spread, stand_in, written

WORDS, SIMILAR = 5, 75
PERMUTATIONS, BANDS = 64, 32
#: Bytes of 128 that agree at least in a pair worth confirming: 0.75 less six and a half standard errors of 0.038.
AGREE = 64
#: Shingles up to which a set has exact keys, and the most such keys. Pairs are exact where the smaller set has 3/4 of SMALL.
SMALL = 24
EXACT = SMALL // 4 + 1
BLOCK = 1024
#: Shingles that count as one row when a bucket is cut, so that a block's full sets are bounded in bytes too.
ROW_ITEMS = 2048
#: Most alike partners a bucket that a text is confirmed against in each of the rounds before the last, which leaves none out.
ROUNDS = (1, 1)

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_W = _rng.integers(0, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOW).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64) * _W[WORDS]
    for i in range(k):
        h += w[i : i + n] * _W[i]
    return np.unique(_mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    """(permutations, 2): smallest and largest value under each permutation."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), 4096):
        v = s[None, i : i + 4096] * _A[:, None] + _B[:, None]
        low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
    return np.stack([low, high], 1)


def banded(sig: np.ndarray) -> np.ndarray:
    own = sig.reshape(BANDS, -1)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for c in range(own.shape[1]):
        h = _mix(h ^ own[:, c])
    return h.view(np.int64)


def exact_keys(s: np.ndarray) -> np.ndarray:
    """Of a small set's sorted hashes the first floor(n / 4) + 1, as keys; none of a large set."""
    return _mix(s[: len(s) // 4 + 1] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64) if len(s) <= SMALL else np.zeros(0, np.int64)


def short(sig: np.ndarray) -> bytes:
    return (_mix(sig.ravel()) >> np.uint64(56)).astype(np.uint8).tobytes()


_PRINTS = "doc_id long, n long, digest binary, bands array<long>, sig binary"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, bands, sig = [], [], [], []
        for t in b.column(1):
            s = shingles(t.as_py())
            n.append(len(s))
            if len(s):
                m = signature(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(np.concatenate([banded(m), exact_keys(s)]))
                sig.append(short(m))
            else:
                digest.append(None), bands.append(None), sig.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "n", "digest", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in part.column(1)], pa.list_(pa.int64()))], names=["rep", "items"])


def _named_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            own = [s for t in b.column(1).slice(i, 256) if len(s := shingles(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["digest", "items"])


class _Group:
    """A group of rows and its pairs worth confirming: enough agreeing bytes, sizes that allow the similarity, different components."""

    def __init__(self, rows: pa.Table) -> None:
        self.rep, self.comp, self.n, self.own, self.other = (rows[c].to_numpy() for c in ("rep", "comp", "n", "own", "other"))
        self.sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(self.rep), -1)

    def pairs(self, both_ways: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, agreeing bytes), those of one row never in two parts."""
        n, comp = self.n, self.comp
        left = np.flatnonzero(self.own <= self.other)
        right = left if (self.own == self.other).all() else np.flatnonzero(self.own >= self.other)
        step = max(1, (1 << 17) // max(1, len(right)))
        for i in range(0, len(left), step):
            x = left[i : i + step]
            near = (comp[x, None] != comp[None, right]) & (100 * np.minimum(n[x, None], n[None, right]) >= SIMILAR * np.maximum(n[x, None], n[None, right]))
            if right is left and not both_ways:
                near &= x[:, None] < right[None]
            p, q = np.nonzero(near)
            if len(p):
                agree = (self.sig[x[p]] == self.sig[right[q]]).sum(1)
                ok = agree >= AGREE
                if ok.any():
                    yield x[p[ok]], right[q[ok]], agree[ok]


def _pairs(partners: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's most alike partners in its group: a dense group is joined without most of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            group = _Group(rows)
            for p, q, agree in group.pairs(both_ways=True):
                o = np.lexsort((group.rep[q], -agree, p))
                p, q, agree = p[o], q[o], agree[o]
                turn = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                few = np.arange(len(p)) - turn[np.searchsorted(turn, np.arange(len(p)), "right") - 1] < partners
                u, v = group.rep[p[few]], group.rep[q[few]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(agree[few].astype(np.int64))], names=["a", "b", "agree"])

    return run


def _left(rows: pa.Table, group: _Group) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The group's pairs less those that meet in an earlier band too, or in a smaller exact key."""
    bands, exact = np.zeros((len(group.rep), BANDS), np.int64), np.zeros((len(group.rep), EXACT), np.int64)
    for i, own in enumerate(rows["bands"]):
        own = own.values.to_numpy()
        bands[i], exact[i, : len(own) - BANDS] = own[:BANDS], own[BANDS:]
    key = rows["key"].to_numpy()
    for p, q, agree in group.pairs(both_ways=False):
        for i in range(0, len(p), 1 << 14):
            u, v, k = p[i : i + (1 << 14)], q[i : i + (1 << 14)], agree[i : i + (1 << 14)]
            same = bands[u] == bands[v]
            banded_too = same.any(1)
            first = bands[u, same.argmax(1)]
            if not banded_too.all():
                both = (exact[u][:, :, None] == exact[v][:, None, :]) & (exact[u] != 0)[:, :, None]
                common = np.where(both.any(2), exact[u], np.iinfo(np.int64).max).min(1)
                first = np.where(banded_too, first, common)
            here = first == key[u]
            if here.any():
                yield u[here], v[here], k[here]


_ROW = "g long, key long, rep long, comp long, n long, sig binary, bands array<long>, own int, other int"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have any pair left in their group."""
    for _, rows in runs(batches):
        some = np.zeros(rows.num_rows, bool)
        for p, q, _ in _left(rows, _Group(rows)):
            some[p] = some[q] = True
        if some.any():
            yield from rows.filter(pa.array(some)).to_batches()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a group, confirmed on full sets in the order of likeness, but for pairs that earlier ones have joined."""
    for _, rows in runs(batches):
        group = _Group(rows)
        items = [np.asarray(x.values) for x in rows["items"]]
        root = {int(c): int(c) for c in group.comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for p, q, agree in _left(rows, group):
            for i in np.argsort(-agree, kind="stable"):
                u, v = int(p[i]), int(q[i])
                x, y = find(int(group.comp[u])), find(int(group.comp[v]))
                if x != y:
                    shared = len(np.intersect1d(items[u], items[v], assume_unique=True))
                    if 100 * shared >= SIMILAR * (len(items[u]) + len(items[v]) - shared):
                        root[max(x, y)] = min(x, y)
                        a.append(int(group.rep[u]))
                        b.append(int(group.rep[v]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) those similar enough on full sets."""
    both = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= SIMILAR * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def _dealt(members: DataFrame, comps: DataFrame, reps: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several components, in groups (_ROW).

    Only pairs of different components matter. A bucket's largest component is cut into blocks; all other rows of the
    bucket meet each of them, and each other in blocks of their own.
    """
    own = members.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    size = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") / ROW_ITEMS)).alias("size")
    parts = own.groupBy("key", "comp").agg(size)
    mixed = parts.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    own = own.join(mixed.select("key", "top", "all"), "key").join(reps.select("rep", "sig", "bands"), "rep")
    whole = F.col("all") <= BLOCK
    major = F.col("comp") == F.col("top.comp")
    blocks = F.ceil(F.col("top.size") / BLOCK).cast("int")
    rest = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.size")) / BLOCK)).cast("int")
    at = lambda k: F.pmod(F.xxhash64("rep", F.lit(3)), k).cast("int")
    place = lambda kind, x, y, mine, its: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), mine.cast("int").alias("own"), its.cast("int").alias("other"))
    none, one = F.lit(0), F.lit(1)
    against = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: place(1, i, none, none, one))
    among = F.transform(F.sequence(F.lit(0), rest - 1), lambda i: place(2, F.least(at(rest), i), F.greatest(at(rest), i), at(rest), i))
    places = F.when(whole, F.array(place(0, none, none, none, none))).when(major, F.array(place(1, at(blocks), none, one, none))).otherwise(F.concat(against, among))
    dealt = own.withColumn("p", F.explode(places)).withColumn("g", F.xxhash64("key", "p.kind", "p.x", "p.y"))
    return dealt.select("g", "key", "rep", "comp", "n", "sig", "bands", "p.own", "p.other").repartition("g").sortWithinPartitions("g")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links."""
    links = written(links)
    return comps if links.isEmpty() else written(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    with small_batches(docs.sparkSession):
        return _near_groups(docs, id_col, text_col)


def _near_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    prints = written(src.mapInArrow(_prints, _PRINTS))
    seen = prints.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull() & (F.col("n") > 0))).first()
    top, nameless = F.lit(seen[0]).cast("long"), bool(seen[1])
    reps = prints.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = written(reps.withColumn("rep", stand_in(F.col("rep"), top)))
    rows = reps.select(F.explode("bands").alias("key"), "rep", "n")
    leaders = rows.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "lead")
    members = written(rows.join(leaders, "key"))
    ids = members.select("rep").distinct()
    sets = src.join(ids, src.doc_id == ids.rep, "left_semi").mapInArrow(_sets, "rep long, items array<long>")
    if nameless:  # texts of which no row has an id: found by the digest of their set
        own = src.where("doc_id is null").mapInArrow(_named_sets, "digest binary, items array<long>").dropDuplicates(["digest"])
        sets = sets.union(own.join(reps.where(real_id(F.col("rep"), top).isNull()), "digest").join(ids, "rep", "left_semi").select("rep", "items"))
    sets = written(sets)

    first = members.where("rep <> lead").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("shared")).groupBy("rep").agg(F.max(F.struct("shared", (-F.col("lead")).alias("neg"))).alias("best"))
    links = written(_confirmed(first.select((-F.col("best.neg")).alias("a"), F.col("rep").alias("b")), sets))
    comps = written(components(links))

    tried = None
    for partners in ROUNDS:
        found = _dealt(members, comps, reps).drop("key", "bands").mapInArrow(_pairs(partners), "a long, b long, agree long").groupBy("a", "b").agg(F.max("agree").alias("agree"))
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        order = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b"))
        found = written(found.withColumn("k", order).where(F.col("k") <= partners).select("a", "b"))
        if not found.isEmpty():
            tried = found if tried is None else tried.union(found)
            comps = _joined(comps, _confirmed(found, sets))
    rest = _dealt(members, comps, reps).mapInArrow(_open, _ROW).join(sets, "rep").repartition("g").sortWithinPartitions("g")
    comps = _joined(comps, rest.mapInArrow(_settle, "a long, b long"))
    named = reps.select("digest", "rep").join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", real_id(F.coalesce("component", "rep"), top).alias("component"))
    out = prints.select("doc_id", "n", "digest").join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
