"""Removal of repeated 50-byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by most-significant digits and only through THRESHOLD bytes; a group that is still equal then is
exactly a repeated window. The digits are chosen so that most suffixes never move:

1. Each window's anchor is its 16-byte string of smallest hash (the leftmost on ties), a function of the window's bytes
   alone, so equal windows have equal anchors. Neighbouring windows with the same anchor form one run, and only runs
   are sorted, about one for 19 bytes. First digit: the anchor, whose top bits deal the runs to buckets, so no key but
   one string can be hot, and each map task sends an equal run of several documents once (the others are already known
   to be repeated).
2. Second digit: the bytes of the whole run. Runs equal in both are repeated as a whole; all but those of the smallest
   doc_id are removed.
3. Runs that share the anchor only may share some windows, if they also agree on 17 bytes before or after it: a window
   holds that many on one side. The windows of such runs are sorted singly by their 50 bytes, in another round over the
   texts that hold them.

The digits stand for bytes: a digit of 50 bytes and more travels as a hash of it. Runs are told apart by 96 bits (48 of
the anchor, 48 of the run), windows by 96 of two hashes with different multipliers; that two different ones agree
anywhere among 10**13 has a probability of about 0.001. Bytes themselves would travel as 3.6 times the text.

Records travel as compressed blobs of arrays, one a map chunk and bucket, and are sorted inside a bucket with numpy. The
number of buckets follows the bytes of the input, for windows the number of windows, so a bucket fits in memory at every
size; a blob of runs still holds about 100 records at 30 GB. Intermediate results are tables in the shared folder.

Defined cases: a null or empty text has no bytes; texts under 50 bytes keep all. A null doc_id counts as larger than all
others. Rows of one doc_id, or without one, never remove each other's bytes; each row is judged by its own text: rows
that share an id and not a text, and rows without an id, are told apart by 64 bits of their text's hash (``twin``, 0
where the id has one text). Decisions are on the input, not on what is left. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, small_batches, spread, written

THRESHOLD, ANCHOR = 50, 16
#: Bytes of text for which a map task gathers records, for which there is one bucket, and that are hashed at once. A chunk
#: sends a blob to each bucket, so small buckets would make blobs of a few records of a large input.
CHUNK, BUCKET, PIECE = 16 << 20, 8 << 20, 1 << 20
#: Windows sorted singly for which there is one bucket, and buckets at least.
WINDOWS, LEAST = 1 << 19, 1 << 10
#: Bytes of all texts for each task of the sorts, at most.
TASK = 128 << 20
SIDE = (THRESHOLD - ANCHOR + 1) // 2
LAST = (1 << 63) - 1

_rng = np.random.default_rng(50)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
#: Two odd multipliers with their inverses.
_BASES = [(m, pow(m, -1, 1 << 64)) for m in (int(_rng.integers(1 << 60, 1 << 62)) | 5 for _ in range(2))]
_powers: dict[int, np.ndarray] = {}
_TIGHT, _LOOSE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        out[1:] = np.uint64(base)
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substring of some bytes, from prefix sums of a polynomial hash."""

    def __init__(self, raw: np.ndarray, base: int = 0) -> None:
        forth, back = _BASES[base]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(forth, len(raw)))])
        self.back = _power(back, len(raw) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])

    def every(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return _mix((self.sums[n:] - self.sums[:m]) * self.back[:m])


def pieces(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of overlapping parts that hold each window once."""
    a = np.frombuffer(raw, np.uint8)
    for i in range(0, max(1, len(a) - THRESHOLD + 1), PIECE):
        yield i, a[i : i + PIECE + THRESHOLD - 1]


def anchored_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, hash of the run's bytes, of the sides, first and last window start) of each run of windows with one anchor.

    The sides are two 16-bit hashes, of the SIDE bytes before the anchor and after it; where a text ends sooner, any.
    """
    h = Hashes(raw)
    grams = h.every(ANCHOR)
    width = THRESHOLD - ANCHOR + 1
    # The order: 40 bits of hash, then the position, so that of equal strings the leftmost is the anchor.
    low, size = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64), 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(grams) - width + 1
    low = np.minimum(low[:n], low[width - size : width - size + n])
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    last = np.append(first[1:], n) - 1
    at = (low[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
    whole = h.of(first, last + THRESHOLD) ^ _mix((at - first).astype(np.uint64) + np.uint64(1))
    before, end = np.maximum(at - SIDE, 0), np.minimum(at + ANCHOR + SIDE, len(raw))
    sides = (h.of(before, at) >> np.uint64(48) << np.uint64(16)) | h.of(at + ANCHOR, end) >> np.uint64(48)
    return grams[at], whole, sides.astype(np.uint32), first, last


def pack(*columns: np.ndarray) -> bytes:
    """Columns as planes of their bytes, so that equal high bytes lie together."""
    return _TIGHT.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns))


def unpack(blob: bytes, n: int, kinds: list[type]) -> list[np.ndarray]:
    raw, at, out = _LOOSE.decompress(blob), 0, []
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(kind)[:, 0])
        at += n * wide
    return out


def _ordered(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """The order by keys, then doc. Most first keys are alone: only the others are compared further."""
    o = np.argsort(keys[0])
    a = keys[0][o]
    same = np.zeros(len(o) + 1, bool)
    same[1:-1] = a[1:] == a[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    own = o[tied]
    o[tied] = own[np.lexsort((doc[own], *(k[own] for k in reversed(keys))))]
    return o


def merged(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans by document, those that overlap or touch joined."""
    if not len(doc):
        return doc, twin, start, end
    o = np.lexsort((start, twin, doc))
    doc, twin, start, end = doc[o], twin[o], start[o], end[o]
    turn = np.append(True, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]))
    # Ends of earlier spans, never across documents: each document's numbers are lifted above those before.
    lift = np.cumsum(turn) * (int(end.max()) + 1)
    high = np.maximum.accumulate(end + lift)
    new = turn | np.append(True, (start + lift)[1:] > high[:-1])
    return doc[new], twin[new], start[new], np.append(high[:-1][new[1:]], high[-1]) - lift[new]


def _dealt(anchor: np.ndarray) -> np.ndarray:
    """48 bits of each anchor's hash, those first that a smallest hash does not favour: the first ones name the bucket."""
    return (anchor << np.uint64(16) & np.uint64(0xFFFFFFFF00000000)) | anchor >> np.uint64(48)


_SPAN = "doc_id long, twin long, kind int, s long, e long"


def _spans(kind: int, doc: np.ndarray, twin: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(twin.astype(np.int64)), pa.array(np.full(len(doc), kind, np.int32)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], names=["doc_id", "twin", "kind", "s", "e"])


# Rows on their way to buckets: blobs of records, or, with bucket and blob null, spans that are settled.
_DEALT = "bucket long, blob binary, n long, doc_id long, twin long, kind int, s long, e long"
_DEALT_PA = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("n", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())])


def _deal(keys: list[np.ndarray], extra: list[np.ndarray], doc: np.ndarray, twin: np.ndarray, s: np.ndarray, e: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Records sorted and sent as blobs, but for those that a smaller doc_id of the chunk makes repeated: their spans are settled."""
    o = _ordered(keys, doc)
    keys, extra, doc, twin, s, e = [k[o] for k in keys], [x[o] for x in extra], doc[o], twin[o], s[o], e[o]
    fresh = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    left = doc == doc[fresh][np.cumsum(fresh) - 1]
    if not left.all():
        b = _spans(0, *merged(doc[~left], twin[~left], s[~left], e[~left] + THRESHOLD))
        none = pa.nulls(b.num_rows)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), *b.columns], schema=_DEALT_PA)
    keys, extra, doc, twin, s, e = [k[left] for k in keys], [x[left] for x in extra], doc[left], twin[left], s[left], e[left]
    # Buckets are ranges of the first key: what is sorted by it is sorted by bucket.
    cuts = np.searchsorted(keys[0] >> np.uint64(32), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))
    s, wide = s.astype(np.uint32), (e - s).astype(np.uint8)
    rows: list[tuple[int, bytes, int]] = []
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
        at = slice(cuts[k], cuts[k + 1])
        rows.append((int(k), pack(*(x[at] for x in (*keys, *extra, doc, twin, s, wide))), int(cuts[k + 1] - cuts[k])))
    none = pa.nulls(len(rows))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64())], schema=_DEALT_PA)


def _bucket(rows: pa.Table, kinds: list[type]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The records of a bucket: keys and further columns of these kinds, doc, twin, s, e."""
    parts = [unpack(blob.as_py(), n, [*kinds, np.int64, np.int64, np.uint32, np.uint8]) for blob, n in zip(rows["blob"], rows["n"].to_pylist())]
    *cols, doc, twin, s, wide = (np.concatenate(c) for c in zip(*parts))
    return cols, doc, twin, s.astype(np.int64), s.astype(np.int64) + wide


def _settled(rows: pa.Table) -> pa.RecordBatch:
    return pa.Table.combine_chunks(rows.select(["doc_id", "twin", "kind", "s", "e"])).to_batches()[0]


def _sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in runs(_filled(batches), "bucket"):
        if bucket < 0:
            yield _settled(rows)
            continue
        (anchor, whole, sides), doc, twin, s, e = _bucket(rows, [np.uint64, np.uint64, np.uint32])
        o = _ordered([anchor, whole], doc)
        anchor, whole, sides, doc, twin, s, e = (x[o] for x in (anchor, whole, sides, doc, twin, s, e))
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))
        gone = doc != doc[fresh][np.cumsum(fresh) - 1]
        yield _spans(0, *merged(doc[gone], twin[gone], s[gone], e[gone] + THRESHOLD))
        anchor, whole, sides, doc, twin, s, e = (x[~gone] for x in (anchor, whole, sides, doc, twin, s, e))
        # Runs that agree with a different run of another document on the anchor and one side go to the next pass.
        opened = np.zeros(len(doc), bool)
        for side in (sides >> np.uint32(16), sides & np.uint32(0xFFFF)):
            o = np.lexsort((side, anchor))
            a, b = anchor[o], side[o]
            start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            if len(start):
                several = np.ones(len(start), bool)
                for x in (whole[o], doc[o]):
                    several &= np.minimum.reduceat(x, start) != np.maximum.reduceat(x, start)
                opened[o] |= np.repeat(several, np.diff(np.append(start, len(o))))
        yield _spans(1, doc[opened], twin[opened], s[opened], e[opened])


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in runs(_filled(batches), "bucket"):
        if bucket < 0:
            yield _settled(rows)
            continue
        (window, more), doc, twin, s, _ = _bucket(rows, [np.uint64, np.uint32])
        o = _ordered([window, more], doc)
        window, more, doc, twin, s = window[o], more[o], doc[o], twin[o], s[o]
        top = np.append(True, (window[1:] != window[:-1]) | (more[1:] != more[:-1]))
        gone = doc != doc[top][np.cumsum(top) - 1]
        yield _spans(0, *merged(doc[gone], twin[gone], s[gone], s[gone] + THRESHOLD))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.set_column(0, "bucket", b.column(0).fill_null(-1))


class _Gather:
    """Records of a map task, dealt when a chunk is full."""

    def __init__(self, keys: int, extra: int, buckets: int) -> None:
        self.keys, self.extra, self.buckets = keys, extra, buckets
        self.cols: list[list[np.ndarray]] = [[] for _ in range(keys + extra + 4)]
        self.held = 0

    def add(self, columns: list[np.ndarray], doc: int, twin: int, s: np.ndarray, e: np.ndarray, size: int) -> None:
        for c, x in zip(self.cols, [*columns, np.full(len(s), doc, np.int64), np.full(len(s), twin, np.int64), s, e]):
            c.append(x)
        self.held += size

    def full(self) -> bool:
        return self.held >= CHUNK

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.cols[0]:
            c = [np.concatenate(x) for x in self.cols]
            self.cols, self.held = [[] for _ in self.cols], 0
            k = self.keys + self.extra
            yield from _deal(c[: self.keys], c[self.keys : k], *c[k:], self.buckets)


def _own(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(offsets, fields) of a list of structs."""
    flat = column.flatten()
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]


def _finish(raw: bytes, spans: Iterable[tuple[int, int]]) -> tuple[int, int, int, str]:
    """(bytes, removed, maximal removed runs, SHA-256 of the rest)."""
    n, h, at, gone, count = len(raw), hashlib.sha256(), 0, 0, 0
    end = -1
    for s, e in sorted(spans):
        s, e = min(s, n), min(e, n)
        if e <= max(s, end):
            continue
        if s > end:
            h.update(raw[max(at, 0) : s])
            count += 1
            gone += e - s
        else:
            gone += e - end
        at = end = e
    h.update(raw[at:])
    return n, gone, count, h.hexdigest()


def _buckets(units: int, each: int) -> int:
    return max(LEAST, 1 << (units // each).bit_length())


def _tasks(total: int) -> int:
    """Tasks that texts of so many bytes need at least, so that one's records fit in memory whatever the input."""
    return -(-total // TASK)


def _fewer(df: DataFrame, total: int) -> DataFrame:
    """df in a quarter of the partitions of a shuffle, three for each core and one for each TASK bytes of all texts at least: fewer files, each of which makes the JVM fork twice."""
    spark = df.sparkSession
    return df.coalesce(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, _tasks(total)))


def _kept(df: DataFrame, total: int) -> DataFrame:
    """written(), in few files and with small Arrow batches."""
    with small_batches(df.sparkSession):
        return written(_fewer(df, total))


_DONE = "doc_id long, twin long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _repeats(docs, id_col, text_col)[0]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The removed byte ranges, unmerged: doc_id, s, e (a document's may overlap)."""
    return _repeats(docs, id_col, text_col)[1]


def _identified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, twin, text) of all rows, null ids as LAST, and of all different rows; the bytes of all texts.

    Texts are joined with the ids that several rows have only if there are such ids; only rows without an id and rows of
    such ids are made different.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = spread(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text")))
    per = written(src.groupBy("doc_id").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    null = F.col("doc_id") == LAST
    some = per.agg(F.sum("bytes"), F.max(F.when(null, 1)), F.max(F.when(~null & (F.col("n") > 1), 1))).first()
    again, parted = null, null
    if some[2]:
        src = src.join(per.where(~null & (F.col("n") > 1)).select("doc_id", (F.col("low") != F.col("high")).alias("parted")), "doc_id", "left")
        again, parted = null | F.col("parted").isNotNull(), null | F.coalesce("parted", F.lit(False))
    rows = src.select("doc_id", F.when(parted, F.col("own")).otherwise(F.lit(0).cast("long")).alias("twin"), "text", again.alias("again"))
    every = rows.select("doc_id", "twin", "text")
    if not some[1] and not some[2]:
        return every, every, some[0] or 0
    once = rows.where("again").groupBy("doc_id", "twin").agg(F.min("text").alias("text"))
    return every, rows.where("not again").select("doc_id", "twin", "text").union(once), some[0] or 0


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    src, unique, total = _identified(docs, id_col, text_col)
    buckets = _buckets(total, BUCKET)
    row = ["doc_id", "twin"]

    def deal_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Gather(2, 1, buckets)
        for b in batches:
            for doc, twin, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = t.as_py().encode("utf-8", "replace")
                if len(raw) >= THRESHOLD:
                    for at, part in pieces(raw):
                        anchor, whole, sides, s, e = anchored_runs(part)
                        got.add([_dealt(anchor), whole & np.uint64(0xFFFFFFFFFFFF), sides], doc, twin, s + at, e + at, len(part))
                if got.full():
                    yield from got.flush()
        yield from got.flush()

    def sorted_by_bucket(dealt: DataFrame) -> DataFrame:
        by = "bucket", F.coalesce("doc_id", F.lit(0))
        tasks = _tasks(total)
        spread_out = dealt.repartition(tasks, *by) if tasks > int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")) else dealt.repartition(*by)
        return spread_out.sortWithinPartitions("bucket")

    found = _kept(sorted_by_bucket(unique.mapInArrow(deal_runs, _DEALT)).mapInArrow(_sort_runs, _SPAN), total)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without open runs are finished; the others keep their text."""
        for b in batches:
            at, (kind, s, e) = _own(b.column(3))
            rows, kept = [], []
            for i, t in enumerate(b.column(2)):
                own = slice(at[i], at[i + 1])
                opened = bool(kind[own].any())
                kept.append(i if opened else None)
                rows.append((None,) * 4 if opened else _finish(t.as_py().encode("utf-8", "replace"), zip(s[own].tolist(), e[own].tolist())))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kept = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).take(kept).cast(pa.string()), b.column(3).take(kept).cast(_FIRST.field(3).type), *(pa.array(c, f.type) for c, f in zip(cols, list(_FIRST)[4:]))], schema=_FIRST)

    # A list is as long as one text has runs: equal rows dealt theirs once.
    spans = found.groupBy(*row).agg(F.collect_list(F.struct("kind", "s", "e")).alias("own"))
    state = _kept(unique.join(spans, row, "left").select(*row, "text", "own").mapInArrow(first, "doc_id long, twin long, text string, own array<struct<kind:int,s:long,e:long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), total)
    window_buckets = _buckets(found.where("kind = 1").agg(F.sum(F.expr("e - s + 1"))).first()[0] or 0, WINDOWS)
    opened = state.where("own is not null").select(*row, "text", "own")

    def deal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _Gather(2, 0, window_buckets)
        for b in batches:
            offsets, (kind, starts, ends) = _own(b.column(3))
            for i, (doc, twin, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                raw = t.as_py().encode("utf-8", "replace")
                own = np.arange(offsets[i], offsets[i + 1])
                own = own[kind[own] == 1]
                lows, highs = starts[own], ends[own]
                for at, part in pieces(raw):
                    n = len(part) - THRESHOLD + 1
                    mark = np.zeros(n + 1, np.int64)
                    inside = (lows >= at) & (lows < at + n)
                    np.add.at(mark, lows[inside] - at, 1)
                    np.add.at(mark, np.minimum(highs[inside] - at + 1, n), -1)
                    s = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    if len(s):
                        two = [Hashes(part, k).of(s, s + THRESHOLD) for k in range(2)]
                        got.add([two[0], (two[1] >> np.uint64(32)).astype(np.uint32)], doc, twin, s + at, s + at, 24 * len(s))
                if got.full():
                    yield from got.flush()
        yield from got.flush()

    more = _kept(sorted_by_bucket(opened.mapInArrow(deal_windows, _DEALT)).mapInArrow(_sort_windows, _SPAN), total)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (at, (kind, s, e)), (to, (ns, ne)) = _own(b.column(3)), _own(b.column(4))
            rows = []
            for i, t in enumerate(b.column(2)):
                own, new = np.arange(at[i], at[i + 1]), slice(to[i], to[i + 1])
                own = own[kind[own] == 0]
                rows.append(_finish(t.as_py().encode("utf-8", "replace"), [*zip(s[own].tolist(), e[own].tolist()), *zip(ns[new].tolist(), ne[new].tolist())]))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(_FINAL)[2:]))], schema=_FINAL)

    added = more.groupBy(*row).agg(F.collect_list(F.struct("s", "e")).alias("new"))
    rest = opened.join(added, row, "left").select(*row, "text", "own", "new").mapInArrow(last, _DONE)
    out = state.where("own is null").select(*row, "n_bytes", "n_removed", "n_spans", "kept_sha256").union(rest)
    if unique is not src:  # a result for every row again
        out = src.select(*row).join(out, row)
    out = out.drop("twin")
    null = F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id")
    both = found.where("kind = 0").union(more).select(null, "s", "e")
    return _fewer(out.withColumn("doc_id", null), total), both


_FINAL = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_FIRST = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("text", pa.string()), ("own", pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))), *list(_FINAL)[2:]])
