"""Exact dedup by composable polynomial fingerprints.

A text is normalised by deleting ASCII white space and cut into chunks. A chunk's hash is its bytes as a base-256
number modulo two primes; hashes of neighbouring chunks combine by shifting the left one by the length of the right
one, so parts can be hashed apart and in any grouping. Texts of HUGE bytes or more are cut into pieces that different
tasks hash; their hashes are combined afterwards. All fingerprints (two residues and the length) are written once.

Documents of equal fingerprints form a group. The texts of groups of two or more are then compared chunk by chunk: for
each chunk number of a group the smallest and the largest chunk must be the same bytes. Both are partial aggregates, so
a third of all rows being copies of one text costs one row a task, and no pair of documents is ever formed. A group
whose texts differ after all, a collision of the fingerprints, is split by SHA-256. Texts that have no partner are not
read further than their hash: a bitmap of the groups to compare, of BITS bits whatever the input, tells them apart; where
it errs a text is compared in vain.

Defined cases: a null text counts as empty; empty and white-space-only texts form one group. Of equal texts the row
with most code points in the original stays, then the smallest doc_id. A repeated row has its own result row, equal to
its twin's (doc_id is the identity: both carry the same ``kept``). A null doc_id never wins against another id, however
long its original, and such a row is kept only if its group holds no other id. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, spread, written

#: The largest primes under 2**63 and 2**62.
PRIMES = (2**63 - 25, 2**62 - 57)
CHUNK = 1 << 16
#: Bytes from which a text is hashed in pieces by several tasks, and the bytes of a piece.
HUGE, PIECE = 32 << 20, 1 << 20
#: Bits of the map of groups to compare (8 MB), a multiple of the 32,768 of a built-in bitmap.
BITS = 1 << 26

Hash = tuple[int, int, int]
KEY = ["h1", "h2", "n_norm"]


@lru_cache(1 << 12)
def _shift(n: int, prime: int) -> int:
    return pow(256, n, prime)


def chunk_hash(data: bytes, primes: tuple[int, int] = PRIMES) -> Hash:
    """(residue, residue, length) of one chunk."""
    x = int.from_bytes(data, "big")
    return x % primes[0], x % primes[1], len(data)


def combine(a: Hash, b: Hash, primes: tuple[int, int] = PRIMES) -> Hash:
    """The hash of two texts in a row from theirs; associative, with (0, 0, 0) as its neutral element."""
    return (a[0] * _shift(b[2], primes[0]) + b[0]) % primes[0], (a[1] * _shift(b[2], primes[1]) + b[1]) % primes[1], a[2] + b[2]


def fingerprint(data: bytes, chunk: int = CHUNK, primes: tuple[int, int] = PRIMES) -> Hash:
    h = 0, 0, 0
    for i in range(0, len(data), chunk):
        h = combine(h, chunk_hash(data[i : i + chunk], primes), primes)
    return h


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(None, WHITE)


_FP = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_norm", pa.int64()), ("sha", pa.binary()), ("mark", pa.int64())])
_FP_DDL = "doc_id long, n_chars long, h1 long, h2 long, n_norm long, sha binary, mark long"
_CHUNKS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_norm", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
_CHUNKS_DDL = "h1 long, h2 long, n_norm long, part long, data binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _mark(h: int) -> int:
    return h >> 1  # 63 bits: a bigint that is not negative


def _prints(primes: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, large in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                if large:
                    rows.append((i, *[None] * 6))
                    continue
                text = t.as_py()
                data = normalise(text)
                rows.append((i, len(text or ""), *fingerprint(data, CHUNK, primes), hashlib.sha256(data).digest(), _mark(xxhash.xxh3_64_intdigest(data))))
            yield _batch(rows, _FP)

    return run


def _huge_prints(big: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """Fingerprints (_FP) of huge texts (doc_id, text): pieces are hashed apart; SHA-256, which does not combine, reads them in order."""
    # Numbered before they are cut, and written: both readings below must see the same numbers.
    rows = big.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.encode("text", "UTF-8").alias("raw"))
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / PIECE).cast("int"))))
    pieces = written(parts.select("row", "doc_id", "n_chars", "part", F.substring("raw", F.col("part") * PIECE + 1, F.lit(PIECE)).alias("raw")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(x.as_py().translate(None, WHITE), CHUNK, primes) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (list(zip(*got)) or [[]] * 3))], names=["row", "part", *KEY])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column(1).to_pylist():
                h = 0, 0, 0
                for p in own:
                    h = combine(h, (p["h1"], p["h2"], p["n_norm"]), primes)
                out.append(h)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 3))], names=["row", *KEY])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, mark, about, rows = None, None, None, (), []
        for b in batches:
            for row_id, doc, n, _, x in zip(*(b.column(k) for k in range(5))):
                if (row_id := row_id.as_py()) != last:
                    if last is not None:
                        rows.append((last, *about, sha.digest(), _mark(mark.intdigest())))
                    last, sha, mark, about = row_id, hashlib.sha256(), xxhash.xxh3_64(), (doc.as_py(), n.as_py())
                data = x.as_py().translate(None, WHITE)
                sha.update(data)
                mark.update(data)
        if last is not None:
            rows.append((last, *about, sha.digest(), _mark(mark.intdigest())))
        yield _batch(rows, pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary()), ("mark", pa.int64())]))

    key = ", ".join(f"{c} long" for c in KEY)
    apart = pieces.select("row", "part", "raw").repartition("row", "part").mapInArrow(hashed, f"row long, part int, {key}")
    whole = apart.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", *KEY))).alias("own")).mapInArrow(combined, f"row long, {key}")
    order = pieces.repartition("row").sortWithinPartitions("row", "part").mapInArrow(digests, "row long, doc_id long, n_chars long, sha binary, mark long")
    return order.join(whole, "row").select("doc_id", "n_chars", *KEY, "sha", "mark")


def _chunks(bits: np.ndarray, primes: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chunks of texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for t in b.column(0):
                data = normalise(t.as_py())
                at = _mark(xxhash.xxh3_64_intdigest(data)) % BITS
                if not bits.value[at >> 3] >> (at & 7) & 1:
                    continue
                key = fingerprint(data, CHUNK, primes)
                for part, i in enumerate(range(0, len(data), CHUNK)):
                    rows.append((*key, part, data[i : i + CHUNK]))
                    held += min(CHUNK, len(data) - i)
                    if held > 16 << 20:
                        yield _batch(rows, _CHUNKS)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, _CHUNKS)

    return run


def _bitmap(groups: DataFrame) -> np.ndarray:
    """One bit for each mark modulo BITS, built on the executors; at most BITS / 8 bytes reach the driver."""
    at = F.pmod("mark", F.lit(BITS)) + 1  # the built-in bitmaps count positions and buckets from 1
    got = groups.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in got:
        start = (r["k"] - 1) * 4096
        out[start : start + 4096] |= np.frombuffer(r["bits"], np.uint8)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_norm_bytes."""
    spark = docs.sparkSession
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    large = F.coalesce(F.octet_length("text") >= huge, F.lit(False))
    prints = written(src.select("doc_id", F.when(~large, F.col("text")).alias("text"), large.alias("large")).mapInArrow(_prints(primes), _FP_DDL))
    if not prints.where("h1 is null").isEmpty():  # huge texts, left out so far
        prints = written(prints.where("h1 is not null").union(_huge_prints(src.where(large), primes)))

    # The best row: one with an id before those without, then by length, then by id.
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "n_chars", (-F.col("doc_id")).alias("neg"))).alias("best")
    groups = written(prints.groupBy(*KEY).agg(best, F.count(F.lit(1)).alias("group_size"), F.min("mark").alias("mark"), F.max("mark").alias("other")).where("group_size > 1"))
    differ = groups.where("mark <> other").select(*KEY)
    bits = spark.sparkContext.broadcast(_bitmap(groups.where("mark = other")))
    chunks = src.select("text").mapInArrow(_chunks(bits, primes), _CHUNKS_DDL).groupBy(*KEY, "part").agg(F.min("data").alias("low"), F.max("data").alias("high"))
    split = written(differ.union(chunks.where("low <> high").select(*KEY)).distinct())

    if split.isEmpty():
        own = prints.join(groups.select(*KEY, "best", "group_size"), KEY, "left")
    else:  # fingerprints that collide: SHA-256 parts their texts
        marked = prints.join(split.withColumn("parted", F.lit(True)), KEY, "left").withColumn("by", F.when(F.col("parted"), F.col("sha")).otherwise(F.lit(b"")))
        again = marked.groupBy(*KEY, "by").agg(best, F.count(F.lit(1)).alias("group_size"))
        own = marked.join(again, [*KEY, "by"])
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(-F.col("best.neg"))
    return own.withColumn("keep_id", keep).select(
        "doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("n_norm").alias("n_norm_bytes")
    )
