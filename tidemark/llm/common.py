"""What the operators share: tables, written intermediate results, and link components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D]; words are runs of other bytes, which is what bytes.split() gives.
WHITE = b" \t\n\x0b\x0c\r"

SMALL = 32 << 20
#: Spark's own setting: shuffle files are deleted when the execution that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is small (SMALL bytes a core) and lies in fewer files than there are cores.

    A file of one row group is one task, and with Python in it, one busy core. Larger tables stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL * cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests) gets one of its own; a cluster is an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _local()


@lru_cache(1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, outlives lost executors, is deleted by release() or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    with settings(spark, CLEANUP, "true"):  # nothing reads its shuffles once it is written
        df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every written() table. For drivers that live long: call it when the results built so far are stored or no longer needed."""
    while _written:
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(*_written.pop())


def discard(df: DataFrame) -> None:
    """Delete the table of a written() result that nothing reads any more."""
    for spark, path in [x for x in _written if any(f.startswith(x[1]) for f in df.inputFiles()[:1])]:
        _delete(spark, path)
        _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def settings(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while the steps inside run."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "8m") -> contextlib.AbstractContextManager[None]:
    """Arrow batches of at most size while the steps inside run: rows with whole sets or vectors are large."""
    return settings(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows whose crc32 of the id as text is divisible by 5; labels of those rows are never learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most per_class training rows of each label, taken in the order of a hash of doc_id.

    An id counts once: of several labels the smallest, of several texts the smallest. The join broadcasts ids and labels of
    the sample only, at most 2 * per_class rows whatever the input.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64("doc_id", F.lit(17))
    picked = None
    for value in (0, 1):
        part = own.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.select("doc_id", "text", "label").repartition(docs.sparkSession.sparkContext.defaultParallelism)


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every id in links (a, b), both bigint: component is the smallest id reachable.

    Alternating large-star and small-star contraction: each round links every id to the smallest of its
    neighbourhood, first its larger neighbours, then the smaller ones; minima are partial aggregates, so a hub's
    neighbours are never gathered, and the rounds grow as the logarithm of the longest path. Each round is written
    to the shared folder. The only thing brought to the driver is one checksum row a round.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = e.join(low, "a")
        if large:
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return out.select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a > b").distinct()

    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    seen = e.agg(*sums).first()
    if seen["n"]:
        for _ in range(rounds):
            new = written(star(star(e, True), False))
            now = new.agg(*sums).first()
            discard(e)
            e = new
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def stand_in(own: Column, top: Column) -> Column:
    """The id of a group of rows: its own, or, if none of its rows has one, a number above top, the largest id there is.

    Such numbers take part in links like ids; as they are larger than all ids, a component with any id is named by one.
    For tables that are written at once: a number is not the same when it is made again.
    """
    return F.coalesce(own, F.try_add(F.coalesce(top, F.lit(-1)) + F.lit(1), F.monotonically_increasing_id()))


def real_id(number: Column, top: Column) -> Column:
    """Null for a stand-in."""
    return F.when(number <= top, number)


def runs(batches: Iterator[pa.RecordBatch], key: str = "g") -> Iterator[tuple[object, pa.Table]]:
    """(key, rows) for each run of equal keys in a sorted partition, across its batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cuts, cuts[1:]):
            if held and k[i] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = k[i]
    if held:
        yield last, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "g", rows: int = 1 << 14) -> Iterator[pa.Table]:
    """The rows of a sorted partition in tables of about ``rows`` rows that cut no run of equal keys; a longer run is a table of its own."""
    held: list[pa.Table] = []
    n = 0
    for _, t in runs(batches, key):
        if held and n + t.num_rows > rows:
            yield pa.concat_tables(held)
            held, n = [], 0
        held.append(t)
        n += t.num_rows
    if held:
        yield pa.concat_tables(held)


def blocked(rows: DataFrame, key: Column, size: Column, of: Column, most: int) -> DataFrame:
    """rows with the group column g: all pairs of a bucket meet in some group, and no group has much over 2 * most rows.

    A bucket of ``size`` rows is cut by a hash of ``of`` into k = size / most blocks, and each row goes to the k groups
    (its block, another block); the columns own and other tell them apart (equal in the group of one block).
    """
    k = F.greatest(F.lit(1), F.ceil(size / most)).cast("int")
    mine = F.pmod(F.xxhash64(of, F.lit(3)), k).cast("int")
    dealt = rows.withColumns({"own": mine, "other": F.explode(F.sequence(F.lit(0), k - 1))})
    return dealt.withColumn("g", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
