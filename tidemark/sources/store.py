"""Frozen streams: snapshots of a table of items by shard, each with a manifest that is put in its place last.

A stream lies in numbered folders below ``snapshots``. Its readers take the newest that has a manifest, so while a stream is written
anew, and if that fails, they go on with the one before. That one is kept until the next but one is finished, for those
who are still reading it.
"""

from __future__ import annotations

import dataclasses
import json
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import StreamConfig, parse

SHARD = 10_000


class StreamNotFound(FileNotFoundError):
    """No manifest: there is no stream there, or its writer did not finish."""


def shard_path(idx: Column, shard: int = SHARD) -> Column:
    return F.format_string("crops/%05d/%08d.png", F.floor(idx / shard), idx)


def _file(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(data))
    out.close()


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


#: Tables that may stand beside the items: the label space, the resolved schedule, and what arrived.
BESIDE = ("registry", "schedule", "arrival")


def _numbers(spark: SparkSession, path: str) -> dict[int, bool]:
    """The snapshots of a stream and whether each is finished."""
    fs, at = _file(spark, f"{path}/snapshots")
    found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    return {int(p.getName()): fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "manifest.json")) for p in found if p.getName().isdigit()}


def _folder(path: str, number: int) -> str:
    return f"{path}/snapshots/{number:08d}"


def snapshot_of(spark: SparkSession, path: str, number: int | None = None) -> str:
    """The folder of the newest finished snapshot, or of one by number."""
    done = [n for n, finished in _numbers(spark, path).items() if finished and number in (None, n)]
    if not done:
        raise StreamNotFound(f"no finished stream at {path}" if number is None else f"no finished snapshot {number} at {path}")
    return _folder(path, max(done))


def begin_stream(spark: SparkSession, path: str) -> str:
    """The folder of a new snapshot, which nobody else writes."""
    number = max(_numbers(spark, path), default=-1) + 1
    while True:
        fs, at = _file(spark, f"{_folder(path, number)}/claim")
        try:
            fs.create(at, False).close()
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            number += 1
        else:
            return _folder(path, number)


def write_stream(items: DataFrame, path: str, shard: int = SHARD, **facts: object) -> dict:
    """Write items (idx, label, ...) as a new snapshot and then its manifest, which is returned.

    Rows with an error are kept beside the others as what was skipped. facts go into the manifest, but for the DataFrames
    of BESIDE, which become tables; ``config``, a StreamConfig, is written out. items may be read from the stream itself.
    """
    folder = begin_stream(items.sparkSession, path)
    append_items(items, folder, shard)
    return finish_stream(items.sparkSession, folder, shard, None, **facts)


def append_items(items: DataFrame, folder: str, shard: int = SHARD) -> dict[str, int]:
    """Write items by shard into a snapshot that is begun; what was seen on the way: n of them, errors among them."""
    own = items.withColumn("shard", F.floor(F.col("idx") / shard))
    if "error" not in items.columns:
        own = own.withColumn("error", F.lit(None).cast("string"))
    seen = Observation("items")
    own.observe(seen, F.count(F.lit(1)).alias("n"), F.count("error").alias("errors")).write.mode("append").partitionBy("shard").parquet(f"{folder}/items")
    return seen.get


def finish_stream(spark: SparkSession, folder: str, shard: int = SHARD, most: int | None = None, **facts: object) -> dict:
    """The tables beside the items of a snapshot, and its manifest last. most: the stream ends with that many items; later ones don't count."""
    items = spark.read.parquet(f"{folder}/items")
    last = None
    if most is not None and (end := items.where("error is null").select("idx").orderBy("idx").limit(most).agg(F.max("idx")).first()[0]) is not None:
        last, items = end, items.where(F.col("idx") <= end)
    items.where("error is null").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first")).write.mode("overwrite").parquet(f"{folder}/labels")
    one = spark.read.parquet(f"{folder}/labels").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).first()
    for name in BESIDE:
        if isinstance(table := facts.pop(name, None), DataFrame):
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    config = facts.pop("config", None)
    manifest = {
        "created": datetime.now(UTC).isoformat(timespec="seconds"), "n_items": one["n"] or 0, "n_labels": one["labels"], "n_skipped": items.where("error is not null").count(), "shard_size": shard, "last_idx": last,
        "config": dataclasses.asdict(config) if config is not None else None, **facts,
    }
    _put(spark, f"{folder}/manifest.begun", json.dumps(manifest, indent=1).encode())
    fs, begun = _file(spark, f"{folder}/manifest.begun")
    if not fs.rename(begun, _file(spark, f"{folder}/manifest.json")[1]):
        raise OSError(f"cannot put the manifest of {folder} in its place")
    _prune(spark, folder)
    return manifest


def _prune(spark: SparkSession, folder: str) -> None:
    """Delete the snapshots before the one that this one follows, finished or not."""
    path, own = folder.rsplit("/snapshots/", 1)
    numbers = _numbers(spark, path)
    before = [n for n, finished in numbers.items() if finished and n < int(own)]
    for n in numbers:
        if before and n < max(before):
            _drop(spark, _folder(path, n))


def _manifest(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])


def read_manifest(spark: SparkSession, path: str, snapshot: int | None = None) -> dict:
    return _manifest(spark, snapshot_of(spark, path, snapshot))


def read_config(spark: SparkSession, path: str) -> StreamConfig:
    """The configuration that a stream was drawn with."""
    found = read_manifest(spark, path)["config"]
    if found is None:
        raise StreamNotFound(f"the stream at {path} has no configuration")
    return parse(found)


def read_beside(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table registry, schedule or arrival of a finished stream."""
    folder = snapshot_of(spark, path)
    fs, at = _file(spark, f"{folder}/{name}")
    if name not in BESIDE or not fs.exists(at):
        raise StreamNotFound(f"the stream at {path} has no table {name}")
    return spark.read.parquet(f"{folder}/{name}")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The label space that a stream was drawn from."""
    return read_beside(spark, path, "registry")


def _all(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    folder = snapshot_of(spark, path, snapshot)
    last = _manifest(spark, folder).get("last_idx")
    items = spark.read.parquet(f"{folder}/items")
    return items if last is None else items.where(F.col("idx") <= last)


def read_stream(spark: SparkSession, path: str, limit: int | None = None, snapshot: int | None = None) -> DataFrame:
    """The items of a finished stream, in order; of its newest snapshot, or of one by number."""
    items = _all(spark, path, snapshot).where("error is null").drop("error").orderBy("idx")
    return items.limit(limit) if limit is not None else items


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    """idx, label, error of the items that were skipped."""
    return _all(spark, path).where("error is not null").select("idx", "label", "error")


def read_annotations(spark: SparkSession, path: str, schema: str = "index long, label string, image string, meta string") -> DataFrame:
    """Line-wise JSON records; blank lines are skipped. meta is the record's own JSON text."""
    return spark.read.schema(schema).json(path)


def write_annotations(items: DataFrame, path: str, shard: int = SHARD) -> None:
    """A record for each item: index, label, the path of its image, and its metadata (a JSON text in the column meta)."""
    if "error" in items.columns:
        items = items.where("error is null")
    head = F.to_json(F.struct(F.col("idx").alias("index"), "label", shard_path(F.col("idx"), shard).alias("image")))
    meta = F.coalesce("meta", F.lit("{}")) if "meta" in items.columns else F.lit("{}")
    items.select(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"meta":'), meta, F.lit("}")).alias("value")).write.text(path)


def annotated_images(spark: SparkSession, annotations: str, folder: str) -> DataFrame:
    """idx, label, meta, content of annotated image files below a folder, in order; an annotation without its file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "(crops/.*)$", 1).alias("image"), "content")
    both = read_annotations(spark, annotations).join(files, "image", "left")
    content = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no image file "), "image"))).otherwise(F.col("content"))
    return both.select(F.col("index").alias("idx"), "label", "meta", content.alias("content")).orderBy("idx")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, rgb (bytes, row by row) of the PNG files below a folder."""
    found = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").option("dropInvalid", True).load(folder)
    return found.where("image.nChannels in (1, 3, 4)").select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), _rgb("image.nChannels", "image.data").alias("rgb"))


@F.pandas_udf(T.BinaryType())
def _rgb(channels: pd.Series, data: pd.Series) -> pd.Series:
    """Spark decodes to blue, green, red (and alpha), or grey alone."""
    own = (np.frombuffer(d, np.uint8).reshape(-1, n) for n, d in zip(channels, data))
    return pd.Series([(np.repeat(x, 3, 1) if x.shape[1] == 1 else x[:, 2::-1]).tobytes() for x in own], index=data.index)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """path, actual: SHA-256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("actual"))
