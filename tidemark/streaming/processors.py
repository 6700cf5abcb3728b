"""The stream operators as Structured Streaming queries, equal to their batch forms on a whole stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.models.registry import Recognizer
from tidemark.operators import ordered
from tidemark.operators.scoring import WINDOW


Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def last_seen(batch: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(idx, label, pred) of a batch (stream_id, idx, label); kept is the last row of each stream.

    The kept rows go before the batch, and the batch form of the operator does the rest: a stream in one batch is spread
    over tasks like a table.
    """
    rows = batch.select("stream_id", "idx", "label", F.lit(True).alias("new"))
    if kept is not None:
        rows = rows.union(kept.select("stream_id", "idx", "label", F.lit(False)))
    out = ordered.latest(rows, "label", "pred", keys=("stream_id",)).where("new").select("idx", "label", "pred")
    return out, rows.groupBy("stream_id").agg(F.max("idx").alias("idx"), F.max_by("label", "idx").alias("label"))


def novelty(batch: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(idx, label, n_seen) of the first row of each label, per stream; kept is the first row of every label so far."""
    first = batch.groupBy("stream_id", "label").agg(F.min("idx").alias("idx"))
    if kept is not None:
        first = first.join(kept.select("stream_id", "label"), ["stream_id", "label"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("idx"))
    own = first.withColumn("rank", rank)
    if kept is None:
        out = own.withColumn("n_seen", F.col("rank").cast("long"))
    else:
        before = kept.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
        out = own.join(before, "stream_id", "left").withColumn("n_seen", F.col("rank") + F.coalesce("n", F.lit(0)))
    every = first.select("stream_id", "label", "idx")
    return out.select("idx", "label", "n_seen"), every if kept is None else every.union(kept.select("stream_id", "label", "idx"))


def majority(batch: DataFrame, kept: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(idx, label, pred) of a batch of one stream: the most frequent earlier label, the earliest seen on ties; kept is a count and first idx of every label."""
    own = batch.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    rows = batch.select("idx", "label")
    every = own if kept is None else own.union(kept.select("label", "n", "first")).groupBy("label").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = lambda n: F.struct(n.alias("n"), (-F.col("first")).alias("neg"), "label")
    counted = ordered.carried(rows, F.lit(1), F.sum, ordered.add, "rn", keys=("label",)).join(every.select("label", "first"), "label")
    before = F.lit(None).cast("struct<n:bigint,neg:bigint,label:string>")
    if kept is not None:
        counted = counted.join(kept.select("label", F.col("n").alias("n0")), "label", "left").withColumn("rn", F.col("rn") + F.coalesce("n0", F.lit(0)))
        before = kept.agg(F.max(best(F.col("n")))).scalar()
    out = ordered.carried(counted.withColumn("best", best(F.col("rn").cast("long"))), F.col("best"), F.max, ordered.larger, "top", exclusive=True)
    return out.select("idx", "label", ordered.larger(F.col("top"), before)["label"].alias("pred")), every


def run_steps(spark: SparkSession, stream: DataFrame, step: Step, path: str) -> DataFrame:
    """The rows that a step makes of all batches that there are now, written under path (a folder that all executors share).

    A batch reads what the one before kept and writes its rows and what it keeps under its own number, so a batch that is
    run again after a loss replaces its own.
    """

    def one(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        kept = own.read.parquet(f"{path}/kept/{number - 1}") if number else None
        out, keep = step(batch, kept)
        out.write.mode("overwrite").parquet(f"{path}/out/{number}")
        keep.write.mode("overwrite").parquet(f"{path}/kept/{number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/out")


def rolling_accuracy(batch: DataFrame, kept: DataFrame | None, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(idx, accuracy) of predictions (idx, label, pred) of one stream over the last rows; kept is one row less than the window.

    The kept rows go before the batch; ranks and windows are those of a table, so a batch is spread over tasks by blocks.
    """
    rows = batch.select("idx", F.coalesce(F.col("label") == F.col("pred"), F.lit(False)).cast("double").alias("hit"), F.lit(True).alias("new"))
    if kept is not None:
        rows = rows.union(kept.select("idx", "hit", F.lit(False)))
    own = ordered.rolling_mean(ordered.ranked(rows, "idx", "place"), F.col("hit"), window, "accuracy", idx="place")
    return own.where("new").select("idx", "accuracy"), rows.orderBy(F.desc("idx")).limit(window - 1).select("idx", "hit")


def recognized(stream: DataFrame, model: Callable[[], Recognizer]) -> DataFrame:
    """idx, label, pred of a plug-in model over a stream (stream_id, idx, label, features).

    State is the model itself, one a stream, as long as it has learned: nearest neighbours with their scaler, replay
    buffers with their weights. Rows of a batch are taken in the order of idx, each answered before its label is learned.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = cloudpickle.loads(bytes(state.get[0])) if state.exists else model()
        rows = pd.concat(list(parts)).sort_values("idx")
        preds = own.answers(list(rows["features"]), list(rows["label"]))
        state.update((cloudpickle.dumps(own),))
        yield rows[["idx", "label"]].assign(pred=pd.Series(preds, index=rows.index, dtype=object))

    return stream.groupBy("stream_id").applyInPandasWithState(step, "idx long, label string, pred string", "model binary", "append", "NoTimeout")


def run_now(spark: SparkSession, streaming: DataFrame, path: str) -> DataFrame:
    """The rows of a streaming query over what there is now, written under path (a folder that all executors share)."""
    out, marks = f"{path}/out", f"{path}/checkpoint"
    streaming.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streaming.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one stream: stream_id, idx, label."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern, so that the table may be one file as well as a folder of them.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(F.lit("events").alias("stream_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("label"))
