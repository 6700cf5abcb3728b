"""Scores of predictions over a stream: confusion in long form, per-class and overall metrics, learning curve.

An abstention is the predicted value ABSTAIN, never a true label; so are answers outside the label space. Ratios
without a denominator are 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import majority, ranked, rolling_mean

ABSTAIN, WINDOW, CURVE_EVERY = "∅", 500, 100


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(preds: DataFrame) -> DataFrame:
    """true, predicted, n, first_idx of preds (idx, label, pred)."""
    return preds.groupBy(F.col("label").alias("true"), F.coalesce("pred", F.lit(ABSTAIN)).alias("predicted")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))


def by_class(matrix: DataFrame) -> DataFrame:
    """label, support, correct, predicted, recall, precision, f1 of the true labels."""
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0).alias("correct"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("correct"), F.col("n").alias("predicted")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "correct", "predicted"))).where("support > 0")
    return sums.withColumns({"recall": ratio(F.col("correct"), F.col("support")), "precision": ratio(F.col("correct"), F.col("predicted")), "f1": ratio(2 * F.col("correct"), F.col("support") + F.col("predicted"))})


def overall(matrix: DataFrame) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy, macro_f1, n_labels, chance."""
    return by_class(matrix).agg(
        F.sum("support").alias("n"), F.round(ratio(F.sum("correct"), F.sum("support")), 9).alias("accuracy"), F.round(F.avg("recall"), 9).alias("balanced_accuracy"),
        F.round(F.avg("f1"), 9).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"), F.round(1 / F.count(F.lit(1)), 9).alias("chance"))


def classes(preds: DataFrame, window: int = WINDOW) -> DataFrame:
    """by_class of preds with recent_recall (null where a label is not among the last rows), most frequent labels first, then by first appearance."""
    m = confusion(preds)
    now = by_class(confusion(recent(preds, window))).select("label", F.col("recall").alias("recent_recall"))
    first = m.groupBy(F.col("true").alias("label")).agg(F.min("first_idx").alias("first_idx"))
    return by_class(m).join(first, "label").join(now, "label", "left").orderBy(F.desc("support"), "first_idx")


def headline(preds: DataFrame, common: DataFrame, window: int = WINDOW) -> DataFrame:
    """measure, overall, recent: the scores over all and over the last rows, and those of answering the commonest label (common: its predictions) and of chance."""
    one, now = overall(confusion(preds)), overall(confusion(recent(preds, window)))
    common = overall(confusion(common)).select(F.lit(1).alias("k"), F.col("accuracy").alias("common"))
    both = one.withColumn("k", F.lit(1)).join(now.select(F.lit(1).alias("k"), *(F.col(c).alias("recent_" + c) for c in ("accuracy", "balanced_accuracy", "macro_f1"))), "k").join(common, "k")
    lift = F.when(F.col("common") == 0, float("inf")).otherwise(F.round(F.col("accuracy") / F.col("common"), 9))
    none = F.lit(None).cast("double")
    rows = [(c, F.col(c), F.col("recent_" + c)) for c in ("accuracy", "balanced_accuracy", "macro_f1")] + [("majority", F.col("common"), none), ("chance", F.col("chance"), none), ("lift", lift, none)]
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), a.alias("overall"), b.alias("recent")) for n, a, b in rows))).alias("x")).select("x.*")


class Result(NamedTuple):
    """Everything about predictions in order: as tables, none of them computed yet."""

    headline: DataFrame
    classes: DataFrame
    confusion: DataFrame
    curve: DataFrame


def result(preds: DataFrame, window: int = WINDOW, every: int = CURVE_EVERY) -> Result:
    """The Result of preds (idx, label, pred); windows count rows, so gaps in idx don't matter."""
    own = ranked(preds.select("idx", "label", "pred"), "idx", "rank").select(F.col("rank").alias("idx"), "label", "pred")
    return Result(headline(own, majority(own.select("idx", "label")), window), classes(own, window), confusion(own), curve(own, every, window))


def worst(matrix: DataFrame, k: int = 10) -> DataFrame:
    """The k largest wrong cells: by count, then by the first appearance of the true label and of the pair."""
    first = matrix.groupBy("true").agg(F.min("first_idx").alias("first_true"))
    return matrix.where(F.col("true") != F.col("predicted")).join(first, "true").orderBy(F.desc("n"), "first_true", "first_idx").limit(k).select("true", "predicted", "n")


def recent(preds: DataFrame, window: int = WINDOW) -> DataFrame:
    """The last rows of preds, by idx."""
    return preds.orderBy(F.desc("idx")).limit(window)


def rolling(preds: DataFrame, window: int = WINDOW) -> DataFrame:
    """idx, accuracy over the last rows."""
    return rolling_mean(preds, F.coalesce(F.col("label") == F.col("pred"), F.lit(False)).cast("double"), window, "accuracy").select("idx", F.round("accuracy", 9).alias("accuracy"))


def curve(preds: DataFrame, every: int = CURVE_EVERY, window: int = WINDOW) -> DataFrame:
    """n_items, accuracy: the rolling accuracy after each ``every`` items."""
    return rolling(preds, window).where((F.col("idx") + 1) % every == 0).select((F.col("idx") + 1).alias("n_items"), "accuracy")
