"""What a replay buffer holds at every item: the last rows of each label, as intervals of the order.

A row enters its label's buffer after its own item and leaves it when the label's ``cap``-th later row has come. Its
membership is the interval (idx, until]; nothing is replayed item by item. Ranks within a label are sums carried over blocks, and
the row that pushes another out is found by an equi-join on (label, rank), so a label with most of the rows is no single
task. Which members an item sees is an interval join by buckets of the order: an interval goes to the buckets that it touches,
an item to its own.

Rows without a label are in no buffer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Tree, add, carried

CAP = 400
#: Order keys of a bucket of the interval join.
BUCKET = 1 << 10


def by_rank(stream: DataFrame, tree: Tree | None = None) -> DataFrame:
    """idx, label, rank: the 1-based rank of each labelled row within its label."""
    return carried(stream.where("label is not null").select("idx", "label"), F.lit(1), F.sum, add, "rank", keys=("label",), tree=tree)


def memberships(stream: DataFrame, cap: int = CAP, tree: Tree | None = None) -> DataFrame:
    """idx, label, rank, until: each row with the last item that still sees it in its label's buffer; null if none has pushed it out."""
    rows = by_rank(stream, tree)
    out = rows.select("label", (F.col("rank") - cap).alias("rank"), F.col("idx").alias("until"))
    return rows.join(out, ["label", "rank"], "left").select("idx", "label", "rank", "until")


def held(stream: DataFrame, cap: int = CAP, tree: Tree | None = None) -> DataFrame:
    """idx, label, size, oldest, held: at each item, before it is learned, its own label's buffer (how many rows, the first of them) and how many rows all buffers hold."""
    rows = by_rank(stream, tree)
    size = F.least(F.col("rank") - 1, F.lit(cap))
    oldest = rows.select("label", F.col("rank").alias("at"), F.col("idx").alias("oldest"))
    total = carried(rows, (F.col("rank") <= cap).cast("long"), F.sum, add, "held", exclusive=True, tree=tree)
    asked = total.select("idx", "label", size.alias("size"), F.when(size > 0, F.col("rank") - size).alias("at"), "held")
    return asked.join(oldest, ["label", "at"], "left").select("idx", "label", "size", "oldest", "held")


def members_at(items: DataFrame, rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """item, label, idx of every member (of memberships) that each of some items (idx) sees.

    An interval costs a row for each bucket that it touches: in sum the rows that buffers hold at one item of each bucket.
    """
    last = items.agg(F.max("idx")).scalar()
    place = lambda c: F.floor(c / bucket)
    spans = rows.withColumn("__last", last).where(F.col("idx") < F.col("__last"))
    spans = spans.withColumn("__b", F.explode(F.sequence(place(F.col("idx")), place(F.least(F.coalesce("until", "__last"), "__last")))))
    asked = items.select(F.col("idx").alias("item"), place(F.col("idx")).alias("__b"))
    inside = (F.col("idx") < F.col("item")) & (F.col("until").isNull() | (F.col("item") <= F.col("until")))
    return asked.join(spans, "__b").where(inside).select("item", "label", "idx")
