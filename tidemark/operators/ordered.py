"""Quantities of the ordered prefix of a stream, by a scan over a tree of blocks.

A plain window over the whole order would bring a stream into one task. Here rows fall into blocks of consecutive
order keys, blocks into nodes, nodes into nodes above. Folds go up the tree, one small row a node; on the way down
each node gets the fold of all that lies before it; windows run over the children of one node, or the rows of one block,
never over more. Any associative fold will do: sums, maxima, the last row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14
FAN = 1 << 20
#: Bytes, as estimated, from which a stream gets a second level of nodes.
LARGE = 1 << 36
#: Blocks that one sketch of a key tells apart, and its size, whose error is a tenth of a block's share.
PARTS, SKETCH = 1024, 65535


class Tree(NamedTuple):
    """Rows of a block, children of a node (one small row each in a task), and levels of nodes."""

    size: int = BLOCK
    fan: int = FAN
    levels: int = 2

    @staticmethod
    def of(df: DataFrame) -> Tree:
        """The usual tree: one level of nodes, which holds order keys up to 1.7 * 10^10, or for large tables two (1.8 * 10^16)."""
        return Tree(levels=2 if estimated(df) > LARGE else 1)

    @property
    def capacity(self) -> int:
        """Order keys from 0 to below this one fit."""
        return self.size * self.fan**self.levels

    def block(self, idx: str) -> Column:
        odd = (F.col(idx) < 0) | (F.col(idx) >= self.capacity)
        return F.when(odd, F.raise_error(F.lit(f"an order key is not in 0 .. {self.capacity - 1}: rank the rows first, or scan with more levels")).cast("long")).otherwise(F.floor(F.col(idx) / self.size))


def block(idx: str | Column = "idx", size: int = BLOCK) -> Column:
    return F.floor((F.col(idx) if isinstance(idx, str) else idx) / size)


def upper_bound(values: str, x: str) -> Column:
    """How many of a sorted array's values are at most x, by halving; both are SQL expressions."""
    half = "cast((a.lo + a.hi) div 2 AS int)"
    step = f"CASE WHEN a.lo >= a.hi THEN a WHEN get({values}, {half}) <= {x} THEN named_struct('lo', {half} + 1, 'hi', a.hi) ELSE named_struct('lo', a.lo, 'hi', {half}) END"
    return F.expr(f"aggregate(sequence(1, cast(ceil(log2(size({values}) + 1)) AS int)), named_struct('lo', 0, 'hi', size({values})), (a, i) -> {step}).lo")


def cuts(key: str, size: int) -> Column:
    """An aggregate: the sorted bounds that cut an integer key into blocks of about size rows, PARTS at most, from a mergeable sketch of its quantiles."""
    sketch = F.kll_sketch_get_quantile_bigint(F.kll_sketch_agg_bigint(key, F.lit(SKETCH)), F.split(F.lit(",".join(str(i / PARTS) for i in range(1, PARTS))), ",").cast("array<double>"))
    blocks = F.least(F.lit(PARTS), F.ceil(F.count(key) / F.lit(float(size)))).cast("int")
    picked = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), blocks - 1)), lambda i: F.get(sketch, F.floor(i * PARTS / blocks).cast("int") - 1))
    return F.when(blocks > 1, F.array_distinct(picked)).otherwise(F.array().cast("array<bigint>"))


def estimated(df: DataFrame) -> int:
    """Bytes of the largest table that df is made from."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return max((int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), default=0)


def many(df: DataFrame, size: int) -> bool:
    """Whether df may have more rows than PARTS blocks hold."""
    return estimated(df) > 16 * PARTS * size


def dealt(df: DataFrame, key: str, size: int = BLOCK, source: DataFrame | None = None, deep: bool | None = None, name: str = "__b") -> DataFrame:
    """df with the number of its block of an integer key: blocks are in the key's order, and of about size rows however the keys lie.

    Bounds come from a sketch of the keys, and a row finds its block by halving them. A large table (deep) is cut twice,
    the second time by a sketch of each block, into PARTS * PARTS blocks at most. The bounds are read from source, a
    cheaper table with the same keys, if it is given. Equal keys share a block.
    """
    source = df if source is None else source
    deep = many(source, size) if deep is None else deep
    keys = source.select(F.col(key).cast("long").alias("__k"))
    first = keys.agg(cuts("__k", size).alias("cuts"))
    placed = lambda rows, at, to: rows.withColumn("__cuts", first.scalar()).withColumn(to, upper_bound("__cuts", at).cast("long")).drop("__cuts")
    if not deep:
        return placed(df, f"cast({key} AS long)", name)
    second = placed(keys, "__k", "__p").groupBy("__p").agg(cuts("__k", size).alias("__cuts"))  # PARTS rows of less than PARTS bounds
    own = placed(df, f"cast({key} AS long)", "__p").join(F.broadcast(second), "__p")
    return own.withColumn(name, F.col("__p") * PARTS + upper_bound("__cuts", f"cast({key} AS long)")).drop("__p", "__cuts")


def before(each: DataFrame, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], keys: tuple[str, ...] = (), fan: int = FAN, levels: int = 2) -> DataFrame:
    """Of one row (keys, __b, __f) a block: keys, __b and __c, the fold of all earlier blocks; null for the first.

    Up: a node's fold is that of its children. Down: a child has the fold before its node joined with that of the children
    before it. Windows run over the children of one node. __b is below fan ** levels.
    """
    own = each.withColumn("__p", F.floor(F.col("__b") / fan))
    earlier = Window.partitionBy(*keys, "__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = own.withColumn("__i", fold(F.col("__f")).over(earlier))
    if levels == 1:
        return inside.select(*keys, "__b", F.col("__i").alias("__c"))
    up = own.groupBy(*keys, F.col("__p").alias("__n")).agg(fold(F.col("__f")).alias("__f")).withColumnRenamed("__n", "__b")
    above = before(up, fold, join, keys, fan, levels - 1).select(*keys, F.col("__b").alias("__p"), F.col("__c").alias("__a"))
    return inside.join(above, [*keys, "__p"], "left").select(*keys, "__b", join(F.col("__a"), F.col("__i")).alias("__c"))


def ranked(df: DataFrame, key: str, name: str = "idx", size: int = BLOCK, source: DataFrame | None = None, deep: bool | None = None) -> DataFrame:
    """df with the 0-based rank of an integer key without ties, rows without a key left out; blocks of it hold about size rows, however the keys lie (see dealt)."""
    deep = many(df if source is None else source, size) if deep is None else deep
    own = dealt(df.where(F.col(key).isNotNull()), key, size, source, deep)
    counts = own.groupBy("__b").agg(F.count(F.lit(1)).alias("__f"))
    start = before(counts, F.sum, add, fan=PARTS, levels=2 if deep else 1).select("__b", F.coalesce("__c", F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key)) - 1
    return own.join(start, "__b", "left").withColumn(name, (F.col("__s") + inside).cast("long")).drop("__b", "__s")


def carried(df: DataFrame, value: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str, keys: tuple[str, ...] = (), exclusive: bool = False, idx: str = "idx", tree: Tree | None = None) -> DataFrame:
    """df with the running fold (F.sum, F.max ...) of value over idx, per keys, without the row itself if exclusive.

    join(before, inside) puts the folds of two stretches together; either may be null. idx runs from 0, with gaps or
    without, to below the tree's capacity.
    """
    tree = tree or Tree.of(df)
    own = df.withColumns({"__v": value, "__b": tree.block(idx)})
    by = [*keys, "__b"]
    carry = before(own.groupBy(*by).agg(fold(F.col("__v")).alias("__f")), fold, join, keys, tree.fan, tree.levels)
    inside = fold(F.col("__v")).over(Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    return own.withColumn("__i", inside).join(carry, by, "left").withColumn(name, join(F.col("__c"), F.col("__i"))).drop("__v", "__b", "__i", "__c")


def add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.greatest(a, b))


def latest(df: DataFrame, value: str, name: str, idx: str = "idx", keys: tuple[str, ...] = (), tree: Tree | None = None) -> DataFrame:
    """df with the value of the row before, per keys (the last-seen prediction)."""
    by, tree = [*keys, "__b"], tree or Tree.of(df)
    own = df.withColumn("__b", tree.block(idx))
    ends = own.groupBy(*by).agg(F.struct(F.max(idx).alias("i"), F.max_by(value, idx).alias("v")).alias("__f"))
    carry = before(ends, F.max, larger, keys, tree.fan, tree.levels)
    inside = Window.partitionBy(*by).orderBy(idx)
    first = F.row_number().over(inside) == 1
    return own.withColumns({"__l": F.lag(value).over(inside), "__o": first}).join(carry, by, "left").withColumn(name, F.when(F.col("__o"), F.col("__c.v")).otherwise(F.col("__l"))).drop("__b", "__l", "__o", "__c")


def novelty(stream: DataFrame, tree: Tree | None = None) -> DataFrame:
    """idx, label, first_seen, n_seen: whether a label is new, and how many have been seen."""
    first = stream.groupBy("label").agg(F.min("idx").alias("__first"))
    flagged = stream.join(first, "label").withColumn("first_seen", F.col("idx") == F.col("__first")).drop("__first")
    out = carried(flagged, F.col("first_seen").cast("long"), F.sum, add, "n_seen", tree=tree)
    return out.select("idx", "label", "first_seen", "n_seen")


def majority(stream: DataFrame, tree: Tree | None = None) -> DataFrame:
    """idx, label, pred: the most frequent earlier label, the earliest seen on ties; null at the first row."""
    counted = carried(stream, F.lit(1), F.sum, add, "rn", keys=("label",), tree=tree)
    first = stream.groupBy("label").agg(F.min("idx").alias("first_idx"))
    counted = counted.join(first, "label").withColumn("best", F.struct("rn", (-F.col("first_idx")).alias("neg"), "label"))
    out = carried(counted, F.col("best"), F.max, larger, "top", exclusive=True, tree=tree)
    return out.select("idx", "label", F.col("top.label").alias("pred"))


def rolling_mean(df: DataFrame, value: Column, width: int, name: str, idx: str = "idx", size: int = BLOCK) -> DataFrame:
    """df with the mean of value over the last width rows: each row also serves the next block, where it may be needed."""
    if width > size:
        raise ValueError("the window must fit in a block")
    own = df.withColumns({"__v": value, "__b": block(idx, size)})
    needed = F.col(idx) % size >= size - width
    both = own.withColumn("__t", F.explode(F.when(needed, F.array("__b", F.col("__b") + 1)).otherwise(F.array("__b"))))
    mean = F.avg("__v").over(Window.partitionBy("__t").orderBy(idx).rowsBetween(-(width - 1), 0))
    return both.withColumn(name, mean).where(F.col("__t") == F.col("__b")).drop("__v", "__b", "__t")
