"""Exact quantiles of many groups, in two passes and without holding a group's values.

The first pass makes a mergeable sketch of each group, which brackets a quantile: values below the bracket are counted only,
those inside are counted by value, and their running count, sorted in a window that may spill, finds the two ranks
between which the quantile lies. A bracket holds about one in a hundred values. A value that repeats is one row however often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a group's sketch, and a bracket's half width: eight times the error that 99 of 100 sketches keep to. Groups up to SMALL are their own bracket.
SKETCH, WIDE, SMALL = 8192, 0.0055, 4096


def quantiles(df: DataFrame, key: str, value: Column, probs: dict[str, float]) -> DataFrame:
    """key, and for each name the quantile of a probability (0 to 1), between two ranks in proportion; null values don't count. Groups without values are left out."""
    own = df.select(key, value.cast("double").alias("__v")).where("__v is not null")
    ranks = lambda sign: "array(" + ", ".join(repr(min(1.0, max(0.0, p + sign * WIDE))) + "D" for p in probs.values()) + ")"
    sketch = F.kll_sketch_agg_double("__v", F.lit(SKETCH))
    first = own.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), sketch.alias("__s"))
    first = first.select(key, "__n", *(F.expr(f"kll_sketch_get_quantile_double(__s, {ranks(sign)})").alias(name) for sign, name in ((-1, "__low"), (1, "__high"))))
    small = F.col("__n") <= SMALL

    def bracket(i: int, p: float) -> Column:
        at = F.lit(p) * (F.col("__n") - 1)
        low, high = (F.when(small | F.lit(not 0 < p + sign * WIDE < 1), F.lit(sign * float("inf"))).otherwise(F.get(name, F.lit(i))) for sign, name in ((-1, "__low"), (1, "__high")))
        return F.struct(F.lit(i).alias("i"), F.floor(at).alias("rank"), (at - F.floor(at)).alias("part"), low.alias("low"), high.alias("high"))

    brackets = first.select(key, F.col("__n").alias("n"), F.explode(F.array(*(bracket(i, p) for i, p in enumerate(probs.values())))).alias("b")).select(key, "n", "b.*")
    met = own.join(brackets, key).where("__v <= high OR isnan(__v)").select(key, "i", "n", "rank", "part", F.when(F.col("__v") >= F.col("low"), F.col("__v")).alias("v"))
    counted = met.groupBy(key, "i", "n", "rank", "part", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(key, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)))
    holds = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("c") <= r), F.col("v")))
    found = upto.groupBy(key, "i", "n", "rank", "part").agg(holds(F.col("rank")).alias("a"), holds(F.least(F.col("rank") + 1, F.col("n") - 1)).alias("b"))
    between = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a sketch was off by more than eight errors")).cast("double")).when(F.col("a") == F.col("b"), F.col("a"))
    between = between.otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return found.withColumn("q", between).groupBy(key).agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(probs)))
