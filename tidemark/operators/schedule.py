"""When labels are active and how likely: rules by glob, segments between changes, shares and draws."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Rule
from tidemark.functions.draws import uniform
from tidemark.functions.keys import glob_regex
from tidemark.sources.drawn import DrawnItems

from .ordered import upper_bound


class ScheduleError(ValueError):
    """A schedule that cannot run: no labels, a rule without a label, an item without an active label."""


#: Rules up to which all of them are tried on a label where it lies; more go through the index.
INLINE = 32
#: Characters of a glob's literal beginning and end that the index tells apart, and of a piece inside.
AFFIX, GRAM = 8, 4
_RULE = "struct<exact:int,length:int,ord:int,pattern:string,weight:double,start:bigint,stop:bigint>"


def affixes(glob: str) -> tuple[str, str]:
    """What a glob's matches begin and end with for certain, AFFIX characters at most."""
    wild = [i for i, c in enumerate(glob) if c in "*?[]"]
    return (glob[: wild[0]][:AFFIX], glob[wild[-1] + 1 :][-AFFIX:]) if wild else (glob[:AFFIX], glob[-AFFIX:])


def key_of(glob: str) -> tuple[int, int, str, str]:
    """(length of the beginning, of the end, beginning, end); or, where these say little, (0, -1, GRAM characters from inside, nothing)."""
    head, tail = affixes(glob)
    inside = max(re.split(r"[*?\[\]]", re.sub(r"\[.[^\]]*\]", "*", glob, flags=re.S)), key=len)
    return (0, -1, inside[:GRAM], "") if len(head) + len(tail) < GRAM <= len(inside) else (len(head), len(tail), head, tail)


def rules_frame(spark: SparkSession, rules: dict[str, Rule]) -> DataFrame:
    """Rules in their order, with the key under which the index has them."""
    rows = [(i, p, glob_regex(p), r.weight if r.weight is None else float(r.weight), r.start, r.stop, *key_of(p)) for i, (p, r) in enumerate(rules.items())]
    return spark.createDataFrame(rows, "ord int, pattern string, regex string, weight double, start long, stop long, a int, b int, head string, tail string")


def hits(faces: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """face_id and rule, for each rule that a face matches, by an index of what globs hold for certain.

    Rules are told apart by the lengths of their literal beginning and end, of which there are few, and those without by a
    piece inside. A face goes to one key of each pair of lengths and to one of each of its own pieces, and meets the
    rules that share a key. Only those are tried as expressions.
    """
    shapes = sorted({key_of(p)[:2] for p in rules})
    keys = ", ".join(f"named_struct('a', {a}, 'b', {b}, 'head', left(face_id, {a}), 'tail', right(face_id, {b}))" for a, b in shapes if b >= 0)
    grams = f"transform(array_distinct(transform(sequence(1, greatest(1, length(face_id) - {GRAM - 1})), i -> substring(face_id, i, {GRAM}))), g -> named_struct('a', 0, 'b', -1, 'head', g, 'tail', ''))"
    every = ", ".join([f"array({keys})"] * bool(keys) + [grams] * ((0, -1) in shapes))
    asked = faces.select("face_id").distinct().select("face_id", F.expr(f"explode(concat({every}))").alias("k")).select("face_id", "k.*")
    met = asked.join(rules_frame(faces.sparkSession, rules), ["a", "b", "head", "tail"]).where("face_id rlike regex OR face_id = pattern")
    rule = F.struct((F.col("face_id") == F.col("pattern")).cast("int").alias("exact"), F.length("pattern").alias("length"), (-F.col("ord")).alias("ord"), "pattern", "weight", "start", "stop")
    return met.select("face_id", rule.cast(_RULE).alias("rule"))


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tried(rules: dict[str, Rule]) -> str:
    """An array of all rules with whether a face_id matches each, as SQL."""
    n = lambda x, kind: f"cast({'NULL' if x is None else x} AS {kind})"
    each = (
        f"named_struct('rule', named_struct('exact', cast(face_id = {_text(p)} AS int), 'length', {len(p)}, 'ord', {-i}, 'pattern', {_text(p)}, 'weight', {n(r.weight, 'double')}, 'start', {n(r.start, 'long')}, 'stop', {n(r.stop, 'long')}),"
        f" 'hit', face_id rlike {_text(glob_regex(p))} OR face_id = {_text(p)})"
        for i, (p, r) in enumerate(rules.items())
    )
    return f"array({', '.join(each)})"


def matches(faces: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """faces with the rule that holds for each: its own id before globs, a longer glob before a shorter, the first on ties.

    A few rules are part of the plan, without a join; many are found by the index.
    """
    if not rules:
        return faces.withColumn("rule", F.lit(None).cast(_RULE))
    if len(rules) > INLINE:
        return faces.join(hits(faces, rules).groupBy("face_id").agg(F.max("rule").alias("rule")), "face_id", "left")
    return faces.withColumn("rule", F.expr(f"array_max(transform(filter({_tried(rules)}, x -> x.hit), x -> x.rule))"))


def resolve(faces: DataFrame, rules: dict[str, Rule], default: float = 1.0) -> DataFrame:
    """face_id, weight, start, stop, pattern."""
    return matches(faces, rules).selectExpr("face_id", f"coalesce(rule.weight, {default!r}D) AS weight", "coalesce(rule.start, 0L) AS start", "rule.stop AS stop", "rule.pattern AS pattern")


def unmatched(faces: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """pattern of every rule that no face matches."""
    spark = faces.sparkSession
    if not rules:
        return spark.createDataFrame([], "pattern string")
    if len(rules) > INLINE:
        return rules_frame(spark, rules).select("pattern").join(hits(faces, rules).select("rule.pattern"), "pattern", "left_anti")
    hit = faces.select(F.expr(f"explode(filter({_tried(rules)}, x -> x.hit))").alias("x")).select("x.rule.pattern").distinct()
    return spark.createDataFrame([(p,) for p in rules], "pattern string").join(hit, "pattern", "left_anti")


def require(faces: DataFrame, rules: dict[str, Rule]) -> None:
    """Raise if a rule matches no face: a mistyped pattern would otherwise leave the stream as if it weren't there."""
    if idle := sorted(r["pattern"] for r in unmatched(faces, rules).collect()):
        raise ScheduleError(f"no label matches {', '.join(map(repr, idle))}")


def edges(schedule: DataFrame) -> DataFrame:
    """One row: the sorted array of the places where the schedule changes, 0 the first of them."""
    return schedule.selectExpr("explode(array(0L, start, stop)) AS at").agg(F.sort_array(F.collect_set("at")).alias("edges"))


def segments(schedule: DataFrame) -> DataFrame:
    """seg, lo, hi (null: open): the stretches between changes of the schedule."""
    return edges(schedule).selectExpr("edges", "posexplode(edges) AS (seg, lo)").selectExpr("seg", "lo", "get(edges, seg + 1) AS hi")


def active(schedule: DataFrame) -> DataFrame:
    """seg, face_id, weight, edges: the labels that can be drawn in each segment.

    A label is active in the segments from the one that its start opens up to the one that its stop opens: no join.
    """
    own = schedule.where("weight > 0").withColumn("edges", edges(schedule).scalar())
    own = own.selectExpr("face_id", "weight", "edges", "cast(array_position(edges, start) AS int) - 1 AS first", "coalesce(cast(array_position(edges, stop) AS int) - 1, size(edges)) AS end")
    return own.where("first < end").selectExpr("explode(sequence(first, end - 1)) AS seg", "face_id", "weight", "edges")


def shares(schedule: DataFrame) -> DataFrame:
    """seg, lo, hi, face_id, weight, share, cum_lo, cum_hi: the active labels of each segment, their share of its weight, and its cumulative bounds."""
    order = "(PARTITION BY seg ORDER BY face_id)"
    out = active(schedule).selectExpr("*", "sum(weight) OVER (PARTITION BY seg) AS all", f"sum(weight) OVER {order} AS upto", f"lead(face_id) OVER {order} IS NULL AS final")
    out = out.selectExpr("*", "upto / all AS cum", f"coalesce(lag(upto / all) OVER {order}, 0D) AS cum_lo")
    return out.selectExpr("seg", "get(edges, seg) AS lo", "get(edges, seg + 1) AS hi", "face_id", "weight", "weight / all AS share", "cum_lo", "CASE WHEN final THEN 2D ELSE cum END AS cum_hi")


def check(schedule: DataFrame, n: int) -> None:
    """Raise unless there is an active label for each of n items."""
    if schedule.isEmpty():
        raise ScheduleError("there are no labels")
    own = segments(schedule).where(F.col("lo") < n)
    idle = own.join(shares(schedule).select("seg").distinct(), "seg", "left_anti").orderBy("lo").first()
    if idle:
        raise ScheduleError(f"no label is active at item {idle['lo']}")


def drawn(items: DataFrame, schedule: DataFrame, seed: int = 0) -> DataFrame:
    """idx, label of items (idx), a table or a stream.

    An item finds its segment among the places of change, and its label among the segment's cumulative shares, both by
    halving a sorted array; the one join is by segment, of which there are as many as changes.
    """
    own = shares(schedule).groupBy("seg").agg(F.expr("sort_array(collect_list(named_struct('cum_hi', cum_hi, 'face_id', face_id)))").alias("own")).selectExpr("seg", "own.cum_hi AS bounds", "own.face_id AS names")
    items = items.select("idx", uniform(F.col("idx"), "arrival", seed, "arrival").alias("u"), edges(schedule).scalar().alias("edges"))
    items = items.select("idx", "u", (upper_bound("edges", "idx") - 1).alias("seg"))
    return items.join(own, "seg").select("idx", "bounds", "names", upper_bound("bounds", "u").alias("at")).selectExpr("idx", "get(names, at) AS label")


def draw(schedule: DataFrame, n: int, seed: int = 0, first: int = 0) -> DataFrame:
    """idx, label of the items from first up to n."""
    return drawn(schedule.sparkSession.range(first, n).select(F.col("id").alias("idx")), schedule, seed)


def live(schedule: DataFrame, seed: int = 0, rate: float | None = 1000.0, first: int = 0, total: int | None = None, since: float | None = None, partitions: int | None = None) -> DataFrame:
    """The same items as a stream: rate a second since a time (now, if it isn't given), or all there are up to total if rate is None.

    A query over it that is stopped goes on from its checkpoint. A stream that is to resume must be given the since it began with.
    """
    spark = schedule.sparkSession
    spark.dataSource.register(DrawnItems)
    options = {"first": first, "total": total, "rate": rate, "since": time.time() if since is None else since, "partitions": partitions or spark.sparkContext.defaultParallelism}
    source = spark.readStream.format(DrawnItems.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load()
    return drawn(source, schedule, seed)
