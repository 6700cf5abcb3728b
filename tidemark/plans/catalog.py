"""All registered queries by name, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import Rule
from tidemark.functions import color, draws, imaging, keys
from tidemark.functions import text as words
from tidemark.models import registry
from tidemark.models.head import PER_CLASS
from tidemark.operators import integrity, labels, neighbours, ordered, quantiles, replay, schedule, scoring
from tidemark.sources import store
from tidemark.streaming import processors

Query = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        PLANS[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- streams ---------------------------------------------------------------------------------------------------------


def events(spark: SparkSession, d: str, label: str = "event_type") -> DataFrame:
    own = table(spark, d, "events").select("event_id", F.col(label).cast("string").alias("label"), "value")
    return ordered.ranked(own, "event_id").drop("event_id")


def _s(label: str = "event_type") -> str:
    return f"s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, {label}::VARCHAR AS label, value FROM events)"


_LAST = f"{_s()}, p AS (SELECT idx, label, lag(label) OVER (ORDER BY idx) AS pred FROM s)"
_MATRIX = 'm AS (SELECT label AS "true", coalesce(pred, \'∅\') AS predicted, count(*) AS n, min(idx) AS first_idx FROM p GROUP BY ALL)'
_CLASSES = """
c AS (SELECT label, support, correct, coalesce(predicted, 0) AS predicted, correct / support AS recall,
             CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE correct / predicted END AS "precision", 2 * correct / (support + coalesce(predicted, 0)) AS f1
      FROM (SELECT "true" AS label, sum(n)::BIGINT AS support, coalesce(sum(n) FILTER ("true" = predicted), 0)::BIGINT AS correct FROM m GROUP BY 1)
      LEFT JOIN (SELECT predicted AS label, sum(n)::BIGINT AS predicted FROM m GROUP BY 1) USING (label))"""
_SCORES = 'SELECT sum(support)::BIGINT AS n, round(sum(correct) / sum(support), 9) AS accuracy, round(avg(recall), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, count(*) AS n_labels, round(1 / count(*), 9) AS chance FROM c'


@plan(f"WITH {_s()} SELECT idx, label FROM s")
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("idx", "label")


@plan(f"""WITH {_s('user_id')}, f AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) = 1 AS first_seen FROM s)
SELECT idx, label, first_seen, sum(first_seen::INT) OVER (ORDER BY idx)::BIGINT AS n_seen FROM f""")
def novelty_flags(spark: SparkSession, d: str) -> DataFrame:
    return ordered.novelty(events(spark, d, "user_id"))


@plan(f"WITH {_s()} SELECT label, count(*) AS n, min(idx) AS first_idx, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM s GROUP BY label")
def arrival_stats(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    return own.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 9))


@plan(f"""WITH {_s('user_id')}, c AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS r FROM s GROUP BY label)
SELECT count(*) AS n_labels, round(sum(n) FILTER (r <= 5) / sum(n), 9) AS top5_share, count(*) FILTER (n = 1) AS singletons FROM c""")
def popularity(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    top = own.orderBy(F.desc("n"), F.col("user_id").cast("string")).limit(5).agg(F.sum("n").alias("top"))
    return own.agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("singletons")).crossJoin(top).select("n_labels", F.round(F.col("top") / F.col("all"), 9).alias("top5_share"), "singletons")


# --- predictions and scores ------------------------------------------------------------------------------------------


def last_seen(spark: SparkSession, d: str) -> DataFrame:
    return ordered.latest(events(spark, d).select("idx", "label"), "label", "pred").select("idx", "label", "pred")


@plan(f"WITH {_LAST} SELECT idx, label, pred FROM p")
def pred_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return last_seen(spark, d)


@plan(f"WITH {_LAST} SELECT 'events' AS stream_id, idx, label, pred FROM p")
def pred_plugin(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).select(F.lit("events").alias("stream_id"), "idx", "label", F.col("value").alias("features"))
    return registry.prequential(own, registry.load("last-seen"))


_MAJOR = f"""{_s()}, r AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) AS rn, min(idx) OVER (PARTITION BY label) AS f FROM s),
p AS (SELECT idx, label, (max({{'n': rn, 'f': -f, 'l': label}}) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)).l AS pred FROM r)"""


@plan(f"WITH {_MAJOR} SELECT idx, label, pred FROM p")
def pred_majority(spark: SparkSession, d: str) -> DataFrame:
    return ordered.majority(events(spark, d).select("idx", "label"))


@plan(f'WITH {_LAST}, {_MATRIX} SELECT "true", predicted, n FROM m')
def confusion_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(last_seen(spark, d)).select("true", "predicted", "n")


@plan(f"WITH {_LAST}, {_MATRIX}, {_CLASSES} {_SCORES}")
def scores_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return scoring.overall(scoring.confusion(last_seen(spark, d)))


@plan(f"""WITH {_LAST}, {_MATRIX}, {_CLASSES}, q AS (SELECT * FROM p ORDER BY idx DESC LIMIT 500),
r AS (SELECT label, round(avg((label = pred)::INT), 9) AS recent_recall FROM (SELECT label, coalesce(pred, '∅') AS pred FROM q) GROUP BY label)
SELECT label, support, correct, predicted, round(recall, 9) AS recall, round("precision", 9) AS "precision", round(f1, 9) AS f1, recent_recall FROM c LEFT JOIN r USING (label)""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    p = last_seen(spark, d)
    now = scoring.by_class(scoring.confusion(scoring.recent(p))).select("label", F.round("recall", 9).alias("recent_recall"))
    return scoring.by_class(scoring.confusion(p)).join(now, "label", "left").select("label", "support", "correct", "predicted", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "f1")), "recent_recall")


@plan(f"""WITH {_LAST}, {_MATRIX} SELECT "true", predicted, n FROM m JOIN (SELECT "true", min(first_idx) AS ft FROM m GROUP BY 1) USING ("true") WHERE "true" <> predicted ORDER BY n DESC, ft, first_idx LIMIT 10""")
def worst_confusions(spark: SparkSession, d: str) -> DataFrame:
    return scoring.worst(scoring.confusion(last_seen(spark, d)))


_ROLL = "w AS (SELECT idx, round(avg(coalesce(label = pred, false)::INT::DOUBLE) OVER (ORDER BY idx ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 9) AS accuracy FROM p)"


@plan(f"WITH {_LAST}, {_ROLL} SELECT idx, accuracy FROM w")
def rolling_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rolling(last_seen(spark, d))


@plan(f"WITH {_LAST}, {_ROLL} SELECT idx + 1 AS n_items, accuracy FROM w WHERE (idx + 1) % 100 = 0")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    return scoring.curve(last_seen(spark, d))


@plan(f"WITH {_s()}, a AS (SELECT idx, label, lag(label) OVER (ORDER BY idx) AS pred FROM s), p AS (SELECT * FROM a ORDER BY idx DESC LIMIT 500), {_MATRIX}, {_CLASSES} {_SCORES}")
def recent_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.overall(scoring.confusion(scoring.recent(last_seen(spark, d))))


@plan(f"""WITH {_MAJOR}, k AS (SELECT avg(coalesce(label = pred, false)::INT) AS m, 1 / count(DISTINCT label) AS c FROM p), {_s().replace('s AS', 's2 AS', 1)},
l AS (SELECT avg(coalesce(label = pred, false)::INT) AS a FROM (SELECT label, lag(label) OVER (ORDER BY idx) AS pred FROM s2))
SELECT round(a, 9) AS accuracy, round(m, 9) AS majority_accuracy, round(c, 9) AS chance, round(CASE WHEN m = 0 THEN 'inf'::DOUBLE ELSE a / m END, 9) AS lift FROM k, l""")
def chance_lift(spark: SparkSession, d: str) -> DataFrame:
    hit = F.avg(F.coalesce(F.col("label") == F.col("pred"), F.lit(False)).cast("int"))
    m = ordered.majority(events(spark, d).select("idx", "label")).agg(hit.alias("m"), F.countDistinct("label").alias("k"))
    return last_seen(spark, d).agg(hit.alias("a")).crossJoin(m).select(
        F.round("a", 9).alias("accuracy"), F.round("m", 9).alias("majority_accuracy"), F.round(1 / F.col("k"), 9).alias("chance"), F.round(F.when(F.col("m") == 0, float("inf")).otherwise(F.col("a") / F.col("m")), 9).alias("lift"))


@plan(f"""WITH {_LAST} SELECT label AS "true", predicted, count(*) AS n, grouping(label, predicted)::BIGINT AS level FROM (SELECT label, coalesce(pred, '∅') AS predicted FROM p) GROUP BY GROUPING SETS ((label, predicted), (label), (predicted), ())""")
def confusion_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    own = last_seen(spark, d).select(F.col("label").alias("true"), F.coalesce("pred", F.lit(scoring.ABSTAIN)).alias("predicted"))
    return own.groupingSets([("true", "predicted"), ("true",), ("predicted",), ()], "true", "predicted").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("true", "predicted").cast("long").alias("level"))


@plan(f"""WITH {_LAST}, v AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value FROM events)
SELECT floor(value / 25)::BIGINT AS slice, count(*) AS n, count(*) FILTER (coalesce(pred <> label, true)) AS errors FROM p JOIN v USING (idx) GROUP BY 1""")
def error_slices(spark: SparkSession, d: str) -> DataFrame:
    own = ordered.latest(events(spark, d), "label", "pred")
    return own.groupBy(F.floor(F.col("value") / 25).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("pred") != F.col("label"), F.lit(True))).alias("errors"))


@plan("""SELECT conv_id, turn, role AS label, lag(role) OVER w AS pred, row_number() OVER w - 1 AS idx FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def conversation_last_role(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label"), F.lag("role").over(w).alias("pred"), (F.row_number().over(w) - 1).cast("long").alias("idx"))


# --- vectors ---------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("features"))


_CELLS = """x AS (SELECT vec_id AS idx, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
sc AS (SELECT idx, dim, x, avg(x) OVER w AS mean, var_pop(x) OVER w AS var FROM x WINDOW w AS (PARTITION BY dim ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@plan(f"WITH {_CELLS} SELECT idx, dim::INT AS dim, round(mean, 6) AS mean, round(var, 6) AS var FROM sc")
def running_scaler(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.scaler(vectors(spark, d)).select("idx", "dim", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


_KNN = f"""{_CELLS}, z AS (SELECT idx, dim, CASE WHEN var > 0 THEN (x - mean) / sqrt(var) ELSE 0 END AS z FROM sc),
zl AS (SELECT idx, row_number() OVER (ORDER BY idx) AS pos, list(coalesce(z, 0) ORDER BY dim) AS z FROM z GROUP BY idx),
dist AS (SELECT q.idx, c.idx AS other, round(list_distance(q.z, c.z), 6) AS dd FROM zl q JOIN zl c ON c.pos BETWEEN q.pos - {neighbours.WINDOW} AND q.pos - 1),
nn AS (SELECT idx, other, dd, row_number() OVER (PARTITION BY idx ORDER BY dd, other DESC) AS rank FROM dist QUALIFY rank <= 5)"""
_VOTE = """v AS (SELECT nn.idx, e.label::VARCHAR AS their, max(CASE WHEN dd = 0 THEN -rank END) AS exact, round(sum(CASE WHEN dd > 0 THEN 1 / dd END), 6) AS n, min(rank) AS best FROM nn JOIN embeddings e ON e.vec_id = nn.other GROUP BY ALL),
p AS (SELECT e.vec_id AS idx, e.label::VARCHAR AS label, t.their AS pred FROM embeddings e LEFT JOIN (SELECT idx, their FROM v QUALIFY row_number() OVER (PARTITION BY idx ORDER BY exact DESC NULLS LAST, n DESC, best) = 1) t ON t.idx = e.vec_id)"""


@plan(f"WITH {_KNN} SELECT idx, other, rank::INT AS rank FROM nn")
def knn_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(vectors(spark, d)).select("idx", "other", "rank")


def knn(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d)
    return neighbours.vote(neighbours.neighbours(own), own)


@plan(f"WITH {_KNN}, {_VOTE} SELECT idx, label, pred FROM p")
def pred_knn(spark: SparkSession, d: str) -> DataFrame:
    return knn(spark, d)


@plan(f"WITH {_KNN}, {_VOTE}, {_MATRIX}, {_CLASSES} {_SCORES}")
def scores_knn(spark: SparkSession, d: str) -> DataFrame:
    return scoring.overall(scoring.confusion(knn(spark, d)))


@plan(f"SELECT label::VARCHAR AS label, vec_id AS idx, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC)::INT AS age FROM embeddings QUALIFY age <= {PER_CLASS}")
def replay_buffer(spark: SparkSession, d: str) -> DataFrame:
    age = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("idx")))
    return vectors(spark, d).select("label", "idx", age.alias("age")).where(F.col("age") <= PER_CLASS)


_RANKS = "r AS (SELECT idx, label, row_number() OVER (PARTITION BY label ORDER BY idx) AS rank FROM s WHERE label IS NOT NULL)"
_VECTORS = "s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, label::VARCHAR AS label FROM embeddings)"


def _held(stream: str, cap: int) -> str:
    return f"""WITH {stream}, {_RANKS}, n AS (SELECT *, least(rank - 1, {cap}) AS size, coalesce(sum((rank <= {cap})::INT) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held FROM r)
SELECT n.idx, n.label, n.size, o.idx AS oldest, n.held FROM n LEFT JOIN r o ON n.size > 0 AND o.label = n.label AND o.rank = n.rank - n.size"""


@plan(_held(_s(), PER_CLASS))
def replay_held(spark: SparkSession, d: str) -> DataFrame:
    return replay.held(events(spark, d).select("idx", "label"), PER_CLASS)


@plan(_held(_VECTORS, 20))
def replay_held_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = ordered.ranked(vectors(spark, d).select(F.col("idx").alias("vec_id"), "label"), "vec_id")
    return replay.held(own.select("idx", "label"), 20)


@plan(f"""WITH {_s()}, {_RANKS}, m AS (SELECT idx, label, lead(idx, {PER_CLASS}) OVER (PARTITION BY label ORDER BY idx) AS until FROM r)
SELECT i.idx AS item, m.label, count(*) AS size, min(m.idx) AS oldest, max(m.idx) AS newest FROM s i JOIN m ON m.idx < i.idx AND (m.until IS NULL OR i.idx <= m.until) WHERE i.idx % 100 = 0 GROUP BY ALL""")
def replay_members(spark: SparkSession, d: str) -> DataFrame:
    own = events(spark, d).select("idx", "label")
    seen = replay.members_at(own.where(F.col("idx") % 100 == 0), replay.memberships(own, PER_CLASS))
    return seen.groupBy("item", "label").agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("oldest"), F.max("idx").alias("newest"))


@plan()
def head_replay(spark: SparkSession, d: str) -> DataFrame:
    own = registry.prequential(vectors(spark, d).withColumn("stream_id", F.lit("embeddings")), registry.load("replay-head"))
    return own.select("idx", "label", "pred")


@plan(f"""WITH {_CELLS}, n AS (SELECT vec_id AS idx, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)
SELECT idx, round(CASE WHEN any_value(n) > 1 THEN avg(sqrt(var)) * sqrt(any_value(n) / (any_value(n) - 1)) END, 6) AS scale FROM sc JOIN n USING (idx) GROUP BY idx""")
def running_scale(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.single_scale(vectors(spark, d)).select("idx", F.round("scale", 6).alias("scale"))


@plan("WITH g AS (SELECT label, least(255, greatest(0, (127.5 * (x + 1))::INT)) AS level FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings)), n AS (SELECT label, level, count(*) AS n FROM g GROUP BY ALL), "
      "c AS (SELECT label, level, sum(n) OVER w AS below, sum(n * level) OVER w AS mass, sum(n) OVER (PARTITION BY label) AS total, sum(n * level) OVER (PARTITION BY label) AS all_mass FROM n WINDOW w AS (PARTITION BY label ORDER BY level)), "
      "v AS (SELECT label, level, round(below::DOUBLE * (total - below) * pow(mass / below - (all_mass - mass) / (total - below), 2), 6) AS var FROM c WHERE below < total) "
      "SELECT label, (list(level ORDER BY var DESC, level))[1]::INT AS threshold FROM v GROUP BY label")
def otsu_threshold(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x"))
    n = own.groupBy("label", F.least(F.lit(255), F.greatest(F.lit(0), F.bround(127.5 * (F.col("x").cast("double") + 1)).cast("int"))).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    upto, every = Window.partitionBy("label").orderBy("level"), Window.partitionBy("label")
    c = n.select("label", "level", F.sum("n").over(upto).alias("below"), F.sum(F.col("n") * F.col("level")).over(upto).alias("mass"), F.sum("n").over(every).alias("total"), F.sum(F.col("n") * F.col("level")).over(every).alias("all"))
    gap = F.col("mass") / F.col("below") - (F.col("all") - F.col("mass")) / (F.col("total") - F.col("below"))
    var = F.round(F.col("below").cast("double") * (F.col("total") - F.col("below")) * gap * gap, 6)
    return c.where("below < total").groupBy("label").agg((-F.max(F.struct(var.alias("v"), (-F.col("level")).alias("l")))["l"]).alias("threshold"))


def _features_sql() -> str:
    """The 38 features of a mask of 4 rows and 16 columns, pixel by pixel."""
    angles = ", ".join(map(str, (-24, -18, -12, -6, 0, 6, 12, 18, 24)))
    rows = ", ".join(f"{f'r{(i - 2) // 3} / peak' if i % 3 == 2 else '0::DOUBLE'} AS row_{i}" for i in range(12))
    cols = ", ".join(f"(c[{2 * i + 1}] + c[{2 * i + 2}]) / 2 AS col_{i}" for i in range(8))
    names = ["aspect", "ink_density", "slant_deg", *(f"row_{i}" for i in range(12)), "row_peak", "row_centroid", "row_spread", *(f"col_{i}" for i in range(8)), "col_mean", "col_std", "col_gaps", "col_autocorr", "stroke_mean", "stroke_std", "stroke_contrast", "stroke_max", "edge_density", "hole_ratio", "grad_orientation"]
    return f"""
WITH p AS (SELECT vec_id, k // 16 AS y, k % 16 AS x, e > 0 AS m FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS k FROM embeddings)),
q AS (SELECT *, lag(m) OVER across AS l, lead(m) OVER across AS r, lag(m) OVER down AS u, lead(m) OVER down AS d FROM p WINDOW across AS (PARTITION BY vec_id, y ORDER BY x), down AS (PARTITION BY vec_id, x ORDER BY y)),
w AS (SELECT vec_id, y, x, m, 2 * (1 + (coalesce(l, true) AND coalesce(r, true) AND coalesce(u, true) AND coalesce(d, true))::INT) AS w, coalesce(m <> r, false) AS across, coalesce(m <> d, false) AS down FROM q),
a AS (SELECT vec_id, avg(m::INT) AS density, avg(w) FILTER (m) / 4 AS stroke_mean, stddev_pop(w) FILTER (m) / 4 AS stroke_std, quantile_cont(w::DOUBLE, 0.95) FILTER (m) / quantile_cont(w::DOUBLE, 0.2) FILTER (m) AS stroke_contrast, max(w) FILTER (m) / 4 AS stroke_max,
  count(*) FILTER (across OR down) / count(*) FILTER (m) AS edge_density, CASE WHEN bool_or(across OR down) THEN count(*) FILTER (down) / (count(*) FILTER (across) + count(*) FILTER (down)) ELSE 0.5 END AS grad_orientation,
  avg(m::INT) FILTER (y = 0) AS r0, avg(m::INT) FILTER (y = 1) AS r1, avg(m::INT) FILTER (y = 2) AS r2, avg(m::INT) FILTER (y = 3) AS r3 FROM w GROUP BY vec_id),
b AS (SELECT *, greatest(r0, r1, r2, r3) AS peak, (r1 / 3 + r2 * 2 / 3 + r3) / (r0 + r1 + r2 + r3) AS centre FROM a),
col AS (SELECT vec_id, list(v ORDER BY x) AS c, avg(v) AS col_mean, stddev_pop(v) AS col_std, count(*) FILTER (v < 0.02) / 16 AS col_gaps FROM (SELECT vec_id, x, avg(m::INT) AS v FROM w GROUP BY ALL) GROUP BY vec_id),
cen AS (SELECT vec_id, list_transform(c, lambda v: v - col_mean) AS z FROM col),
auto AS (SELECT vec_id, CASE WHEN list_sum(list_transform(z, lambda v: v * v)) > 0 THEN list_max(list_transform(range(2, 8), lambda k: list_sum(list_transform(range(1, 17 - k), lambda i: z[i + k] * z[i])))) / list_sum(list_transform(z, lambda v: v * v)) ELSE 0 END AS col_autocorr FROM cen),
sh AS (SELECT vec_id, t, angle, (x + round_even(tan(radians(angle)) * (y - 2), 0)::INT + 160) % 16 AS place FROM w, (SELECT unnest([{angles}]) AS angle, unnest(range(9)) AS t) WHERE m),
va AS (SELECT vec_id, t, angle, sum(n * n) / 16.0::DOUBLE - pow(sum(n) / 16.0::DOUBLE, 2) AS v FROM (SELECT vec_id, t, angle, place, count(*) AS n FROM sh GROUP BY ALL) GROUP BY ALL),
sl AS (SELECT vec_id, angle::DOUBLE AS slant_deg FROM va QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(v, 9) DESC, t) = 1),
f AS (SELECT vec_id, ln(4) AS aspect, density AS ink_density, slant_deg, {rows}, peak AS row_peak, centre AS row_centroid,
  sqrt((r0 * pow(centre, 2) + r1 * pow(1 / 3 - centre, 2) + r2 * pow(2 / 3 - centre, 2) + r3 * pow(1 - centre, 2)) / (r0 + r1 + r2 + r3)) AS row_spread, {cols}, col_mean, col_std, col_gaps, col_autocorr, stroke_mean, stroke_std, stroke_contrast, stroke_max, edge_density, 1 - density AS hole_ratio, grad_orientation
  FROM b JOIN col USING (vec_id) JOIN auto USING (vec_id) JOIN sl USING (vec_id))
SELECT vec_id, 1::DOUBLE AS dark_on_light, {', '.join(f'round({n}::DOUBLE, 6) AS {n}' for n in names)} FROM f"""


@plan(_features_sql())
def mask_features(spark: SparkSession, d: str) -> DataFrame:
    bits = F.transform("embedding", lambda x: x > 0)
    return table(spark, d, "embeddings").select("vec_id", imaging.mask_features(bits, F.lit(16)).alias("f")).select("vec_id", *(F.round(f"f.{n}", 6).alias(n) for n in imaging.NAMES))


@plan("SELECT vec_id, printf('crops/%05d/%08d.png', vec_id // 10000, vec_id) AS path FROM embeddings")
def shard_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", store.shard_path(F.col("vec_id")).alias("path"))


@plan("SELECT vec_id, (vec_id // 8)::BIGINT AS row, (vec_id % 8)::BIGINT AS col, 12 + (vec_id % 8) * 108 AS x, 12 + (vec_id // 8) * 76 AS y FROM embeddings")
def contact_grid(spark: SparkSession, d: str) -> DataFrame:
    r, c = F.floor(F.col("vec_id") / 8), F.col("vec_id") % 8
    return table(spark, d, "embeddings").select("vec_id", r.alias("row"), c.alias("col"), (12 + c * 108).alias("x"), (12 + r * 76).alias("y"))


# --- label space and schedule ----------------------------------------------------------------------------------------

RULES = {"brand-1*:*": Rule(weight=6.0), "brand-1?:s*": Rule(weight=0.05, start=500), "brand-2*": Rule(weight=3.0, stop=800), "*:promo": Rule(weight=9.0, start=400, stop=900), "brand-3*:economy": Rule(weight=0.0), "no-such-font:regular": Rule()}
NATION_RULES = {"nation-7": Rule(weight=6.0), "nation-1*": Rule(start=500), "*-?4": Rule(weight=3.0, stop=800), "nation-[23]": Rule(weight=9.0, start=400, stop=900), "nation-20": Rule(weight=0.0), "nation-2?": Rule(weight=0.001), "nation-19": Rule(weight=1e-9), "no-such-nation": Rule()}


def part_faces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(keys.slug_ascii(F.col("p_brand")), F.lit(":"), keys.slug_ascii(F.col("p_type"))).alias("face_id")).distinct()


def nation_faces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(keys.slug_ascii(F.col("n_name")).alias("face_id"))


def _slug(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


def _rules(rules: dict[str, Rule]) -> str:
    n = lambda x: "NULL" if x is None else str(x)
    return "rules(ord, pattern, regex, weight, start, stop) AS (VALUES " + ", ".join(f"({i}, '{p}', '{keys.glob_regex(p)}', {n(r.weight)}::DOUBLE, {r.start}::BIGINT, {n(r.stop)}::BIGINT)" for i, (p, r) in enumerate(rules.items())) + ")"


_PARTS = f"faces AS (SELECT DISTINCT {_slug('p_brand')} || ':' || {_slug('p_type')} AS face_id FROM part)"
_NATIONS = f"faces AS (SELECT {_slug('n_name')} AS face_id FROM nation)"
_RESOLVED = """sched AS (SELECT face_id, coalesce(weight, 1.0)::DOUBLE AS weight, coalesce(start, 0) AS start, stop, pattern FROM (
  SELECT faces.face_id, r.* FROM faces LEFT JOIN rules r ON regexp_matches(face_id, regex) OR face_id = pattern
  QUALIFY row_number() OVER (PARTITION BY faces.face_id ORDER BY (face_id = pattern) DESC, length(pattern) DESC, ord) = 1))"""
_SEGMENTS = """seg AS (SELECT row_number() OVER (ORDER BY lo) - 1 AS seg, lo, lead(lo) OVER (ORDER BY lo) AS hi FROM (SELECT 0::BIGINT AS lo UNION SELECT start FROM sched UNION SELECT stop FROM sched WHERE stop IS NOT NULL))"""
_SHARES = """sh AS (SELECT seg, lo, hi, face_id, weight, weight / sum(weight) OVER (PARTITION BY seg) AS share,
  CASE WHEN row_number() OVER (PARTITION BY seg ORDER BY face_id DESC) = 1 THEN 2.0 ELSE sum(weight) OVER (PARTITION BY seg ORDER BY face_id) / sum(weight) OVER (PARTITION BY seg) END AS cum_hi
  FROM seg JOIN sched ON weight > 0 AND start <= lo AND (stop IS NULL OR lo < stop)), sc AS (SELECT *, coalesce(lag(cum_hi) OVER (PARTITION BY seg ORDER BY face_id), 0) AS cum_lo FROM sh)"""
ITEMS = 50_000
_DRAW = f"""drawn AS (SELECT idx, face_id AS label FROM (SELECT i AS idx, {draws.uniform_sql('i', 'arrival', 0, 'arrival')} AS u FROM range({ITEMS}) t(i)) JOIN sc ON idx >= lo AND (hi IS NULL OR idx < hi) AND u >= cum_lo AND u < cum_hi)"""
_NATION = f"WITH {_NATIONS}, {_rules(NATION_RULES)}, {_RESOLVED}, {_SEGMENTS}"


@plan(f"WITH {_PARTS}, {_rules(RULES)}, {_RESOLVED} SELECT face_id, weight, start, stop, pattern FROM sched")
def schedule_resolve(spark: SparkSession, d: str) -> DataFrame:
    return schedule.resolve(part_faces(spark, d), RULES)


@plan(f"WITH {_PARTS}, {_rules(RULES)} SELECT pattern FROM rules WHERE NOT EXISTS (SELECT 1 FROM faces WHERE regexp_matches(face_id, regex))")
def schedule_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return schedule.unmatched(part_faces(spark, d), RULES)


def nation_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedule.resolve(nation_faces(spark, d), NATION_RULES)


@plan(f"{_NATION} SELECT seg, lo, hi FROM seg")
def schedule_segments(spark: SparkSession, d: str) -> DataFrame:
    return schedule.segments(nation_schedule(spark, d)).withColumn("seg", F.col("seg").cast("long"))


@plan(f"{_NATION}, {_SHARES} SELECT seg, face_id, round(share, 9) AS share FROM sc")
def schedule_shares(spark: SparkSession, d: str) -> DataFrame:
    return schedule.shares(nation_schedule(spark, d)).select(F.col("seg").cast("long").alias("seg"), "face_id", F.round("share", 9).alias("share"))


@plan(f"WITH {_PARTS}, {_rules(RULES)}, {_RESOLVED} SELECT count(*) AS n, count(DISTINCT weight) AS n_weights, count(*) FILTER (start > 0 OR stop IS NOT NULL) AS n_timed, count(*) FILTER (weight = 0) AS n_excluded FROM sched")
def schedule_description(spark: SparkSession, d: str) -> DataFrame:
    return schedule.resolve(part_faces(spark, d), RULES).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("weight").alias("n_weights"), F.count_if((F.col("start") > 0) | F.col("stop").isNotNull()).alias("n_timed"), F.count_if(F.col("weight") == 0).alias("n_excluded"))


@plan(f"{_NATION}, {_SHARES}, {_DRAW} SELECT idx, label FROM drawn")
def arrival_draw(spark: SparkSession, d: str) -> DataFrame:
    return schedule.draw(nation_schedule(spark, d), ITEMS)


@plan(f"{_NATION}, {_SHARES}, {_DRAW} SELECT face_id, weight, start, stop, coalesce(n, 0) AS n, first_idx FROM sched LEFT JOIN (SELECT label AS face_id, count(*) AS n, min(idx) AS first_idx FROM drawn GROUP BY 1) USING (face_id)")
def schedule_report(spark: SparkSession, d: str) -> DataFrame:
    own = nation_schedule(spark, d)
    seen = schedule.draw(own, ITEMS).groupBy(F.col("label").alias("face_id")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    return own.join(seen, "face_id", "left").select("face_id", "weight", "start", "stop", F.coalesce("n", F.lit(0)).alias("n"), "first_idx").orderBy(F.desc("weight"), "face_id")


@plan(f"{_NATION}, {_SHARES}, {_DRAW} SELECT face_id FROM sched WHERE weight > 0 AND face_id NOT IN (SELECT label FROM drawn)")
def never_appeared(spark: SparkSession, d: str) -> DataFrame:
    own = nation_schedule(spark, d)
    return own.where("weight > 0").join(schedule.draw(own, ITEMS).select(F.col("label").alias("face_id")).distinct(), "face_id", "left_anti").select("face_id")


@plan(f"SELECT p_partkey, {_slug('p_name')} AS slug FROM part")
def slug_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", keys.slug(F.col("p_name")).alias("slug"))


@plan(f"SELECT p_partkey, CASE WHEN n = 1 THEN face_id ELSE face_id || '#' || n END AS face_id FROM (SELECT p_partkey, {_slug('p_name')} AS face_id, row_number() OVER (PARTITION BY {_slug('p_name')} ORDER BY printf('%08d', p_partkey)) AS n FROM part)")
def occurrence_suffix(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").select("p_partkey", keys.slug_ascii(F.col("p_name")).alias("face_id"), F.format_string("%08d", "p_partkey").alias("path"))
    return labels.unique_ids(own).select("p_partkey", "face_id")


_ALNUM = keys.charset("ascii_alnum")


@plan(f"SELECT doc_id, list_aggregate(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ' ' AND NOT contains('{_ALNUM}', c))), 'count') AS n_missing, n_chars > 0 AS seen FROM documents")
def charset_coverage(spark: SparkSession, d: str) -> DataFrame:
    lack = F.length(F.replace(keys.missing_from(F.col("text"), _ALNUM), F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", lack.cast("long").alias("n_missing"), (F.col("n_chars") > 0).alias("seen"))


@plan(f"""SELECT doc_id, coalesce(string_agg(c, '' ORDER BY i), '') AS missing FROM (SELECT doc_id, c, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents) WHERE NOT contains('{_ALNUM}', c) GROUP BY doc_id, c) RIGHT JOIN (SELECT doc_id FROM documents) USING (doc_id) GROUP BY doc_id""")
def missing_glyphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.missing_from(F.col("text"), _ALNUM).alias("missing"))


def _presets_sql() -> str:
    letters, digits, signs = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    more = "àâäçèéêëîïôöùûüÿœæÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŸŒÆáíóúñÁÍÓÚÑ¿¡ßÄÖÜ“”‘’–—…€£"
    sets = {"ascii_alnum": letters + letters.upper() + digits, "ascii_printable": letters + letters.upper() + digits + signs, "latin1_printable": letters + letters.upper() + digits + signs + more}
    count = lambda chars: f"len(list_filter(list_distinct(string_split(text, '')), lambda c: c NOT IN (' ', chr(9), chr(10), chr(13)) AND NOT contains('{chars}', c)))"
    return f"SELECT doc_id, {', '.join(f'{count(v)} AS {k}' for k, v in sets.items())} FROM documents"


@plan(_presets_sql())
def preset_coverage(spark: SparkSession, d: str) -> DataFrame:
    lack = {k: F.length(F.regexp_replace(keys.missing_from(F.col("text"), keys.charset(k)), "[ \t\n\r]", "")) for k in keys.CHARSETS}
    return table(spark, d, "documents").select("doc_id", *(v.cast("long").alias(k) for k, v in lack.items()))


@plan("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'variable-font' WHEN p_size % 3 = 0 THEN 'missing-glyphs' END AS reason, CASE WHEN p_size % 7 = 0 OR p_size % 3 = 0 THEN 'rejected' ELSE 'kept' END AS status,
CASE WHEN p_size % 7 <> 0 AND p_size % 3 = 0 THEN '0123456789' END AS detail FROM part""")
def admission_status(spark: SparkSession, d: str) -> DataFrame:
    full, part = F.array(*[F.lit(ord(c)) for c in _ALNUM]), F.array(*[F.lit(ord(c)) for c in _ALNUM if not c.isdigit()])
    own = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("face_id"), F.format_string("%08d", "p_partkey").alias("path"), (F.col("p_size") % 7 == 0).alias("variable"), F.when(F.col("p_size") % 3 == 0, part).otherwise(full).alias("codepoints"))
    return labels.admitted(own).select("p_partkey", "reason", "status", "detail")


@plan(f"""WITH k AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN strlen(replace(t, ' ', '')) = 0 OR (strlen(replace(t, ' ', '')) < 2 AND regexp_matches(text, '[^A-Za-z0-9 ]')) THEN 'doc' || doc_id ELSE t END AS text FROM k""")
def project_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", keys.project_from(F.col("text"), _ALNUM, F.concat(F.lit("doc"), F.col("doc_id").cast("string")))["text"].alias("text"))


STYLES = ["Extra Light", "Semi-Bold", "Black Italic", "Regular", "Heavy", "Plain", "Extra Black", "Semi Light", "Regular Bold", "Medium Bold", "Book Heavy", "Light Black", "Thin", "Ultra Light", "Demi_bold", "Normal"]


@plan("SELECT p_partkey, CASE WHEN p_size >= 40 THEN p_size ELSE [300, 600, 900, 400, 900, 400, 950, 350, 700, 700, 900, 900, 100, 300, 600, 400][1 + p_partkey % 16] END::INT AS weight FROM part")
def weight_keywords(spark: SparkSession, d: str) -> DataFrame:
    style = F.element_at(F.array(*map(F.lit, STYLES)), (F.col("p_partkey") % 16 + 1).cast("int"))
    declared = F.when(F.col("p_size") >= 40, F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", keys.style_weight(declared, style).alias("weight"))


# --- files -----------------------------------------------------------------------------------------------------------

# Every document is a file and a pin. A seventh of the files lie under another name, so their pins are missing and they are
# untracked; a fifth of the pins have another checksum.
_FILES = "files AS (SELECT 'docs/' || (doc_id % 9) || '/' || CASE WHEN doc_id % 7 = 0 THEN 'moved-' ELSE '' END || doc_id AS path, sha256(text) AS actual, doc_id FROM documents)"
_PINS = "pins AS (SELECT 'docs/' || (doc_id % 9) || '/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN sha256('x' || text) ELSE ' ' || upper(sha256(text)) END AS sha256, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'CC0' END AS license FROM documents)"


def files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.when(i % 7 == 0, "moved-").otherwise(""), i.cast("string"))
    return table(spark, d, "documents").select(F.concat(F.lit("docs/"), (i % 9).cast("string"), F.lit("/"), name).alias("path"), F.sha2("text", 256).alias("actual"))


def pins(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    sha = F.when(i % 5 == 0, F.sha2(F.concat(F.lit("x"), "text"), 256)).otherwise(F.concat(F.lit(" "), F.upper(F.sha2("text", 256))))
    return table(spark, d, "documents").select(F.concat(F.lit("docs/"), (i % 9).cast("string"), F.lit("/"), i.cast("string")).alias("path"), sha.alias("sha256"), F.when(i % 3 != 0, "CC0").alias("license"))


@plan(f"WITH {_FILES}, {_PINS} SELECT path, CASE WHEN actual IS NULL THEN 'missing' WHEN actual = lower(trim(sha256)) THEN 'ok' ELSE 'changed' END AS state, actual FROM pins LEFT JOIN files USING (path)")
def checksum_status(spark: SparkSession, d: str) -> DataFrame:
    return integrity.status(pins(spark, d), files(spark, d))


@plan(f"WITH {_FILES}, {_PINS} SELECT path FROM files WHERE regexp_replace(path, '/[^/]*$', '') IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM pins) AND path NOT IN (SELECT path FROM pins)")
def untracked(spark: SparkSession, d: str) -> DataFrame:
    return integrity.untracked(pins(spark, d), files(spark, d))


@plan("SELECT sha256(text) AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicate_names(table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/"), F.sha2("text", 256)).alias("path")))


@plan(f"WITH {_FILES}, {_PINS}, s AS (SELECT path, license, CASE WHEN actual IS NULL THEN 'missing' WHEN actual = lower(trim(sha256)) THEN 'ok' ELSE 'changed' END AS state FROM pins LEFT JOIN files USING (path)) SELECT count(*) AS n, count(*) FILTER (state = 'ok') AS n_ok, count(*) FILTER (license IS NULL) AS n_unlicensed, count(*) FILTER (state <> 'ok') AS n_to_fetch FROM s")
def asset_audit(spark: SparkSession, d: str) -> DataFrame:
    own = pins(spark, d)
    return integrity.status(own, files(spark, d)).join(own.select("path", "license"), "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "ok").alias("n_ok"), F.count_if(F.col("license").isNull()).alias("n_unlicensed"), F.count_if(F.col("state") != "ok").alias("n_to_fetch"))


@plan(f"SELECT page_id, url FROM pages WHERE regexp_matches(url, '{keys.glob_regex('http*://*[!0-4]')}')")
def glob_select(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").where(F.col("url").rlike(keys.glob_regex("http*://*[!0-4]"))).select("page_id", "url")


# --- colour, boxes, text ---------------------------------------------------------------------------------------------


def colours(spark: SparkSession, d: str, *more: str) -> DataFrame:
    h = F.sha2(F.col("p_partkey").cast("string"), 256)
    return table(spark, d, "part").select("p_partkey", *more, *(F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("rgb")))


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)"


_RGB = "rgb AS (SELECT p_partkey, ('0x' || substr(h, 1, 2))::INT AS r, ('0x' || substr(h, 3, 2))::INT AS g, ('0x' || substr(h, 5, 2))::INT AS b, p_brand FROM (SELECT p_partkey, p_brand, sha256(p_partkey::VARCHAR) AS h FROM part))"
_LUM = f"lum AS (SELECT p_partkey, p_brand, 0.2126 * {_lin('r')} + 0.7152 * {_lin('g')} + 0.0722 * {_lin('b')} AS lum FROM rgb)"


@plan(f"WITH {_RGB}, {_LUM} SELECT p_partkey, round(lum, 9) AS luminance FROM lum")
def luminance(spark: SparkSession, d: str) -> DataFrame:
    return colours(spark, d).select("p_partkey", F.round(color.luminance(F.col("r"), F.col("g"), F.col("b")), 9).alias("luminance"))


@plan(f"WITH {_RGB}, {_LUM} SELECT p_brand, round(quantile_cont(lum, 0.12), 9) AS low, round(quantile_cont(lum, 0.88), 9) AS high, round(avg(lum), 9) AS mean FROM lum GROUP BY p_brand")
def luminance_extremes(spark: SparkSession, d: str) -> DataFrame:
    own = colours(spark, d, "p_brand").withColumn("lum", color.luminance(F.col("r"), F.col("g"), F.col("b")))
    ends = quantiles.quantiles(own, "p_brand", F.col("lum"), {"low": 0.12, "high": 0.88})
    mean = own.groupBy("p_brand").agg(F.round(F.avg("lum"), 9).alias("mean"))
    return ends.join(mean, "p_brand").select("p_brand", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "mean")


@plan(f"""WITH {_RGB}, {_LUM}, q AS (SELECT p_partkey, lum AS lo, least(1, lum + 0.1) AS hi, 2.0::DOUBLE + p_partkey % 6 AS ratio, p_partkey % 5 < 3 AS dark FROM lum),
s AS (SELECT *, greatest(0, least(1, (lo + 0.05) / ratio - 0.05)) AS dl, greatest(0, least(1, (hi + 0.05) * ratio - 0.05)) AS ll FROM q),
a AS (SELECT *, (greatest(dl, lo) + 0.05) / (least(dl, lo) + 0.05) AS gd, (greatest(ll, hi) + 0.05) / (least(ll, hi) + 0.05) AS gl FROM s),
u AS (SELECT *, CASE WHEN dark THEN gd >= 0.995 * ratio OR gd >= gl ELSE NOT (gl >= 0.995 * ratio OR gl >= gd) END AS d FROM a)
SELECT p_partkey, d AS darker, round(CASE WHEN d THEN dl ELSE ll END, 9) AS luminance, round(CASE WHEN d THEN gd ELSE gl END, 6) AS achieved FROM u""")
def contrast_plan(spark: SparkSession, d: str) -> DataFrame:
    lum = color.luminance(F.col("r"), F.col("g"), F.col("b"))
    got = color.plan(lum, F.least(F.lit(1.0), lum + 0.1), 2.0 + F.col("p_partkey") % 6, F.col("p_partkey") % 5 < 3)
    return colours(spark, d).select("p_partkey", got.alias("x")).select("p_partkey", "x.darker", F.round("x.luminance", 9).alias("luminance"), F.round("x.achieved", 6).alias("achieved"))


_U = {p: draws.uniform_sql("p_partkey", p, space="colour") for p in ("hue", "saturation", "value")}


@plan(f"""WITH q AS (SELECT list_transform(string_split('{draws.beta_table(*color.SATURATION)}', ','), lambda x: x::DOUBLE) AS q),
u AS (SELECT p_partkey, {_U['hue']} * 6 AS h, {_U['saturation']} * {draws.STEPS} AS pos, 0.15 + {_U['value']} * 0.85 AS v FROM part),
s AS (SELECT p_partkey, h, v, q[floor(pos)::INT + 1] + (pos - floor(pos)) * (q[floor(pos)::INT + 2] - q[floor(pos)::INT + 1]) AS s FROM u, q),
c AS (SELECT p_partkey, s, v, unnest(['r', 'g', 'b']) AS k, unnest([(5 + h) % 6, (3 + h) % 6, (1 + h) % 6]) AS x FROM s),
f AS (SELECT p_partkey, k, round_even(255 * (v - v * s * greatest(0, least(x, 4 - x, 1))), 0)::INT AS c FROM c)
SELECT p_partkey, any_value(c) FILTER (k = 'r') AS r, any_value(c) FILTER (k = 'g') AS g, any_value(c) FILTER (k = 'b') AS b FROM f GROUP BY p_partkey""")
def random_colours(spark: SparkSession, d: str) -> DataFrame:
    u = [draws.uniform(F.col("p_partkey"), p, space="colour") for p in ("hue", "saturation", "value")]
    return table(spark, d, "part").select("p_partkey", color.random_colour(*u).alias("c")).select("p_partkey", "c.r", "c.g", "c.b")


def _pad(i: int) -> str:
    return f"(-0.04 + {draws.uniform_sql('l_orderkey * 10 + l_linenumber', 'pads', k=i)} * 0.39)"


@plan(f"""WITH b AS (SELECT l_orderkey, l_linenumber, (l_quantity * 3)::INT AS x, (l_linenumber * 5)::INT AS y, 20 + (l_quantity * 2)::INT AS w, 10 + l_linenumber::INT AS h, {', '.join(f'{_pad(i)} AS p{i}' for i in range(4))} FROM lineitem),
c AS (SELECT *, greatest(0, least(127, round_even(x - p0 * h, 0)::INT)) AS x0, greatest(0, least(23, round_even(y - p1 * h, 0)::INT)) AS y0, least(128, greatest(1, round_even(x + w + p2 * h, 0)::INT)) AS x1, least(24, greatest(1, round_even(y + h + p3 * h, 0)::INT)) AS y1 FROM b)
SELECT l_orderkey, l_linenumber, x0, y0, greatest(x1, x0 + 1)::INT AS x1, greatest(y1, y0 + 1)::INT AS y1 FROM c""")
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    u = [draws.between(draws.part(F.col("digest"), i), -0.04, 0.35) for i in range(4)]
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    box = color.crop_box(F.bround(q * 3).cast("int"), n * 5, 20 + F.bround(q * 2).cast("int"), 10 + n, u, F.lit(128), F.lit(24))
    own = table(spark, d, "lineitem").withColumn("digest", draws.digest(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "pads"))
    return own.select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.x0", "b.y0", "b.x1", "b.y1")


@plan(words.SQL)
def text_kinds(spark: SparkSession, d: str) -> DataFrame:
    return words.samples(table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@plan("SELECT i, CASE i % 4 WHEN 0 THEN t WHEN 1 THEN upper(t) WHEN 2 THEN lower(t) ELSE array_to_string(list_transform(regexp_extract_all(lower(t), '([\\p{L}]+|[^\\p{L}]+)'), lambda p: upper(p[1:1]) || p[2:]), '') END AS text FROM (SELECT doc_id AS i, replace(text, 'ß', 'ss') AS t FROM documents)")
def text_casing(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.replace(F.col("text"), F.lit("ß"), F.lit("ss")), F.col("doc_id")  # engines differ on its capital
    return table(spark, d, "documents").select(i.alias("i"), F.when(i % 4 == 0, t).when(i % 4 == 1, F.upper(t)).when(i % 4 == 2, F.lower(t)).otherwise(keys.title(t)).alias("text"))


@plan("SELECT kind, count(*) AS n FROM (" + words.SQL.strip() + ") GROUP BY kind")
def kind_summary(spark: SparkSession, d: str) -> DataFrame:
    return text_kinds(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@plan("SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN rtrim(substr(p_name, 1, 11)) || '…' ELSE p_name END AS name FROM part")
def shortened_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", keys.shortened(F.col("p_name"), 12).alias("name"))


# --- streaming -------------------------------------------------------------------------------------------------------


def _place(spark: SparkSession) -> str:
    """A folder that driver and executors share; a local session without one (tests) gets its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='tidemark-')}/stream-{uuid.uuid4().hex}"


@plan("SELECT event_id AS idx, event_type AS label, lag(event_type) OVER (ORDER BY event_id) AS pred FROM events")
def stream_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return processors.run_steps(spark, processors.event_stream(spark, d), processors.last_seen, _place(spark))


@plan("SELECT event_id AS idx, round(avg((event_type = 'click')::INT::DOUBLE) OVER (ORDER BY event_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 9) AS accuracy FROM events")
def stream_rolling_accuracy(spark: SparkSession, d: str) -> DataFrame:
    live = processors.event_stream(spark, d).withColumn("pred", F.lit("click"))
    return processors.run_steps(spark, live, processors.rolling_accuracy, _place(spark)).select("idx", F.round("accuracy", 9).alias("accuracy"))


@plan(f"WITH {_MAJOR.replace('row_number() OVER (ORDER BY event_id) - 1 AS idx', 'event_id AS idx')} SELECT idx, label, pred FROM p")
def stream_majority(spark: SparkSession, d: str) -> DataFrame:
    return processors.run_steps(spark, processors.event_stream(spark, d), processors.majority, _place(spark))


@plan("SELECT min(event_id) AS idx, event_type AS label, row_number() OVER (ORDER BY min(event_id)) AS n_seen FROM events GROUP BY event_type")
def stream_novelty(spark: SparkSession, d: str) -> DataFrame:
    return processors.run_steps(spark, processors.event_stream(spark, d), processors.novelty, _place(spark))


@plan("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return own.select(F.col("window.start").alias("hour"), "event_type", "n", "total")
