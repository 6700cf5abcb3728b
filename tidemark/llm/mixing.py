"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed per cell (source, language, topic): a partial aggregate, so a hot source costs a row a task. The cell
weights are then raked in turn to the target share of each source, language and topic until the marginals agree within
TOLERANCE (the largest relative error of any), and a document is kept with the probability weight * scale / tokens of its cell. The scale makes the expected kept tokens equal
``rate`` of all, with cells whose probability would pass 1 kept whole and the rest scaled up to make up for them. No task
holds all cells, only those of one value of a dimension, which are as many as the combinations of the other two, not as
the documents; single numbers alone reach the driver. The
draw is a hash of the id, so it is repeatable and independent of partitioning. The probabilities, a row a cell, are
written first (raking writes them every ROUNDS rounds): Spark then knows their size, broadcasts them under its limit and shuffles documents only beyond it.

A document's topic is the subject of which it holds most different words (SUBJECTS, the first on ties); a text without
any such word has a register by its marks instead (MARKS), ``prose`` if it has none.

Targets are shares by value, or where a dimension has none, its observed token shares to the power ``TEMPER``, so rare
values are raised and frequent ones lowered.

Targets that no weights on the cells at hand can meet never agree. Raking then ends when ROUNDS more rounds leave
the error and all cells as they are, or after MOST rounds, and warns of the error that is left.

Defined cases: a null source or language counts as ``unknown``, a null or empty text as one token, a null id draws by
the empty string. A value without a target in an explicit dict has target 0 and is never kept; targets of values that no
row has are spread over the others. Repeated rows draw alike. An empty table gives an empty result. Other columns,
whatever their names, are ignored or, in mixed_rows, kept.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

DIMS = ("source", "lang", "topic")
TEMPER, RATE, SEED = 0.5, 0.6, "mix-1"
TOLERANCE, ROUNDS, MOST = 1e-6, 8, 800
#: Cells up to which one task rakes them: some megabytes.
FEW = 1 << 16
#: Raking has come to its end if ROUNDS rounds change the error by less than the first share and no cell by more than the second.
STALL, MOVED = 1e-6, 1e-9
# Words that tell a subject, between blanks and in lower case.
SUBJECTS = {
    "computing": "algorithm browser byte cache compiler database download email keyboard laptop network password program server software website",
    "finance": "bank bond budget credit currency debt dividend income inflation interest investment invoice loan mortgage shares tax",
    "health": "blood cancer clinic diagnosis disease doctor dose hospital infection nurse patient surgery symptoms therapy treatment vaccine",
    "law": "appeal attorney contract court criminal defendant evidence judge jury lawsuit lawyer legal plaintiff sentence testimony verdict",
    "science": "atom biology cell chemistry electron energy experiment galaxy gene hypothesis laboratory molecule physics planet protein theory",
    "sport": "athlete ball championship coach cup defeat football goal league match player score season stadium team tournament",
}
#: Registers of texts without a subject, by the first mark that they hold.
MARKS = (("table", " | "), ("loud", "!!"), ("symbols", "$$$"), ("contact", "@"), ("web", "http"), ("licence", "icense"))
BYTES_PER_TOKEN = 4


def topic_of(text: Column) -> Column:
    register = reduce(lambda rest, t: F.when(text.contains(t[1]), t[0]).otherwise(rest), reversed(MARKS), F.lit("prose"))
    told = F.array_intersect(F.split(F.lower(text), " ", -1), F.array(*(F.lit(w) for own in SUBJECTS.values() for w in own.split())))

    def best(words: Column) -> Column:
        counts = F.array(*(F.struct(F.size(F.array_intersect(words, F.array(*map(F.lit, own.split())))).alias("n"), F.lit(-i).alias("turn"), F.lit(k).alias("topic")) for i, (k, own) in enumerate(SUBJECTS.items())))
        return F.when(F.size(words) > 0, F.array_max(counts)["topic"]).otherwise(register)

    # Bound once by a transform, so that the text is split once.
    return F.element_at(F.transform(F.array(told), best), 1)


def described(docs: DataFrame, p: str = "") -> DataFrame:
    """docs with the columns source, lang, topic, n_tokens, draw, their names after the prefix p."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return docs.withColumns({
        p + "source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), p + "lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")), p + "topic": topic_of(text),
        p + "n_tokens": F.greatest(F.lit(1).cast("long"), F.floor(F.octet_length(text) / BYTES_PER_TOKEN)), p + "draw": draw,
    })


def summed(cells: DataFrame, d: str, value: str, name: str) -> DataFrame:
    return cells.groupBy(d).agg(F.sum(value).alias(name))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, most: int = MOST) -> DataFrame:
    """cells (source, lang, topic, tokens) with w: the share of the mix, raked to the targets of every dimension.

    FEW cells or less are raked by one task, without shuffles between the steps; more go by the values of each dimension.
    """
    cells = written(cells.withColumn("tokens", F.col("tokens").cast("double")))
    total, many = cells.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if total is None:
        return cells.withColumn("w", F.lit(0.0))
    together = lambda df: df.coalesce(1) if many <= FEW else df
    own = together(cells).withColumn("w", F.col("tokens") / total)
    for d in DIMS:
        if targets and d in targets:
            goal = reduce(lambda rest, t: F.when(F.col(d) == t[0], float(t[1])).otherwise(rest), targets[d].items(), F.lit(0.0))
        else:
            goal = F.pow(F.col("t"), F.lit(TEMPER))
        values = summed(cells, d, "tokens", "t").select(d, goal.alias("goal"))
        every = values.agg(F.sum("goal")).first()[0]
        own = own.join(values.select(d, (F.col("goal") / every).alias("goal_" + d)), d)
    last = written(own)
    err, before = 1.0, None
    for done in range(ROUNDS, most + ROUNDS, ROUNDS):
        own = together(last).drop("w0").withColumn("w0", F.col("w"))
        for _ in range(ROUNDS):
            for d in DIMS:
                share = f"sum(w) OVER (PARTITION BY {d})"
                own = own.withColumn("w", F.expr(f"CASE WHEN {share} > 0 THEN w * goal_{d} / {share} ELSE 0D END"))
        new = written(own)
        discard(last)
        last = new
        off = reduce(DataFrame.union, (together(new).groupBy(d).agg(F.sum("w").alias("sum"), F.max("goal_" + d).alias("goal")).select(F.when(F.col("goal") > 0, F.abs(F.col("sum") / F.col("goal") - 1)).otherwise(0.0).alias("off")) for d in DIMS))
        was, err, moved = err, off.agg(F.max("off")).first()[0], new.agg(F.max(F.abs(F.col("w") - F.col("w0")))).first()[0]
        if err <= tolerance or (abs(was - err) <= STALL * err and moved <= MOVED):
            break
    if err > tolerance:
        warnings.warn(f"mixing: after {done} rounds a marginal is still {err:.2g} off its target", stacklevel=2)
    return last.select(*DIMS, "tokens", "w")


def calibrated(raked: DataFrame, rate: float = RATE) -> DataFrame:
    """raked with p, the probability of keeping a document of the cell.

    Cells that the scale lifts past 1 are kept whole and the scale of the others is set anew, until it lifts no further
    one past 1. It only rises, so every cell is passed once at most; as a rule it settles in a few steps.
    """
    r = F.col("w") / F.col("tokens")
    total = raked.agg(F.sum("tokens")).first()[0] or 0.0
    scale, full = rate * total, 0
    while True:
        over = scale * r > 1
        n, used, spent, left = raked.agg(F.count_if(over), F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(over, F.col("w"))), F.count_if(~over)).first()
        if n == full or not left:
            break
        full, scale = n, max(scale, (rate * total - (used or 0.0)) / max(1 - (spent or 0.0), 1e-12))
    return raked.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(float(scale)) * r))).select(*DIMS, "w", "p")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, sampled."""
    own = written(described(docs.select("doc_id", "text", "source", "lang")).drop("text"))  # texts are read once
    cells = own.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    p = written(calibrated(rake(cells, targets), rate).select(*DIMS, "p"))
    return own.join(p, list(DIMS)).select("doc_id", *DIMS, "n_tokens", F.round("p", 9).alias("probability"), (F.col("draw") < F.col("p")).alias("sampled"))


def mixed_rows(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE) -> DataFrame:
    """The sampled rows of docs, with their columns as they are."""
    cells = described(docs.select("doc_id", "text", "source", "lang")).groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    p = written(calibrated(rake(cells, targets), rate)).select(*(F.col(d).alias("__mix_" + d) for d in DIMS), F.col("p").alias("__mix_p"))
    return described(docs, "__mix_").join(p, ["__mix_" + d for d in DIMS]).where(F.col("__mix_draw") < F.col("__mix_p")).select(*(F.col(f"`{c}`") for c in docs.columns))


def _sql() -> str:
    register = "CASE " + " ".join(f"WHEN contains(t, '{mark}') THEN '{name}'" for name, mark in MARKS) + " ELSE 'prose' END"
    lists = {k: "[" + ", ".join(f"'{w}'" for w in own.split()) + "]" for k, own in SUBJECTS.items()}
    counts = ", ".join(f"{{'n': len(list_filter({own}, lambda w: list_contains(words, w))), 'turn': {-i}, 'topic': '{k}'}}" for i, (k, own) in enumerate(lists.items()))
    topic = f"CASE WHEN list_max([{counts}]).n > 0 THEN list_max([{counts}]).topic ELSE {register} END"
    steps, last = [], "g0"
    for d in DIMS:
        steps.append(f"{last}_{d} AS (SELECT * EXCLUDE (part), goal_{d} / sum(part) OVER () AS t_{d} FROM (SELECT *, goal_{d} / count(*) OVER (PARTITION BY {d}) AS part FROM {last}))")
        last = f"{last}_{d}"
    at, round_ = last, f"(SELECT * REPLACE (CASE WHEN k % {ROUNDS} = 0 THEN w ELSE w0 END AS w0) FROM m)"
    for d in DIMS:
        round_ = f"(SELECT * REPLACE (CASE WHEN s > 0 THEN w * t_{d} / s ELSE 0 END AS w) FROM (SELECT * EXCLUDE (s), sum(w) OVER (PARTITION BY {d}) AS s FROM {round_}))"
    off = ", ".join(f"CASE WHEN t_{d} > 0 THEN abs(sum(w) OVER (PARTITION BY {d}) / t_{d} - 1) ELSE 0 END" for d in DIMS)
    cols = "source, lang, topic, tokens, " + ", ".join(f"t_{d}" for d in DIMS)
    steps.append(f"""m AS (SELECT {cols}, w, 0::DOUBLE AS s, 0 AS k, 1::DOUBLE AS err, 2::DOUBLE AS was, w AS w0, 0::DOUBLE AS moved FROM {at}
  UNION ALL
  SELECT {cols}, w, s, k + 1, CASE WHEN (k + 1) % {ROUNDS} = 0 THEN max(e) OVER () ELSE err END, CASE WHEN (k + 1) % {ROUNDS} = 0 THEN err ELSE was END, w0, max(abs(w - w0)) OVER ()
  FROM (SELECT *, greatest({off}) AS e FROM {round_}) WHERE k % {ROUNDS} <> 0 OR k = 0 OR (k < {MOST} AND err > {TOLERANCE} AND NOT (abs(was - err) <= {STALL} * err AND moved <= {MOVED})))""")
    last = "(SELECT * FROM m WHERE k = (SELECT max(k) FROM m))"
    return f"""
WITH RECURSIVE own AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {topic} AS topic,
         greatest(1, strlen(t) // {BYTES_PER_TOKEN})::BIGINT AS n_tokens,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS draw
  FROM (SELECT *, coalesce(text, '') AS t, string_split(lower(coalesce(text, '')), ' ') AS words FROM documents)),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM own GROUP BY ALL),
g0 AS (SELECT *, tokens / sum(tokens) OVER () AS w, {', '.join(f'pow(sum(tokens) OVER (PARTITION BY {d}), {TEMPER}) AS goal_{d}' for d in DIMS)} FROM cells),
{', '.join(steps)},
c AS (SELECT *, w / tokens AS r FROM {last}),
b AS (SELECT *, coalesce(sum(tokens) OVER o, 0) AS used, coalesce(sum(w) OVER o, 0) AS spent, sum(tokens) OVER () AS total FROM c
      WINDOW o AS (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, ({RATE} * total - used) / greatest(1 - spent, 1e-12) AS scale FROM b),
p AS (SELECT source, lang, topic, least(1, greatest(0, coalesce(max(CASE WHEN scale * r <= 1 THEN scale END) OVER () * r, 1))) AS p FROM s)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS probability, draw < p AS sampled
FROM own JOIN p USING (source, lang, topic)"""


SQL = _sql()
