"""Language identification in two steps: the family first, then one-versus-one machines among its languages.

Texts become hashed character n-grams (1 to 3, letters in lower case, everything else one space). One-versus-one linear
support vector machines choose the family, further ones the language within it. Learned from a bounded sample of
labelled rows, never held out, of the MOST_LANGS languages with most rows (a tail of misspelt codes teaches nothing): each
different (id, text) is taken with probability cap / (rows of its language), where cap is PER_LANG, or SAMPLE shared over
the languages if that is less; twice SAMPLE rows are brought to the driver at most, by the order of their hashes.

Defined cases: a text that is null or has no letter is ``und`` with score 0; long texts are read whole. Rows without a
language teach nothing but are predicted. With one language only it is predicted for all, without any every row is
``und``. Repeated rows and null ids are predicted like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, spread
from .linear import sigmoid, svm

DIMS, PER_LANG, SAMPLE, MOST_LANGS = 4096, 700, 4000, 200
# Language codes by family. A code in none of them is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz tk ky tt",
    "indic": "hi bn ur pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "japonic": "ja",
    "koreanic": "ko",
    "malayic": "id ms jv tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points of the basic plane are letters; those beyond it count as letters."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x10000)])
    return _letters


def vector(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, of length 1."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    a = np.where((a >= 0x10000) | letters()[np.minimum(a, 0xFFFF)], a, 32)
    a = np.concatenate([[32], a, [32]]).astype(np.uint32)
    a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))]
    n1 = a * np.uint32(0x9E3779B1)
    n2 = n1[:-1] * np.uint32(31) + a[1:] * np.uint32(0x85EBCA6B)
    n3 = n2[:-1] * np.uint32(31) + a[2:] * np.uint32(0xC2B2AE35)
    h = np.concatenate([n1, n2, n3])
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
    v = np.sqrt(np.bincount(h, minlength=DIMS)).astype(np.float32)
    return v / np.linalg.norm(v)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Votes:
    """One-versus-one machines over some classes."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.names, self.pairs, ws, bs = names, list(combinations(range(len(names)), 2)), [], []
        for i, j in self.pairs:
            own = (y == i) | (y == j)
            w, b = svm(x[own], np.where(y[own] == i, 1.0, -1.0).astype(np.float32))
            ws.append(w)
            bs.append(b)
        self.w, self.b = np.array(ws, np.float32).reshape(len(ws), x.shape[1]), np.array(bs)

    def choose(self, v: np.ndarray) -> tuple[str, float]:
        """The class with most wins, then the largest sum of margins, and the logistic of its least margin."""
        if len(self.names) == 1:
            return self.names[0], 1.0
        m = self.w @ v + self.b
        wins, total, least = [np.zeros(len(self.names)) for _ in range(2)] + [np.full(len(self.names), np.inf)]
        for (i, j), d in zip(self.pairs, m):
            wins[i if d >= 0 else j] += 1
            total[i] += d
            total[j] -= d
            least[i] = min(least[i], d)
            least[j] = min(least[j], -d)
        k = max(range(len(self.names)), key=lambda c: (wins[c], total[c], -c))
        return self.names[k], float(sigmoid(3 * least[k]))


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        family = [_FAMILY.get(g.lower().split("-")[0], g) for g in langs]
        names = sorted(set(family))
        self.families = Votes(names, x, np.array([names.index(f) for f in family])) if names else None
        self.within = {}
        for f in names:
            at = [k for k, g in enumerate(family) if g == f]
            own = sorted({langs[k] for k in at})
            self.within[f] = Votes(own, x[at], np.array([own.index(langs[k]) for k in at]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or not has_letter(text):
            return "und", 0.0
        v = vector(text)
        family, a = self.families.choose(v)
        lang, b = self.within[family].choose(v)
        return lang, a * b


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learned from docs (doc_id, text, lang); what comes to the driver is MOST_LANGS counts and 2 * SAMPLE vectors at most."""
    own = docs.where(F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return Model(np.zeros((0, DIMS), np.float32), [])
    cap = max(1, min(per_lang, SAMPLE // len(sizes)))
    rate = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, cap / n))])
    # The text takes part in the draw, so rows without an id are drawn apart; equal rows are drawn once.
    at = F.xxhash64("doc_id", "text", F.lit(29))
    draw = F.pmod(at, F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, g, vector(t).tobytes()) for _, t, g, i in zip(*(c.to_pylist() for c in b.columns)) if has_letter(t)]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], names=["at", "lang", "v"])

    picked = own.where(draw < rate[F.col("lang")]).select("doc_id", "text", "lang", at.alias("at")).groupBy("at", "lang").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    picked = picked.orderBy("at", "lang").limit(2 * SAMPLE).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    got = picked.select("doc_id", "text", "lang", "at").mapInArrow(run, "at long, lang string, v binary").toPandas().sort_values(["at", "lang"])
    x = np.frombuffer(b"".join(got["v"]), np.float32).reshape(-1, DIMS)
    return Model(x, got["lang"].tolist())


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Predictions see nothing but the text."""
    src = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    model = docs.sparkSession.sparkContext.broadcast(fit(src, per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = src.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
