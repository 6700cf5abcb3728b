"""Toxicity by a weighted grammar of composed finite-state transducers.

Words map to symbols (insult, threat, target, negation, reporting verb, quote, other). Per clause the symbols run
through the composition of three deterministic transducers: negation turns insults and threats in its reach into
harmless ones, reported speech turns those that follow a reporting verb into quoted ones, and the target transducer
joins what is left with a person addressed nearby, before or after. Its arcs emit matched events; a document's score is
the logistic of the summed arc weights of its events (each by the logarithm of one more than its count).

Arc weights, and insulting words and stems beyond the given ones, are learned from a bounded sample of labelled rows
(``PER_CLASS`` of each label) that are never held out. Learning keeps the order of the grammar (``arcs``): what is
negated or reported weighs no more than the same word alone, a targeted word no less; one targeted clause or threat is
enough to pass 0.5, one isolated word is not. Weights are pulled towards the built-in ones, so arcs that the sample
hardly takes keep theirs. Learned entries that clean rows hardly hold become insults; those that are merely much more
frequent in toxic rows become slurs, whose arc has a weight of its own.

Defined cases: null, empty and word-less texts match nothing and get the score of no event. A text is read whole,
clause by clause. Repeated rows and null ids are scored like others. With no labels, or labels of one class only, the
built-in arc weights apply.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, spread, written
from .linear import logistic_towards, sigmoid

# Word lists of the grammar, by symbol.
WORDS = {
    "I": "idiot idiots moron morons imbecile imbeciles stupid dumbass loser losers scum trash clown clowns pathetic worthless disgusting vermin filth bastard bastards bitch jerk retard retarded degenerate freak pig swine asshole "
    "imbécile crétin crétine abruti abrutie connard connasse salaud ordure débile minable dégoûtant "
    "dummkopf vollidiot trottel arschloch abschaum versager widerlich erbärmlich drecksack "
    "idiota imbécil estúpido estúpida gilipollas cabrón basura escoria asqueroso patético inútil",
    "T": "kill murder strangle hurt destroy stab shoot beat crush hang tuer tuerai crever frapper töten umbringen schlagen matar mataré matarte golpear",
    "Y": "you your youre you're u he she they them him her these those everyone tu toi te vous ton ta tes du dich dir ihr euch dein deine tú te ti usted ustedes vosotros",
    "N": "not no never isn't aren't wasn't don't doesn't isnt arent ne pas jamais non nicht kein keine nie niemals nunca jamás",
    "R": "said says say saying called quoted quote reported reports claimed claims wrote writes alleged according word words term dit écrit déclaré mot sagte sagt schrieb behauptet wort dijo dice escribió según palabra",
}
REACH = 3
EVENTS = ("insult", "targeted", "negated", "reported", "threat", "slur")
HARM = "ITM"
#: Arc weights before anything is learned, and the weight of no event.
PRIOR, NOTHING = (3.5, 6.0, 0.5, 0.75, 6.0, 1.0), -3.0
#: One targeted clause or threat scores at least the first, one isolated word at most the second.
CLAUSE, ALONE = 0.7, 0.4
#: How strongly weights are pulled towards the built-in ones.
PULL = 1e-3
PER_CLASS = 4000
#: A word or stem is learned if this share of the toxic sample holds it, so many times the share of the others that do;
#: it is an insult rather than a slur if the others' share is at most LEARN_LEAK of it. At most LEARN_MOST are.
LEARN_SHARE, LEARN_LIFT, LEARN_LEAK, LEARN_MOST, STEM = 0.03, 5.0, 0.02, 60, range(3, 9)

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]|[\"“”«»]")
_WORD, _HARM = re.compile(r"[^\W_]+"), frozenset(HARM)
_END, _QUOTE = frozenset(".!?;:\n"), frozenset("\"“”«»")

State, Symbol = int, str
Step = Callable[[State, Symbol], tuple[State, Symbol]]


def negation(state: State, s: Symbol) -> tuple[State, Symbol]:
    """State: how many more words a negation reaches."""
    if s == "N":
        return REACH, s
    if s in HARM and state:
        return state - 1, "i"
    return max(0, state - 1), s


def reported(state: State, s: Symbol) -> tuple[State, Symbol]:
    """State: 0 outside, 1 after a reporting verb, 2 within a quote opened after one. A quote that closes ends it."""
    if s == "R":
        return max(state, 1), s
    if s == "Q":
        return (2 if state == 1 else 0), s
    return state, "r" if state and s in HARM else s


def target(state: State, s: Symbol) -> tuple[State, Symbol]:
    """State: kind (0 nothing, 1 target, 2 insult, 3 threat) * 8 + words left in reach. Emits events as digits, 'O' for none."""
    kind, left = divmod(state, 8)
    if not left:
        kind = 0
    if s == "Y":
        if kind == 2:
            return 0, "1"
        if kind == 3:
            return 0, "4"
        return 8 + REACH, "O"
    if s == "I":
        return (0, "1") if kind == 1 else (16 + REACH, "0")
    if s == "M":
        return (0, "1") if kind == 1 else (16 + REACH, "5")
    if s == "T":
        return (0, "4") if kind == 1 else (24 + REACH, "O")
    if s in "ir":
        return (0, "2") if s == "i" else (0, "3")
    return (kind * 8 + left - 1 if left else 0), "O"


def compose(*steps: Step) -> Callable[[tuple[State, ...], Symbol], tuple[tuple[State, ...], Symbol]]:
    """The composition of deterministic transducers; arcs of the product are made when first taken."""

    @lru_cache(None)
    def arc(states: tuple[State, ...], s: Symbol) -> tuple[tuple[State, ...], Symbol]:
        out = []
        for step, state in zip(steps, states):
            state, s = step(state, s)
            out.append(state)
        return tuple(out), s

    return arc


GRAMMAR = compose(negation, reported, target)
START = (0, 0, 0)


class Lexicon(dict):
    """word -> symbol, filled as words are met. Entries that end in * are stems; an exact entry holds before a stem, a longer stem before a shorter one."""

    def __init__(self, learned: dict[str, Symbol], without: frozenset[str]) -> None:
        self.words: dict[str, Symbol] = {}
        for s, words in WORDS.items():
            for w in words.split():
                if not (s in HARM and w in without):
                    self.words.setdefault(w, s)
        self.words |= {w: s for w, s in learned.items() if w[-1] != "*"}
        self.stems = {w[:-1]: s for w, s in learned.items() if w[-1] == "*"}

    def __missing__(self, word: str) -> Symbol:
        s = self.words.get(word) or next((self.stems[word[:k]] for k in reversed(STEM) if word[:k] in self.stems), None) or self.words.get(re.split("['\u2019]", word)[0], "O")
        if len(self) >= 200_000:
            self.clear()
        self[word] = s
        return s

    def __reduce__(self) -> tuple:
        return _lexicon, (self.words, self.stems)


def _lexicon(words: dict[str, Symbol], stems: dict[str, Symbol]) -> Lexicon:
    out = Lexicon({}, frozenset())
    out.words, out.stems = words, stems
    return out


def events(text: str | None, lexicon: Lexicon) -> list[int]:
    """How often each of EVENTS is matched in a whole text."""
    n = [0] * len(EVENTS)
    low = (text or "").lower()
    if _HARM.isdisjoint(map(lexicon.__getitem__, set(_WORD.findall(low)))):
        return n
    state = START
    for t in _TOKEN.findall(low):
        if t in _END:
            state = START
            continue
        state, out = GRAMMAR(state, "Q" if t in _QUOTE else lexicon[t])
        if out.isdigit():
            n[int(out)] += 1
    return n


class Model:
    def __init__(self, learned: dict[str, Symbol] | None = None, without: frozenset[str] = frozenset(), weights: tuple[float, ...] = PRIOR, bias: float = NOTHING) -> None:
        self.lexicon, self.weights, self.bias = Lexicon(learned or {}, without), np.array(weights), bias

    def features(self, text: str | None) -> np.ndarray:
        return np.log1p(events(text, self.lexicon))

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.features(text) @ self.weights + self.bias))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A Model learned from the sample; what comes to the driver is its word statistics above LEARN_SHARE and an event vector a row."""
    sample = written(labelled_sample(docs, labels, "toxic", per_class))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = set(_WORD.findall((t or "").lower()))
                n[y].update(own | {w[:k] + "*" for w in own for k in STEM if len(w) >= k})
            rows = [(w, n[1][w], n[0][w]) for w in n[1]]  # what no toxic row of the batch holds can only count against
            rows += [(w, 0, k) for w, k in n[0].items() if w not in n[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["word", "toxic", "clean"])

    seen = sample.select("text", "label").mapInArrow(words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = F.col("toxic") / sizes[1], F.col("clean") / sizes[0]
    apart = F.col("toxic") / sizes[1] - 3 * F.col("clean") / sizes[0]
    found = seen.where((rate[0] >= LEARN_SHARE) & (rate[0] >= LEARN_LIFT * rate[1]) & (F.col("toxic") >= 5)).orderBy(apart.desc(), F.length("word").desc(), "word").limit(LEARN_MOST * 20).collect()
    learned: dict[str, Symbol] = {}
    for r in found:
        w, leak = r["word"], r["clean"] / sizes[0] / (r["toxic"] / sizes[1])
        stem = w.rstrip("*")
        if len(learned) < LEARN_MOST and not any(stem.startswith(x.rstrip("*")) or x.startswith(stem) for x in learned):
            learned[w] = "I" if leak <= LEARN_LEAK else "M"
    known = sorted(w for s in "IT" for w in WORDS[s].split())
    without = frozenset(r["word"] for r in seen.where(F.col("word").isin(known) & (rate[1] > rate[0])).collect())
    plain = frozenset(w for s in "YNR" for w in WORDS[s].split())
    learned = {w: s for w, s in learned.items() if w not in plain}
    model = Model(learned, without)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    got = sample.select("text", "label").mapInArrow(matched, "x array<double>, label int").toPandas()
    w, bias = arcs(np.array(got["x"].tolist()), got["label"].to_numpy(float))
    return Model(learned, without, tuple(w), bias)


def arcs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of events x for labels y, in the order that the grammar gives them.

    Every weight is a sum of parts that are not negative: an insult weighs what a negated and a reported one weigh and
    more, a targeted insult and a threat what an insult weighs and more. The parts are fitted, pulled towards those of
    PRIOR. Then targeted clauses and threats are lifted to CLAUSE and isolated words held to ALONE.
    """
    insult, targeted, negated, said, threat, slur = range(len(EVENTS))
    parts = [(negated, insult, targeted, threat), (said, insult, targeted, threat), (insult, targeted, threat), (targeted,), (threat,), (slur,)]
    to = np.zeros((len(EVENTS), len(parts)))
    for k, events_of in enumerate(parts):
        to[list(events_of), k] = 1
    own, bias = logistic_towards(x @ to, y, np.maximum(np.linalg.solve(to, np.array(PRIOR)), 0), NOTHING, PULL)
    w = to @ own
    once = np.log1p(1)
    for e in (targeted, threat):
        w[e] = max(w[e], (np.log(CLAUSE / (1 - CLAUSE)) - bias) / once)
    w[insult] = min(w[insult], (np.log(ALONE / (1 - ALONE)) - bias) / once)
    for e in (negated, said):
        w[e] = min(w[e], w[insult])
    return w, bias


def score_udf(model: Model) -> Callable[[Column], Column]:
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([model.score(x) for x in t], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    src = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    scored = src.select("doc_id", held_out().alias("held_out"), score_udf(fit(src, labels, per_class))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    return spread(docs).where(score_udf(model)(F.col("text")) < threshold)
