"""Learned operators against scorers written out in plain Python, on the fitted models, and on held-out labels."""

import math
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in labels.collect()}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def clauses(text):
    """Lists of words and quotes between stops."""
    out = [[]]
    for t in re.findall(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]|[\"“”«»]", (text or "").lower()):
        out.append([]) if t in ".!?;:\n" else out[-1].append(t)
    return out


def slow_events(text, lexicon):
    """Events clause by clause: first which words are negated, then which are reported, then who is meant."""
    n = dict.fromkeys(toxicity.EVENTS, 0)
    for clause in clauses(text):
        kinds = ["Q" if w in "\"“”«»" else lexicon[w] for w in clause]
        for i in [k for k, s in enumerate(kinds) if s == "N"]:
            for k in range(i + 1, min(len(kinds), i + 1 + toxicity.REACH)):
                if kinds[k] == "N":
                    break
                if kinds[k] in "ITM":
                    kinds[k] = "i"
        speaking, quoted = False, False
        for k, s in enumerate(kinds):
            if s == "Q":
                speaking, quoted = False, speaking and not quoted
            elif s == "R":
                speaking = not quoted
            elif s in "ITM" and (speaking or quoted):
                kinds[k] = "r"
        last, at = None, -9
        for k, s in enumerate(kinds):
            near = last if k - at <= toxicity.REACH else None
            if s == "Y":
                if near in ("I", "T"):
                    n["targeted" if near == "I" else "threat"] += 1
                    last = None
                else:
                    last, at = "Y", k
            elif s in "IM":
                if near == "Y":
                    n["targeted"] += 1
                    last = None
                else:
                    n["insult" if s == "I" else "slur"] += 1
                    last, at = "I", k
            elif s == "T":
                if near == "Y":
                    n["threat"] += 1
                    last = None
                else:
                    last, at = "T", k
            elif s in "ir":
                n["negated" if s == "i" else "reported"] += 1
                last = None
    return [n[e] for e in toxicity.EVENTS]


def slow_score(text, m):
    x = sum(w * math.log(1 + k) for w, k in zip(m.weights.tolist(), slow_events(text, m.lexicon))) + m.bias
    return 1 / (1 + math.exp(-x))


SAID = ["you are an idiot", "the word idiot", "I will kill you", "idiot", "you are not an idiot", "he said you idiot", "she called him \"idiot\" and moron", "not you, idiot. kill them!", "say \"kill you\" you idiot scum", "never you fool no idiot you", None, "", "...\n\"\"", "du bist ein vollidiot", "idiot idiot you you kill kill"]


def test_grammar_against_clauses(corpus):
    lexicon = toxicity.Model().lexicon
    for t in [*SAID, *(r["text"] for r in corpus[2].values())]:
        assert toxicity.events(t, lexicon) == slow_events(t, lexicon), t


def test_fitted_grammar_keeps_its_order(spark, corpus):
    docs, labels, rows, known = corpus
    m = toxicity.fit(docs.select("doc_id", "text"), labels)
    w = dict(zip(toxicity.EVENTS, m.weights))
    assert w["targeted"] >= w["insult"] >= max(w["negated"], w["reported"]) >= 0 and w["threat"] >= w["insult"]
    clause, alone, threat, quoted, negated = (m.score(t) for t in ("you are an idiot", "idiot", "I will kill you", "the word idiot", "you are not an idiot"))
    assert clause > 0.5 > alone > quoted and threat > 0.5 > negated and clause >= toxicity.CLAUSE - 1e-9 and alone <= toxicity.ALONE + 1e-9
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, r in got.items():
        want = slow_score(rows[i]["text"], m)
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(want >= 0.5) and r["held_out"] == held(i)


def test_held_out_toxicity(spark):
    """On the larger table, whose sample holds enough toxic rows to learn words from."""
    d = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels)
    out = [(r["predicted"], r["toxic"]) for r in scored.where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()]
    assert len(out) > 500 and sum(a != b for a, b in out) <= 0.02 * len(out)
    assert sum(a for a, b in out if not b) <= 0.005 * len(out)


def test_arcs_when_labels_contradict_the_grammar():
    import numpy as np

    x = np.zeros((400, 6))
    x[:200, 0] = np.log1p(3)  # toxic rows: isolated words only
    x[200:300, 1] = np.log1p(1)  # clean rows: targeted clauses
    w, bias = toxicity.arcs(x, np.repeat([1.0, 0.0], 200))
    assert w[1] >= w[0] >= max(w[2], w[3]) and 1 / (1 + np.exp(-(w[1] * np.log(2) + bias))) >= toxicity.CLAUSE - 1e-9


# --- quality ---------------------------------------------------------------------------------------------------------


def slow_features(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, white = len(words), b" \t\n\x0b\x0c\r"
    upper = sum(65 <= c <= 90 for c in raw)
    letters = upper + sum(97 <= c <= 122 or c >= 128 for c in raw)
    digits = sum(48 <= c <= 57 for c in raw)
    symbol = lambda c: not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128 or 48 <= c <= 57 or c in white or c in b".,;:'\"-()?")
    solid = sum(c not in white for c in raw)
    count, lines = Counter(words), [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log(1 + n), upper / max(1, letters), sum(map(symbol, raw)) / solid, digits / solid, sum(symbol(w[-1]) for w in words) / n, sum(len(w) > 14 for w in words) / n, sum(len(w) < 3 for w in words) / n,
        1 - len(count) / n, max(count.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, count[b"|"] / n, 1 - len(set(lines)) / len(lines), min(1.0, len(zlib.compress(raw, 1)) / len(raw)), min(sum(map(len, words)) / n, 40) / 10,
    ]


def test_quality_against_its_weights(spark, corpus):
    docs, labels, rows, known = corpus
    m = quality.fit(docs.select("doc_id", "text"), labels)
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert got.keys() == rows.keys()
    for i, r in got.items():
        x = slow_features(rows[i]["text"])
        x += [math.sqrt(max(v, 0)) for v in x]
        z = sum(w * min(8, max(-8, (v - a) / s)) for w, v, a, s in zip(m.weights, x, m.mean, m.scale))
        want = 1 / (1 + math.exp(-min(40, max(-40, (z - m.cut) / m.spread + math.log(0.3 / 0.7)))))
        assert r["score"] == pytest.approx(want, abs=1e-6) and (r["predicted"] == int(want >= 0.3) or abs(want - 0.3) < 1e-6) and r["held_out"] == held(i)
    out = [(got[i]["predicted"], k["quality"]) for i, k in known.items() if held(i) and k["quality"] is not None]
    assert len(out) > 50 and sum(a != b for a, b in out) <= 0.04 * len(out)


# --- language --------------------------------------------------------------------------------------------------------


def slow_vector(text):
    """Hashed 1- to 3-grams of letters with single blanks between, one by one."""
    chars = [32]
    for c in (text or "").lower():
        code = ord(c) if ord(c) >= 0x10000 or c.isalpha() else 32
        if code != 32 or chars[-1] != 32:
            chars.append(code)
    if chars[-1] != 32:
        chars.append(32)
    m, v = 1 << 32, [0] * langid.DIMS
    for i in range(len(chars)):
        h = 0
        for n in range(3):
            if i + n < len(chars):
                h = (chars[i] * 0x9E3779B1 if n == 0 else h * 31 + chars[i + n] * (0x85EBCA6B, 0xC2B2AE35)[n - 1]) % m
                x = ((h ^ (h >> 15)) * 0x2C1B3C6D % m) >> 20
                v[x] += 1
    size = math.sqrt(sum(v))
    return [math.sqrt(k) / size for k in v]


def slow_choice(votes, v):
    if len(votes.names) == 1:
        return votes.names[0]
    wins, total = Counter(), Counter()
    for (i, j), w, b in zip(votes.pairs, votes.w.tolist(), votes.b.tolist()):
        d = sum(a * c for a, c in zip(w, v) if c) + b
        wins[i if d >= 0 else j] += 1
        total[i] += d
        total[j] -= d
    return votes.names[max(range(len(votes.names)), key=lambda k: (wins[k], total[k], -k))]


def test_language_against_its_machines(spark, corpus):
    docs, _, rows, _ = corpus
    m = langid.fit(docs.select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    short = [i for i, r in rows.items() if r["text"] is not None and len(r["text"]) < 1500][:120]
    for i in short:
        if not any(c.isalpha() for c in rows[i]["text"]):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        v = slow_vector(rows[i]["text"])
        assert got[i]["lang_pred"] == slow_choice(m.within[slow_choice(m.families, v)], v), i
    out = [(got[i]["lang_pred"], r["lang"]) for i, r in rows.items() if held(i) and r["lang"] is not None and any(c.isalpha() for c in r["text"] or "")]
    assert len(out) > 100 and sum(a != b for a, b in out) <= 0.03 * len(out)


def test_language_learns_from_bounded_rows_of_dirty_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 30)  # machines grow as its square
    rows = [(None, f"the house number {'abcdefghij'[i % 10]} of {'klmnopqrst'[i // 10 % 10]}", "en", None) for i in range(300)] + [(i, "das haus und der garten", "de", None) for i in range(50)] + [(1000 + i, f"some words {i}", f"xx{i}", None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = langid.fit(df.select("doc_id", "text", "lang"))
    known = {g for votes in m.within.values() for g in votes.names}
    assert {"en", "de"} <= known and len(known) <= langid.MOST_LANGS
    got = {r["lang_pred"] for r in langid.identify(df).where("doc_id is null").collect()}
    assert got == {"en"}


# --- odd rows --------------------------------------------------------------------------------------------------------


def test_odd_rows_have_the_scores_of_their_texts(spark, docs, labels, texts):
    tox, qual = toxicity.fit(docs.select("doc_id", "text"), labels), quality.fit(docs.select("doc_id", "text"), labels)
    src = [(r["doc_id"], r["text"]) for r in docs.collect()]
    import numpy as np

    for run, score in ((toxicity.toxicity, lambda t: slow_score(t, tox)), (quality.quality, lambda t: float(qual.score(np.array([slow_features(t)]))[0]))):
        got = run(docs, labels).collect()
        want = Counter((i, held(i), round(score(t), 6)) for i, t in src)  # null, empty and very long texts, repeated rows, null ids
        assert Counter((r["doc_id"], r["held_out"], round(r["score"], 6)) for r in got) == want
    again = docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(docs.selectExpr("doc_id", "'you idiot'"))
    sample = __import__("tidemark.llm.common", fromlist=["x"]).labelled_sample(again, labels.union(labels), "toxic", 5).collect()
    assert len(sample) == len({r["doc_id"] for r in sample}) <= 10
