"""Corpus operators on what stands outside the easy form: wrapped notices, shared directions, near-monolingual sources."""

import random
import re

import numpy as np

from tidemark.llm import embedding_dedup, licenses, mixing


def brute_licences(text):
    """(license, dice, lines) over all windows of all lengths, the best ones first."""
    words, line = [], []
    for i, x in enumerate((text or "").split("\n")):
        own = re.findall("[a-z0-9]+", x.lower())
        words, line = words + own, line + [i] * len(own)
    grams, found = list(zip(words, words[1:])), []
    for name, t in licenses.TEMPLATES.items():
        b = {tuple(g.split()) for g in licenses.bigrams_of(t)}
        most = int(1.25 / 0.75 * len(b) + 1e-9)
        for i in range(len(grams)):
            for j in range(i, min(len(grams), i + most)):
                w = set(grams[i : j + 1])
                if grams[i] in b and grams[j] in b and (d := 2 * len(w & b) / (len(w) + len(b))) >= 0.75:
                    found.append((-d, -len(b), name, i, j))
    taken = []
    for x in sorted(found):
        if all(x[4] + 1 < y[3] or y[4] + 1 < x[3] for y in taken):
            taken.append(x)
    top = min(((d, name) for d, _, name, _, _ in taken), default=(0, None))
    return top[1], round(-top[0], 9) + 0.0, len({line[k] for *_, i, j in taken for k in range(i, j + 2)})


def test_licences_wrapped_and_embedded(spark, tmp_path):
    import duckdb

    r = random.Random(2)
    T = licenses.TEMPLATES
    wrap = lambda t, n: "\n# ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts = {
        0: "This code is released under the MIT License, see LICENSE.", 1: "/*\n# " + wrap(T["bsd"], 6) + "\n*/", 2: wrap(T["mit-grant"], 9), 3: "head\n" + wrap(T["gpl-notice"], 7) + "\n\nbody",
        4: "x " * 500 + T["apache-2.0-notice"] + " y" * 500, 5: T["mit"] + " " + T["mit"] + "\n" + T["cc0"], 6: T["mit"] + "\nUnder the table", 7: None, 8: "license", 9: "A licence of the license under the license.",
    }
    for i in range(10, 60):
        parts = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(list(T.values())).split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(["", "the", "license", "foo bar", "of the"])
            parts.append(" ".join(w))
        texts[i] = re.sub(" ", lambda m: r.choice([" "] * 6 + ["\n", "\n\n"]), r.choice([" ", "\n", " some words "]).join(parts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: tuple(x)[1:] for x in licenses.licenses(df).collect()}
    assert got == {i: brute_licences(t) for i, t in texts.items()}
    assert [got[i][0] for i in range(5)] == ["mit", "bsd", "mit-grant", "gpl-notice", "apache-2.0-notice"] and [got[i][2] for i in (0, 5, 6)] == [1, 2, 1]
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    assert {x[0]: x[1:] for x in c.sql(licenses.SQL).fetchall()} == got


def test_embeddings_that_share_a_direction(spark):
    r = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(0.83 * unit(r.standard_normal(64)) + 0.557 * unit(r.standard_normal((600, 64))))  # random pairs have cosine 0.69
    side = r.standard_normal(x.shape)
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    all_of = np.vstack([x, 0.932 * x + np.sqrt(1 - 0.932**2) * side])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(all_of)], "vec_id long, embedding array<double>, label int")
    want = (all_of @ all_of.T >= 0.93).sum(1) - 1
    got = {q["vec_id"]: q["n_links"] for q in embedding_dedup.near_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(all_of))])
    assert want.sum() >= 1200 and (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_raking_of_near_monolingual_sources(spark):
    r = np.random.default_rng(6)
    size = 10 ** r.uniform(4, 8, 20)
    cells = [(f"s{i}", g, "prose", int(size[i] * (0.98 if k == i % 4 else 0.02 / 3)) + 1) for i in range(20) for k, g in enumerate(("de", "en", "es", "fr"))]
    got = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")).collect()
    for d in ("source", "lang"):
        tokens, w = {}, {}
        for x in got:
            tokens[x[d]] = tokens.get(x[d], 0) + x["tokens"]
            w[x[d]] = w.get(x[d], 0) + x["w"]
        goals = {k: n**mixing.TEMPER for k, n in tokens.items()}
        assert max(abs(w[k] / (goals[k] / sum(goals.values())) - 1) for k in w) < 2 * mixing.TOLERANCE


def test_raking_reports_targets_that_cannot_be_met(spark):
    import pytest

    cells = spark.createDataFrame([("a", "en", "prose", 100), ("b", "en", "prose", 100), ("c", "de", "prose", 100)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off its target"):
        assert mixing.rake(cells).count() == 3
