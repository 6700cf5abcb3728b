"""Rows without an id that are only near others, and bridges without an id, against brute force over all rows."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import embedding_dedup, minmax_dedup, quality


def component_ids(ids, near):
    """For rows with ids (or None) and a matrix of links: the smallest id reachable of each; None without any."""
    root = list(range(len(ids)))
    while True:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == root:
            break
        root = new
    named = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            named[r] = min(named.get(r, ids[i]), ids[i])
    return [named.get(r) for r in root]


def kept(i, c):
    return i == c


def edited(words, *places):
    return " ".join("changed%d" % k if k in places else w for k, w in enumerate(words))


@pytest.mark.parametrize("bridge", [3, None])
def test_texts_linked_by_a_row_without_id(spark, bridge):
    words = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(60)]
    rows = [(1, edited(words, 20)), (bridge, edited(words, 50)), (2, edited(words, 50, 80)), (7, edited(words, 20, 97)), (9, "alone in the world today"), (None, "also quite alone here now")]
    rows += [(None, edited(other, 10)), (None, edited(other, 40)), (None, edited(other, 40)), (None, None), (12, "")]  # none of a component has an id; no words
    rows += [(None, edited(words, 50))] * 2
    sets = [{tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for _, t in rows]
    near = np.array([[bool(a and b) and 100 * len(a & b) >= 75 * len(a | b) for b in sets] for a in sets])
    want = component_ids([i for i, _ in rows], near)
    got = minmax_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter((i, len(s), c, kept(i, c)) for (i, _), s, c in zip(rows, sets, want))
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 7)} == {1}


def test_random_texts_without_ids(spark):
    r = random.Random(7)
    base = [[f"{g}x{i}" for i in range(30)] for g in range(6)]
    rows = [(None if r.random() < 0.5 else 1000 + k, edited(r.choice(base), *r.sample(range(30), r.randint(0, 2)))) for k in range(90)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(26)} for _, t in rows]
    near = np.array([[100 * len(a & b) >= 75 * len(a | b) for b in sets] for a in sets])
    want = component_ids([i for i, _ in rows], near)
    got = minmax_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((q["doc_id"], q["component_id"], q["kept"]) for q in got) == Counter((i, c, kept(i, c)) for (i, _), c in zip(rows, want))
    none = minmax_dedup.near_groups(spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")).collect()
    assert len(none) == 90 and {(q["component_id"], q["kept"]) for q in none} == {(None, True)}


@pytest.mark.parametrize("bridge", [3, None])
def test_vectors_linked_by_a_row_without_id(spark, bridge):
    """Three vectors, neighbours at cosine 0.97: the middle one joins the others, with an id or without."""
    turn = np.arccos(0.97)
    at = lambda k: np.array([np.cos(k * turn), np.sin(k * turn)] + [0.0] * 6)
    rows = [(1, at(0)), (2, at(2)), (bridge, at(1)), (None, np.eye(8)[4]), (None, np.eye(8)[4] * 2), (None, np.eye(8)[4] + 0.1 * np.eye(8)[5]), (20, np.eye(8)[7])]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    want = component_ids([i for i, _ in rows], near)
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert Counter(map(tuple, got)) == Counter((i, int(n.sum()), c, kept(i, c)) for (i, _), n, c in zip(rows, near, want))
    assert sorted(q["n_links"] for q in got if q["vec_id"] in (1, 2)) == [1, 1]


def test_sums_of_many_tasks_are_added_on_executors(spark, monkeypatch):
    """The model is that of one task, whatever the number of tasks and of partial sums."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["good", "words", "of", "Some", "length", "|", "##", "7"]) for _ in range(r.randint(3, 20)))) for i in range(300)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 3 % 2) for i in range(300)], "doc_id long, quality int")
    want, seen = quality.fit(docs.coalesce(1), marks), []
    monkeypatch.setattr(quality, "PARTIALS", 2)
    add = quality.ranked
    monkeypatch.setattr(quality, "ranked", lambda passes: add(lambda f: seen.append(len(got := passes(f))) or got))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        m = quality.fit(docs.repartition(6), marks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 0 < max(seen) <= 2 and np.allclose(m.weights, want.weights, atol=1e-6) and abs(m.cut - want.cut) < 1e-6
