"""Registered queries over whole texts and whole windows, on small tables against plain loops."""

import re

import numpy as np
import pytest

from tidemark.models.head import PER_CLASS
from tidemark.operators import neighbours
from tidemark.plans.catalog import ORACLES, PLANS


@pytest.fixture
def tables(spark, tmp_path):
    def put(**frames):
        for name, df in frames.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


def by_sql(d, name, table):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS FROM '{d}/{table}.parquet/*.parquet'")
    return c.sql(ORACLES[name]).fetchall()


def test_casing_of_long_texts(spark, tables):
    texts = {i: "Straße ÉTÉ don't-stop " * 40 + "THE end" for i in range(4)}
    d = tables(documents=spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {r["i"]: r["text"] for r in PLANS["text_casing"](spark, d).collect()}
    t = texts[0].replace("ß", "ss")
    assert got == {0: t, 1: t.upper(), 2: t.lower(), 3: re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), t)}
    assert dict(by_sql(d, "text_casing", "documents")) == got


def test_neighbours_reach_back_a_thousand_rows_over_gaps(spark, tables):
    r = np.random.default_rng(1)
    x = r.standard_normal((1060, 64)).astype(np.float32)
    x[1020], x[1055] = x[200], x[3]  # copies 820 and 1,052 rows back: in the window, and out of it
    ids = [7 * i for i in range(len(x))]
    d = tables(embeddings=spark.createDataFrame([(i, v.tolist(), k % 3) for k, (i, v) in enumerate(zip(ids, x))], "vec_id long, embedding array<float>, label int"))
    got = {(q["idx"], q["rank"]): q["other"] for q in PLANS["knn_neighbors"](spark, d).collect()}
    y = x.astype(float)
    z = np.array([np.divide(y[j] - y[:j].mean(0), y[:j].std(0), out=np.zeros(64), where=y[:j].std(0) > 0) if j else np.zeros(64) for j in range(len(y))])
    for i in [*range(1, 1060, 97), 1020, 1055]:
        at = range(max(0, i - 1000), i)
        near = sorted((round(float(np.linalg.norm(z[j] - z[i])), 6), -j) for j in at)[:5]
        assert [got.get((ids[i], k + 1)) for k in range(len(near))] == [ids[-j] for _, j in near], i
    assert neighbours.WINDOW == 1000 and got[7 * 1020, 1] == 7 * 200 and got[7 * 1055, 1] != 7 * 3
    assert {(a, c): b for a, b, c in by_sql(d, "knn_neighbors", "embeddings")} == got


def test_replay_buffer_keeps_the_heads_number_of_each_label(spark, tables):
    d = tables(embeddings=spark.range(2 * PER_CLASS + 10).selectExpr("id as vec_id", "array(1f) as embedding", "cast(id % 2 as int) as label"))
    got = {(r["label"], r["idx"], r["age"]) for r in PLANS["replay_buffer"](spark, d).collect()}
    assert PER_CLASS == 400 and got == {(str(g), 2 * PER_CLASS + 8 + g - 2 * k, k + 1) for g in (0, 1) for k in range(PER_CLASS)}
    assert set(by_sql(d, "replay_buffer", "embeddings")) == {(g, i, a) for g, i, a in got}
