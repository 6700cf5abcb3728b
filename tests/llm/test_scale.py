"""What has to stay bounded as the input grows."""

import random
import time
import zlib

import numpy as np

from tidemark.llm import quality, suffix_dedup
from tidemark.llm.common import settings, written
from tidemark.llm.linear import sigmoid


def test_op6_writes_few_files_and_finds_the_same(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared = [" ".join(word() for _ in range(30)) for _ in range(40)]
    rows = [(i, f"{word()} {r.choice(shared)} {word()} {r.choice(shared)[:120]} {word()}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    files = []

    def counted(df):
        out = written(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    with settings(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"), settings(spark, "spark.sql.shuffle.partitions", "64"):
        got = suffix_dedup.remove_repeats(docs)
        assert sorted(map(tuple, got.collect())) == want
        assert got.rdd.getNumPartitions() <= 16
    assert max(files[1:]) <= 16, files  # the first is the ids' own table


def test_op6_blobs_keep_many_records_on_large_inputs():
    for gb in (1, 6, 30):
        text = int(gb * 1.77e9)
        assert suffix_dedup.CHUNK / 19 / suffix_dedup._buckets(text, suffix_dedup.BUCKET) > 100, gb
        assert text / suffix_dedup._buckets(text, suffix_dedup.BUCKET) <= suffix_dedup.BUCKET


def test_op6_records_keep_their_values_and_order():
    r = np.random.default_rng(3)
    key, more, doc = r.integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1), r.integers(0, 3, 500, dtype=np.uint32), r.integers(0, 9, 500)
    key[200:400] = key[:200]
    key[0], key[199] = 0, (1 << 64) - 1
    o = suffix_dedup._ordered([key, more], doc)
    assert np.array_equal(np.stack([x[o].astype(np.uint64) for x in (key, more, doc)]), np.stack([x[np.lexsort((doc, more, key))].astype(np.uint64) for x in (key, more, doc)]))
    one = np.arange(500, dtype=np.int64)  # each its own document, so that none is settled early
    (b,) = suffix_dedup._deal([key[:200], more[:200]], [], one[:200], one[:200] * 0, one[:200], one[:200] + 7, 7)
    cols = [suffix_dedup.unpack(blob, n, [np.uint64, np.uint32, np.int64, np.int64, np.uint32, np.uint8]) for blob, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if blob]
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*cols)))) == sorted(zip(key[:200].tolist(), more[:200].tolist(), range(200), [0] * 200, range(200), [7] * 200))


def test_op2_learns_from_every_labelled_row_and_all_pairs():
    """The weights are those of all pairs of a good and a bad row, the threshold that of all scores, however rows are parted."""
    r = np.random.default_rng(0)
    n = 6000  # more good rows than the sample of 4000 a label had
    y = (r.random(n) > 0.1).astype(np.int64)
    x = np.abs(r.standard_normal((n, len(quality.FEATURES)))) * 0.3
    x[:, 1] += (y == 0) * 0.3
    x[:, 3] += (y == 1) * 0.2
    m = quality.rank(x, y, {0: float((y == 0).sum()), 1: float((y == 1).sum())})
    z = ((quality.widen(x) - m.mean) / m.scale).clip(-8, 8)
    s, good, bad = z @ m.weights, z[y == 1], z[y == 0]
    p = sigmoid(s[y == 0][:, None] - s[y == 1][None, :])
    assert np.abs((p.sum(1) @ bad - p.sum(0) @ good) / p.size + quality.RIDGE * m.weights).max() < 1e-5
    o, k = np.sort(s), len(bad)
    assert abs(m.cut - (o[k - 1] + o[k]) / 2) < 1e-8
    parts = quality.ranked(lambda f: [f(x[i::7], y[i::7]) for i in range(7)])
    assert np.allclose(parts.weights, m.weights, atol=1e-6) and abs(parts.cut - m.cut) < 1e-6


def test_op2_model_sees_all_rows_of_a_table(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["good", "words", "of", "Some", "length", "|", "##", "7"]) for _ in range(r.randint(3, 20)))) for i in range(400)]
    docs = spark.createDataFrame(rows + [(7, "another text of the same id"), (None, "no id")], "doc_id long, text string").repartition(5)
    marks = [(i, i % 3 % 2) for i in range(400)]
    m = quality.fit(docs, spark.createDataFrame(marks + [(7, 1), (None, 1), (5, None)], "doc_id long, quality int"))
    own = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    x = np.array([min(quality.features(t) for k, t in [*rows, (7, "another text of the same id")] if k == i) for i in own])
    want = quality.rank(x, np.array([i % 3 % 2 for i in own]))
    assert np.allclose(m.mean, want.mean) and np.allclose(m.weights, want.weights, atol=1e-6) and abs(m.cut - want.cut) < 1e-6


def test_op8_windows_of_many_notices_are_chosen_in_linear_time(spark):
    from tidemark.llm import licenses

    text = lambda n: "Released under the MIT License.\n" * n + "Some other words\n" + "Licensed under CC BY-SA 4.0.\n" * 5
    df = spark.createDataFrame([(n, text(n)) for n in (0, 1, 2, 3000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_license_lines"]) for r in licenses.licenses(df).collect()}
    assert got == {0: ("cc-by-sa", 1.0, 5)} | {n: ("cc-by-sa", 1.0, n + 5) for n in (1, 2, 3000)}
    assert time.perf_counter() - began < 60  # the square took minutes


def test_op6_tasks_follow_the_bytes_of_all_texts(spark, monkeypatch):
    r = random.Random(8)
    base = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    docs = spark.createDataFrame([(i, base[r.randint(0, 200) :] + str(i) + base[: r.randint(0, 200)]) for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    seen, coalesce = [], type(docs).coalesce
    monkeypatch.setattr(suffix_dedup, "TASK", 1000)
    monkeypatch.setattr(type(docs), "coalesce", lambda df, n: seen.append(n) or coalesce(df, n))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want
    assert min(seen) >= suffix_dedup._tasks(40 * 150) == 6 and len({*seen}) == 1
    monkeypatch.undo()
    assert suffix_dedup._tasks(50 << 30) == 400 and suffix_dedup._tasks(0) == 0  # 30 GB of input: 128 MB of text a task
