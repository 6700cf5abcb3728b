"""Running moments against exact fractions, and tiled nearest neighbours against plain loops."""

from fractions import Fraction

import numpy as np
import pytest

from tidemark.operators import moments, neighbours, ordered


def exact(x):
    """(mean, variance) of rows 0 .. i - 1, by exact arithmetic."""
    out, n, s, q = [], 0, Fraction(0), Fraction(0)
    for v in x:
        out.append((s / n, q / n - (s / n) ** 2) if n else (None, None))
        if v is not None and v == v:
            n, s, q = n + 1, s + Fraction(v), q + Fraction(v) ** 2
    return out


def close(got, want):
    return (got is None) == (want is None) and (got is None or float(abs(Fraction(got) - want)) <= 1e-9 * abs(float(want)))


@pytest.mark.parametrize("deep", [False, True])
def test_moments_far_from_zero_that_drift(spark, monkeypatch, deep):
    """Mean 10^8 with a drift: mean and variance right to 1e-9, over several blocks and nodes."""
    if deep:
        monkeypatch.setattr(ordered, "PARTS", 4)
        monkeypatch.setattr(moments, "PARTS", 4)
    r = np.random.default_rng(1)
    x = 1e8 + r.standard_normal((300, 2)) + np.arange(300)[:, None] * np.array([0.0, 25.0])
    ids = np.sort(r.choice(10**9, 300, replace=False))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "idx long, features array<double>").repartition(3)
    got = moments.prefix_moments(df, 16, deep).orderBy("idx").collect()
    assert [g["idx"] for g in got] == ids.tolist() and [g["pos"] for g in got] == list(range(300))
    for d in range(2):
        for i, ((mean, var), g) in enumerate(zip(exact(x[:, d].tolist()), got)):
            assert close(g["mean"][d], mean), (i, d)
            assert close(g["var"][d], var) or i == 1 and g["var"][d] == 0, (i, d, g["var"][d], float(var))


def test_moments_of_odd_rows(spark):
    rows = [(1, [1.0, None]), (2, None), (3, [2.0, 5.0, 7.0]), (4, []), (5, [float("nan"), 6.0, 1.0]), (6, [4.0, 8.0, 3.0])]
    got = {g["idx"]: g for g in moments.prefix_moments(spark.createDataFrame(rows, "idx long, features array<double>"), 2).collect()}
    assert got[1]["mean"] == [None, None] and got[2]["mean"] in (None, []) and got[4]["pos"] == 3
    assert got[3]["mean"] == [1.0, None, None] and got[3]["var"] == [0.0, None, None]
    assert got[6]["mean"] == pytest.approx([1.5, 5.5, 4.0]) and got[6]["var"] == pytest.approx([0.25, 0.25, 9.0])
    assert moments.prefix_moments(spark.createDataFrame([], "idx long, features array<double>")).collect() == []


def test_scaler_is_one_row_a_dimension(spark):
    x = [[1e6 + (i * 7 % 11) / 8, float(i)] for i in range(25)]
    got = {(r["idx"], r["dim"]): r for r in neighbours.scaler(spark.createDataFrame(list(enumerate(x)), "idx long, features array<float>")).collect()}
    assert len(got) == 50 and got[0, 1]["mean"] is None and got[0, 1]["var"] is None
    for i in range(1, 25):
        own = np.array(x[:i], np.float32).astype(float)
        for d in range(2):
            assert got[i, d]["x"] == np.float32(x[i][d]) and got[i, d]["mean"] == pytest.approx(own[:, d].mean()) and got[i, d]["var"] == pytest.approx(own[:, d].var(), abs=1e-9)


def plain_neighbours(z, k, window):
    out = []
    for i in range(len(z)):
        at = np.arange(max(0, i - window), i)
        d = np.round(np.sqrt(((z[at] - z[i]) ** 2).sum(1)), 6)
        o = np.lexsort((-at, d))[:k]
        out += [(i, int(at[j]), r + 1, d[j]) for r, j in enumerate(o)]
    return out


def sizes_compared(monkeypatch, z):
    """(what is found, distances looked at)"""
    compared = []
    partition = np.partition
    with monkeypatch.context() as m:
        m.setattr(neighbours, "TILE", 16)
        m.setattr(neighbours.np, "partition", lambda a, *args, **more: compared.append(a.size) or partition(a, *args, **more))
        found = neighbours.nearest(z, np.arange(len(z)), np.arange(len(z)), 0, 5, 130)
    return list(zip(*(c.tolist() for c in found))), sum(compared)


@pytest.mark.parametrize("kind", ["plain", "clusters", "copies", "grid"])
def test_tiles_find_what_a_loop_finds(monkeypatch, kind):
    """Also where many distances are equal, where tiles are pruned, and where the window cuts a tile."""
    r = np.random.default_rng(2)
    z = r.standard_normal((420, 6))
    everything = sizes_compared(monkeypatch, z)[1]
    if kind == "clusters":
        z = z * 0.01 + np.array([[50.0], [-50.0]])[np.arange(420) // 16 % 2]  # tiles in turn from two clusters
    elif kind == "copies":
        z = z[r.integers(0, 9, 420)]
    elif kind == "grid":
        z = r.integers(0, 3, (420, 6)).astype(float)
    got, compared = sizes_compared(monkeypatch, z)
    assert got == plain_neighbours(z, 5, 130)
    if kind == "clusters":
        assert compared < 0.65 * everything  # tiles of the other cluster are never compared


def test_neighbours_over_many_blocks(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((230, 5)) * [1, 2, 3, 0, 5]
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "idx long, features array<double>")
    z = np.array([r["z"] for r in neighbours.standardised(df).orderBy("idx").collect()])
    got = sorted(map(tuple, neighbours.neighbours(df, 4, 50).collect()), key=lambda r: (r[0], r[2]))
    assert [(a // 3, b // 3, c, d) for a, b, c, d in got] == plain_neighbours(z, 4, 50)
