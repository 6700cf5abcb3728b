"""Quantiles of groups against numpy's, whatever the values' distribution, with and without brackets."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.operators import quantiles

PROBS = {"q0": 0.0, "q12": 0.12, "q50": 0.5, "q88": 0.88, "q1": 1.0}


def check(spark, groups):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows + [("empty", None), ("plain", None)], "k string, v double").repartition(3)
    got = {r["k"]: tuple(r)[1:] for r in quantiles.quantiles(df, "k", F.col("v"), PROBS).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        want = [float(np.quantile(values, p)) for p in PROBS.values()]
        assert got[k] == pytest.approx(want, rel=1e-12, abs=0), k


@pytest.mark.parametrize("small", [0, quantiles.SMALL])
def test_quantiles_of_groups(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small or 400)
    r = np.random.default_rng(1)
    check(spark, {
        "plain": r.standard_normal(9001), "spread": 10.0 ** r.uniform(-200, 200, 5000), "one value": np.full(700, 3.5), "ties": r.integers(0, 3, 4000).astype(float),
        "mostly one": np.append(np.full(5000, 7.0), r.standard_normal(200)), "single": np.array([2.0]), "two": np.array([1.0, 4.0]), "few": r.standard_normal(401)})


def test_brackets_hold_few_values(spark):
    df = spark.range(400_000).selectExpr("'a' as k", "cast(id * 7919 % 400009 as double) as v")
    got = quantiles.quantiles(df, "k", F.col("v"), {"m": 0.5})
    v = np.arange(400_000) * 7919 % 400009
    assert got.collect() == [("a", float(np.median(v)))]
