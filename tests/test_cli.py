"""Commands, run in the tests' session."""

import json
import random

import pytest
from test_sources import font

from pyspark.sql import functions as F
from tidemark.__main__ import main, ranked
from tidemark.functions import keys
from tidemark.models import registry
from tidemark.progress import reported
from tidemark.sources import store


def test_commands(spark, tmp_path, capsys):
    full = keys.charset("ascii_alnum")
    (tmp_path / "f").mkdir()
    for n in ("One", "Two"):
        (tmp_path / "f" / f"{n}.ttf").write_bytes(font(full, n, "Bold", 700))
    assert main(["fonts-scan", str(tmp_path / "f"), "--json", str(tmp_path / "out")], spark) == 0
    assert "one:bold" in capsys.readouterr().out
    rows = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert {r["family"] for r in rows} == {"One", "Two"} and "codepoints" not in rows[0]
    (tmp_path / "c.yaml").write_text("arrival: {fonts: {'two:*': {start: 10}}}")
    assert main(["arrival", str(tmp_path / "f"), "--config", str(tmp_path / "c.yaml"), "-n", "100"], spark) == 0
    assert "two:bold" in capsys.readouterr().out
    store.write_stream(spark.range(30).select(F.col("id").alias("idx"), F.lit("a").alias("label"), F.lit(1.0).alias("features")), f"file://{tmp_path}/s")
    assert main(["recognize", str(tmp_path / "s"), "--model", "last-seen"], spark) == 0
    assert "0.966666667" in capsys.readouterr().out
    assert main(["recognize", str(tmp_path / "s"), "--model", "none"], spark) == 1
    assert main(["assets-status", str(tmp_path / "m.yaml"), str(tmp_path)], spark) == 1
    assert main(["models-list"], spark) == 0 and "last-seen" in capsys.readouterr().out


def test_progress_is_told_while_a_job_runs(spark):
    said = []
    with reported(spark, 0.05, said.append):
        spark.range(0, 40, 1, 8).select(F.expr("java_method('java.lang.Thread', 'sleep', 30L)")).collect()
    assert said and all("tasks" in x for x in said) and all(a != b for a, b in zip(said, said[1:]))
    before = len(said)
    spark.range(10).count()
    assert len(said) == before
    with pytest.raises(ValueError), reported(spark, 0.05, said.append):
        raise ValueError("ends the report too")
    names = spark.createDataFrame([(f"l{i:03d}", i) for i in range(60)], "label string, n long")
    assert ranked(names, "label").startswith("l059 59  l058 58") and ranked(names, "label").endswith("and others") and not ranked(names.limit(3), "label").endswith("others")


def test_models_of_the_prefix_run_by_blocks(spark):
    """The route by columns and the loop give the same, for several streams."""
    r = random.Random(2)
    own = spark.createDataFrame([(s, 3 * i, r.choice("abc"), 1.0) for s in "xyz" for i in range(40)], "stream_id string, idx long, label string, features double")
    model = registry.load("last-seen")
    fast, slow = registry.prequential(own, model), registry.prequential(own, lambda: model())
    assert "MapInPandas" not in fast._jdf.queryExecution().toString() and "MapInPandas" in slow._jdf.queryExecution().toString()
    assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect())) and fast.columns == slow.columns
