"""Behaviour that users of the commands rely on: rules that fit nothing, rewrites that fail, what a stream carries, texts and votes."""

import json
import re
import time

import numpy as np
import pytest
from test_render import drawn_font
from test_sources import font

from pyspark.sql import functions as F
from tidemark import config
from tidemark.__main__ import main
from tidemark.config import Rule
from tidemark.functions import backgrounds, color, keys, text
from tidemark.models import registry
from tidemark.operators import neighbours, ordered, schedule, scoring
from tidemark.plans.catalog import PLANS
from tidemark.sources import drawn, render, store


def test_weights_and_presets(spark):
    styles = {"Extra Black": 950, "Semi Light": 350, "Regular Bold": 700, "Medium Bold": 700, "Book Heavy": 900, "Light Black": 900, "ExtraLight": 300, "Hairline": 100, "Roman": 400}
    df = spark.createDataFrame(list(styles.items()), "s string, w int")
    assert all(r["w"] == r["got"] for r in df.select("w", keys.style_weight(F.lit(None).cast("int"), F.col("s")).alias("got")).collect())
    assert len(keys.charset("ascii_alnum")) == 62 and len(keys.charset("ascii_printable")) == 94 and set("ßœ“…€¿") <= set(keys.charset("latin1_printable"))
    assert keys.charset("digits") == "digts"  # no such set: its letters, each once


def test_rules_that_fit_no_label_are_errors(spark, tmp_path, capsys):
    full, d = keys.charset("ascii_alnum"), tmp_path / "f"
    d.mkdir()
    (d / "One.ttf").write_bytes(font(full, "One", "Bold", 700))
    faces = spark.createDataFrame([("one:bold",)], "face_id string")
    with pytest.raises(schedule.ScheduleError, match="'tow:\\*'"):
        schedule.require(faces, {"one*": Rule(), "tow:*": Rule(weight=2.0)})
    (tmp_path / "c.yaml").write_text("arrival: {fonts: {'tow:*': {weight: 2}}}")
    for command in (["arrival", str(d)], ["generate", str(d), str(tmp_path / "s")]):
        assert main([*command, "--config", str(tmp_path / "c.yaml"), "-n", "10"], spark) == 1
        assert "tow:*" in capsys.readouterr().err
    with pytest.raises(store.StreamNotFound):
        store.read_manifest(spark, f"file://{tmp_path}/s")


def test_shares_and_draws_without_a_join_of_all_with_all(spark):
    faces = spark.createDataFrame([(f"f{i}",) for i in range(9)], "face_id string")
    own = schedule.resolve(faces, {"f1": Rule(start=5), "f2": Rule(stop=7, weight=3.0), "f3": Rule(start=3, stop=20), "f4": Rule(weight=0.0)})
    rows = own.collect()
    for r in schedule.shares(own).collect():
        on = [x for x in rows if x["weight"] > 0 and x["start"] <= r["lo"] and (x["stop"] is None or r["lo"] < x["stop"])]
        assert r["face_id"] in {x["face_id"] for x in on} and r["share"] == pytest.approx(r["weight"] / sum(x["weight"] for x in on))
    plan = schedule.draw(own, 100)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert schedule.draw(own, 60).where("idx >= 40").orderBy("idx").collect() == schedule.draw(own, 60, first=40).orderBy("idx").collect()
    got = spark.range(12).select(ordered.upper_bound("array(1, 3, 3, 7)", "id").alias("n")).collect()
    assert [r["n"] for r in got] == [0, 1, 1, 3, 3, 3, 3, 4, 4, 4, 4, 4]


def test_a_live_stream_draws_the_same_items(spark, tmp_path):
    faces = spark.createDataFrame([(f"f{i}",) for i in range(5)], "face_id string")
    own = schedule.resolve(faces, {"f1": Rule(start=30), "f2": Rule(stop=50, weight=3.0)})
    want = {r["idx"]: r["label"] for r in schedule.draw(own, 900, seed=4).collect()}

    def run(total, rate=None):
        """A query of its own up to total, over the checkpoint of those before."""
        live = schedule.live(own, 4, rate, total=total, since=0, partitions=3)
        query = live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return query.lastProgress

    run(350)
    first = spark.read.parquet(f"{tmp_path}/out")
    assert first.count() == 350
    run(350)  # nothing new
    run(900, rate=1e9)  # goes on where it stopped
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 900 and {r["idx"]: r["label"] for r in got} == want


def test_drawn_items_as_a_source(spark):
    spark.dataSource.register(drawn.DrawnItems)
    own = spark.read.format("drawn-items").options(first="5", total="200005", partitions="4").load()
    assert own.rdd.getNumPartitions() == 4 and sorted(r[0] for r in own.collect()) == list(range(5, 200005))
    assert [(s.lo, s.hi) for s in drawn.stretches(3, 5, 4)] == [(3, 4), (4, 5)] and drawn.stretches(7, 7, 3) == []
    parts = drawn.DrawnItems({"total": "350", "partitions": "3"}).streamReader(None).partitions({"items": 20}, {"items": 350})
    assert [(p.lo, p.hi) for p in parts] == [(20, 130), (130, 240), (240, 350)]
    for options, why in (({}, "a total or a rate"), ({"rate": "1"}, "needs a total")):
        with pytest.raises(Exception, match=why):
            spark.read.format("drawn-items").options(**options).load().collect()
    slow = drawn.DrawnItems({"rate": "10", "since": str(time.time() - 3), "first": "100", "total": "125"}).streamReader(None)
    assert 125 >= slow.latestOffset()["items"] >= 125 and slow.initialOffset() == {"items": 100}


def test_readers_keep_the_stream_while_it_is_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    good = lambda n: spark.range(n).selectExpr("id as idx", "'a' as label")
    with pytest.raises(store.StreamNotFound):
        store.read_stream(spark, path)
    assert store.write_stream(good(10), path)["n_items"] == 10
    with pytest.raises(Exception, match="no luck"):
        store.write_stream(good(20).withColumn("x", F.raise_error(F.lit("no luck"))), path)
    assert store.read_stream(spark, path).count() == store.read_manifest(spark, path)["n_items"] == 10  # after a failed one
    reader = store.read_stream(spark, path)
    folder = store.begin_stream(spark, path)
    store.append_items(good(30), folder)
    assert store.begin_stream(spark, path) != folder  # another writer gets a folder of its own
    assert reader.count() == store.read_stream(spark, path).count() == 10  # while one is written
    assert store.finish_stream(spark, folder)["n_items"] == 30
    assert reader.count() == 10 and store.read_stream(spark, path).count() == 30  # who began before still has the old one
    assert store.read_stream(spark, path, snapshot=0).count() == 10
    own = store.read_stream(spark, path).union(store.read_stream(spark, path).selectExpr("idx + 30", "label", "shard"))
    assert store.write_stream(own.drop("shard"), path)["n_items"] == 60  # made from itself
    with pytest.raises(store.StreamNotFound, match="snapshot 0"):
        store.read_stream(spark, path, snapshot=0)
    assert store.read_stream(spark, path, limit=45).count() == 45


def test_annotations_carry_their_metadata_and_meet_their_images(spark, tmp_path):
    items = spark.createDataFrame([(0, "a", '{"text":"x","n":1}', None), (1, "b", None, None), (2, "c", None, "no ink")], "idx long, label string, meta string, error string")
    store.write_annotations(items, f"file://{tmp_path}/notes")
    lines = [json.loads(x) for p in sorted((tmp_path / "notes").glob("part*")) for x in p.read_text().splitlines()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"index": 0, "label": "a", "image": "crops/00000/00000000.png", "meta": {"text": "x", "n": 1}}, {"index": 1, "label": "b", "image": "crops/00000/00000001.png", "meta": {}}]))
    (tmp_path / "crops" / "00000").mkdir(parents=True)
    for i in range(2):
        (tmp_path / "crops" / "00000" / f"{i:08d}.png").write_bytes(b"image %d" % i)
    got = store.annotated_images(spark, f"file://{tmp_path}/notes", f"file://{tmp_path}/crops").collect()
    assert [(r["idx"], r["label"], bytes(r["content"])) for r in got] == [(0, "a", b"image 0"), (1, "b", b"image 1")]
    (tmp_path / "crops" / "00000" / "00000001.png").unlink()
    with pytest.raises(Exception, match="no image file"):
        store.annotated_images(spark, f"file://{tmp_path}/notes", f"file://{tmp_path}/crops").collect()


@pytest.fixture(scope="module")
def fonts_of(tmp_path_factory):
    d = tmp_path_factory.mktemp("fonts")
    full = keys.charset("ascii_alnum")
    for name, height in (("Low", 500), ("Tall", 900)):
        (d / f"{name}.ttf").write_bytes(drawn_font(full, name, height))
    (d / "Empty.ttf").write_bytes(font(full, "Empty", "Regular"))
    return d


def test_streams_take_what_can_be_drawn_and_tell_where_they_come_from(spark, fonts_of, tmp_path, capsys):
    photos = tmp_path / "photos"
    photos.mkdir()
    r = np.random.default_rng(0)
    for i in range(2):
        (photos / f"p{i}.png").write_bytes(render.png(r.integers(0, 255, (60, 90, 3)).astype(np.uint8)))
    c = tmp_path / "c.yaml"
    c.write_text(f"seed: 3\nrender: {{typography: {{cap_height_px: [14, 20]}}, corpus: {{words: [1, 2]}}, background: {{photo_dir: {photos}, sources: {{photo: 3, solid: 1}}}}, crop: {{neighbor_bleed_prob: 0.5}}}}")
    assert main(["generate", str(fonts_of), str(tmp_path / "s"), "--config", str(c), "-n", "30"], spark) == 0
    path = f"file://{tmp_path}/s"
    items, facts = store.read_stream(spark, path).collect(), store.read_manifest(spark, path)
    assert len(items) == 30 == facts["n_items"] and facts["n_labels"] == 2 and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", facts["created"])
    gone = store.read_skipped(spark, path).collect()
    assert len(gone) == facts["n_skipped"] > 0 and {g["label"] for g in gone} == {"empty:regular"} and all(g["error"] for g in gone)
    assert sorted([x["idx"] for x in items] + [g["idx"] for g in gone]) == list(range(facts["last_idx"] + 1))
    assert store.read_config(spark, path) == config.load(c)
    assert {x["face_id"] for x in store.read_registry(spark, path).collect()} == {"low:regular", "tall:regular", "empty:regular"}
    assert store.read_beside(spark, path, "schedule").count() == 3 and sum(x["n"] for x in store.read_beside(spark, path, "arrival").collect()) == facts["n_arrivals"]
    meta = {x["idx"]: json.loads(x["meta"]) for x in items}
    seen = {}
    for i in sorted([*meta, *(g["idx"] for g in gone)]):
        label = next(x["label"] for x in [*items, *gone] if x["idx"] == i)
        if i in meta:
            assert (meta[i]["first_seen"], meta[i]["n_seen"]) == (label not in seen, len({*seen, label}))
            assert meta[i]["face_id"] == label and meta[i]["weight"] == 400 and meta[i]["italic"] is False and meta[i]["monospace"] is False
        seen[label] = 1
    kinds = {m["background"] for m in meta.values()}
    assert kinds == {"photo", "solid"} and all(("background_detail" in m) == (m["background"] == "photo") for m in meta.values())
    assert any(m["neighbor"] for m in meta.values())
    capsys.readouterr()
    assert main(["recognize", str(tmp_path / "s"), "--model", "baseline"], spark) == 0
    said = capsys.readouterr().out
    assert all(w in said for w in ("balanced_accuracy", "majority", "chance", "lift", "recent", "low:regular"))
    assert main(["recognize", "--folder", str(fonts_of), "--config", str(c), "-n", "12", "--model", "last-seen", "--no-classes"], spark) == 0
    assert main(["recognize"], spark) == 1 and main(["recognize", str(tmp_path / "none")], spark) == 1
    assert main(["preview", str(fonts_of), str(tmp_path / "p.png"), "--count", "6", "--cap-height", "12:14", "--config", str(c)], spark) == 0
    assert "of 2 photographs" in capsys.readouterr().out
    with pytest.raises(ValueError, match="can be drawn"):
        only = tmp_path / "only"
        only.mkdir()
        (only / "Empty.ttf").write_bytes((fonts_of / "Empty.ttf").read_bytes())
        render.write_generated(spark, config.load(None), f"file://{only}", 5, f"file://{tmp_path}/t")


def test_photographs_make_canvases(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    (tmp_path / "a.PNG").write_bytes(render.png(pixels))
    (tmp_path / "b.txt").write_bytes(b"")
    one = store.image_files(spark, f"file://{tmp_path}").first()
    assert (one["height"], one["width"]) == (40, 50) and bytes(one["rgb"]) == pixels.tobytes()
    r = np.random.default_rng(2)
    same = backgrounds.canvas(r, 40, 50, "photo", pixels, 1.0)
    assert (same == pixels).all() and backgrounds.canvas(r, 90, 120, "photo", pixels, 3.0).shape == (90, 120, 3)
    assert backgrounds.usable({"photo": 1.0, "solid": 1.0}, 2) == {"photo": 1.0, "solid": 1.0} and backgrounds.usable({"photo": 1.0, "solid": 1.0}) == {"solid": 1.0}


def test_texts_of_every_kind(spark):
    rows = text.samples(spark.range(6000)).collect()
    of = {}
    for r in rows:
        of.setdefault(r["kind"], []).append(r["text"])
    form = {
        "number": r"\d{1,3}|\d{1,3}(,\d{3})+|\d{1,2}\.\d{1,2}|\d{1,3}%", "price": r"[$€£¥]\d{1,3}(,\d{3})*\.\d\d|\d{1,3}(,\d{3})*\.\d\d [$€£¥]", "time": r"\d\d:\d\d|\d{1,2}:\d\d (AM|PM|am|pm)",
        "date": r"\d{1,2} [A-Z][a-z]{2} \d{4}|[A-Z][a-z]{2} \d{1,2}, \d{4}|\d\d/\d\d/\d{4}", "token": r"(BIN|CRATE|DOCK|KEY|PALLET|ROW|TRK)[-/.]?\d{3,6}", "word": r"[a-z]+", "phrase": r"[a-z]+( [a-z]+){1,4}", "sentence": r"[A-Z][a-z]*,?( [a-z]+,?){2,}[.!?]",
    }
    for kind, values in of.items():
        assert all(re.fullmatch(form[kind], v) for v in values), (kind, [v for v in values if not re.fullmatch(form[kind], v)][:3])
    assert {bool(re.search(p, v)) for p in ("%$", ",", r"\.") for v in of["number"]} == {True, False} and any("," in v for v in of["sentence"])
    long = text.samples(spark.range(40), {"sentence": 1.0}, (400, 500)).collect()
    assert all(402 <= len(r["text"].split()) <= 502 for r in long)
    cased = {r["kind"]: 1 for r in rows}
    for r in spark.createDataFrame([(k, "aB c") for k in cased], "kind string, t string").select("kind", text.cased(F.col("t"), F.col("kind"), F.lit(0.5), {"upper": 1.0}).alias("t")).collect():
        assert r["t"] == ("aB c" if r["kind"] in ("number", "price", "date", "time", "token") else "AB C")


def test_fallbacks_are_drawn_from_what_is_covered(spark):
    df = spark.range(50).withColumn("covered", F.array(*[F.lit(ord(c)) for c in "xY7é-"]))
    from tidemark.functions import draws

    u = lambda p: draws.uniform(F.col("id"), p)
    got = [r[0] for r in df.select(keys.drawn_fallback(F.col("covered"), lambda i: u(i.cast("string")), draws.integer(u("n"), 3, 8))).collect()]
    assert all(set(g) <= set("xY7") and 3 <= len(g) <= 8 for g in got) and len(set(got)) > 20 and {len(g) for g in got} == set(range(3, 9))


def test_projection_takes_no_long_text_apart(spark, tmp_path):
    texts = [None, "", " ", "a", "-a", "a-b", "  aé  b\n", "\0𝒳ß]", "x" * 5000 + "—" + " y" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for chars in (keys.charset("ascii_alnum"), "aé]^\\-[𝒳"):
        covered, other = F.array(*[F.lit(ord(c)) for c in chars]), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
        both = own.select("doc_id", keys.project(F.col("text"), covered, other).alias("a"), keys.project_from(F.col("text"), chars, other).alias("b")).collect()
        for r in both:
            t = texts[r["doc_id"]]
            kept = None if t is None else re.sub(" +", " ", "".join(c for c in t if c in chars + " ")).strip(" ")
            lack = None if t is None else "".join(dict.fromkeys(c for c in t if c not in chars + " "))
            want = f"doc{r['doc_id']}" if kept == "" or kept and lack and len(kept) < 2 else kept
            assert tuple(r["a"]) == tuple(r["b"]) == (want, lack)
    plan = PLANS["project_text"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "array_contains" not in plan  # 62 comparisons a character before, three times over


def test_votes_weigh_by_distance(spark):
    near = [(9, 1, 1, 0.1), (9, 2, 2, 1.0), (9, 3, 3, 1.0), (8, 4, 1, 0.0), (8, 2, 2, 0.01), (8, 3, 3, 0.01), (7, 2, 1, 1.0), (7, 3, 2, 1.0), (7, 1, 3, 1.5)]
    found = spark.createDataFrame(near, "idx long, other long, rank int, distance double")
    stream = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (7, "x"), (8, "x"), (9, "x")], "idx long, label string")
    got = {r["idx"]: r["pred"] for r in neighbours.vote(found, stream).collect()}
    assert (got[9], got[8], got[7], got[1]) == ("a", "c", "b", None)  # one close neighbour outweighs two, one at distance 0 all
    assert {r["idx"]: r["pred"] for r in neighbours.vote(found, stream, weighted=False).collect()}[9] == "b"


def test_plug_in_models_equal_their_batch_forms(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((4, 6)) * 2
    rows = [(i, str(i % 4), (centres[i % 4] + r.standard_normal(6)).tolist()) for i in range(150)]
    own = spark.createDataFrame(rows, "idx long, label string, features array<double>")
    stream = own.withColumn("stream_id", F.lit("s"))
    model = registry.load("baseline")
    plug = {q["idx"]: q["pred"] for q in registry.prequential(stream, lambda: model()).collect()}  # item by item
    fast = registry.prequential(stream, model)
    assert {q["idx"]: q["pred"] for q in fast.collect()} == plug and "MapInPandas" not in fast._jdf.queryExecution().toString()
    two = registry.prequential(stream.union(stream.withColumn("stream_id", F.lit("t"))), model)
    assert sorted(map(str, two.where("stream_id = 't'").select("idx", "pred").collect())) == sorted(map(str, fast.select("idx", "pred").collect()))
    assert plug == {q["idx"]: q["pred"] for q in neighbours.vote(neighbours.neighbours(own), own).collect()}
    model, loop = registry.load("replay-head")(), {}
    for i, y, x in rows:
        loop[i] = model.predict(x)
        model.learn(x, y)
    assert loop == {q["idx"]: q["pred"] for q in registry.prequential(stream, registry.load("replay-head")).collect()}
    assert np.mean([loop[i] == y for i, y, _ in rows[75:]]) > 0.6
    scale = {q["idx"]: q["scale"] for q in neighbours.single_scale(own).collect()}
    x = np.array([v for _, _, v in rows])
    assert scale[0] is None and scale[1] is None and scale[100] == pytest.approx(x[:100].std(0, ddof=1).mean())


def test_streamed_models_equal_their_batch_forms(spark, tmp_path):
    from tidemark.streaming import processors

    r = np.random.default_rng(6)
    rows = [("s", i, str(i % 3), (r.standard_normal(4) + 2 * (i % 3)).tolist()) for i in range(45)]
    schema = "stream_id string, idx long, label string, features array<double>"
    for part in range(3):
        spark.createDataFrame(rows[part * 15 : part * 15 + 15], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    live = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for name in ("baseline", "replay-head"):
        model = registry.load(name)
        got = processors.run_now(spark, processors.recognized(live, model), f"file://{tmp_path}/{name}")
        want = registry.prequential(spark.createDataFrame(rows, schema), model)
        assert sorted(map(str, got.collect())) == sorted(str(q) for q in want.select("idx", "label", "pred").collect())


def test_boxes_stay_on_the_canvas(spark):
    cases = [(300, 5, 20, 10), (5, 90, 20, 10), (-60, -60, 20, 10), (10, 10, 5, 4)]
    df = spark.createDataFrame(cases, "x int, y int, w int, h int")
    for r in df.select(color.crop_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), [F.lit(0.1)] * 4, F.lit(128), F.lit(64)).alias("b")).select("b.*").collect():
        assert 0 <= r["x0"] < r["x1"] <= 128 and 0 <= r["y0"] < r["y1"] <= 64


def test_planner_of_the_renderer_is_that_of_the_columns(spark):
    r = np.random.default_rng(3)
    rows = [(float(min(a, b)), float(max(a, b)), float(k), bool(d)) for a, b, k, d in zip(r.random(200), r.random(200), r.uniform(1, 16, 200), r.random(200) < 0.5)]
    df = spark.createDataFrame(rows, "lo double, hi double, ratio double, dark boolean")
    got = df.select(color.plan(F.col("lo"), F.col("hi"), F.col("ratio"), F.col("dark")).alias("p")).select("p.*").collect()
    for g, x in zip(got, rows):
        value, reached, dark = render.planned(*x)
        assert dark == g["darker"] and value == pytest.approx(g["luminance"]) and reached == pytest.approx(g["achieved"])
    for v in (0.02, 0.3, 0.9):
        assert float(render.luminance(render.coloured(r, v, True))) == pytest.approx(v, abs=0.02)


def test_classes_in_order_and_headline(spark):
    preds = spark.createDataFrame([(i, "ab"[i % 3 == 0], "a") for i in range(9)] + [(9, "c", None)], "idx long, label string, pred string")
    assert [r["label"] for r in scoring.classes(preds, 3).collect()] == ["a", "b", "c"]
    far = scoring.result(preds.withColumn("idx", F.col("idx") * 1000), 5, 2)
    assert {r["n_items"] for r in far.curve.collect()} == {2, 4, 6, 8, 10} and far.confusion.count() == 3
    assert sorted(map(str, far.headline.collect())) == sorted(map(str, scoring.headline(preds, ordered.majority(preds.select("idx", "label")), 5).collect()))
    got = {r["measure"]: (r["overall"], r["recent"]) for r in scoring.headline(preds, ordered.majority(preds.select("idx", "label")), 5).collect()}
    assert got["accuracy"] == (0.6, 0.6) and got["chance"] == (round(1 / 3, 9), None) and got["lift"][0] == pytest.approx(0.6 / got["majority"][0])


def test_assets_hash_and_patterns_without_a_match(spark, tmp_path, capsys):
    root = tmp_path / "r"
    root.mkdir()
    for n in ("a.ttf", "b.ttf", ".hidden"):
        (root / n).write_bytes(n.encode())
    import hashlib

    (tmp_path / "m.yaml").write_text(f"release: http://localhost\nassets: [{{path: a.ttf, sha256: {hashlib.sha256(b'a.ttf').hexdigest()}}}]")
    assert main(["assets-hash", str(tmp_path / "m.yaml"), str(root), str(root)], spark) == 0
    said = capsys.readouterr().out
    assert "path: b.ttf" in said and hashlib.sha256(b"b.ttf").hexdigest() in said and "a.ttf" not in said and "hidden" not in said
    assert main(["assets-hash", str(tmp_path / "m.yaml"), str(root), str(root / "a.ttf")], spark) == 0 and "path: a.ttf" in capsys.readouterr().out
    assert main(["assets-hash", str(tmp_path / "m.yaml"), str(root), str(tmp_path / "m.yaml")], spark) == 1
    assert main(["assets-status", str(tmp_path / "m.yaml"), str(root), "--only", "*.otf"], spark) == 1 and "fits none" in capsys.readouterr().err
    assert main(["assets-status", str(tmp_path / "m.yaml"), str(root)], spark) == 1 and "b.ttf" in capsys.readouterr().out
    (root / "b.ttf").unlink()
    assert main(["assets-status", str(tmp_path / "m.yaml"), str(root)], spark) == 0


def test_labels_of_sheets():
    assert render.fitted("a very long label", 64) == "a very…" and render.fitted("short", 64) == "short"
    assert render.raster("1", 1).astype(int).tolist() == [[0, 1, 0, 0], [1, 1, 0, 0], [0, 1, 0, 0], [0, 1, 0, 0], [1, 1, 1, 0]]
    out = render.sheet([np.zeros((10, 500, 3), np.uint8)], names=["x"])
    assert out.shape == (48 + 14 + 16, 240 + 16, 3) and (out[8 + 50 : 8 + 60, 8:30] == 60).any()
