"""python -m tidemark: font scans, arrival runs, drawn streams, model scores and asset checks, printed as tables."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
import tempfile
import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import imaging
from tidemark.models import registry
from tidemark.operators import integrity, schedule, scoring
from tidemark.progress import reported
from tidemark.sources import assets, fonts, render, store


def place(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def fonts_scan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    own = fonts.scan(spark, place(a.folder), a.charset, tuple(a.exclude), a.include_variable)
    if a.json:
        own.drop("codepoints").write.mode("errorifexists").json(place(a.json))
    return own.select("face_id", "weight", "status", "reason", "detail", "path").orderBy("path")


def configured(a: argparse.Namespace) -> config.StreamConfig:
    c = config.load(a.config)
    return c if a.seed is None else dataclasses.replace(c, seed=a.seed)


def ranked(counts: DataFrame, key: str) -> str:
    """Counts by falling number, in a line; of more than 50 it says so."""
    rows = counts.orderBy(F.desc("n"), key).limit(51).collect()
    return "  ".join(f"{r[key]} {r['n']}" for r in rows[:50]) + ("  and others" if len(rows) > 50 else "")


def popularity(counts: DataFrame) -> str:
    """How concentrated n over labels is."""
    one = counts.where("n > 0").agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("single")).first()
    if not one["all"]:
        return "no items"
    top = sum(r["n"] for r in counts.orderBy(F.desc("n")).limit(5).collect())
    return f"the 5 most frequent labels hold {top / one['all']:.0%} of the items; {one['single']} appeared once"


def arrival(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    c = configured(a)
    faces, _ = render.labels(spark, c, place(a.folder))
    own = render.planned_schedule(faces, c, a.n)
    seen = schedule.draw(own, a.n, c.seed).groupBy(F.col("label").alias("face_id")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    both = own.join(seen, "face_id", "left").fillna(0, "n").withColumn("share", F.round(F.col("n") / a.n, 9))
    print(popularity(both))
    never = both.where("weight > 0 and n = 0").select("face_id").orderBy("face_id")
    if some := [r[0] for r in never.limit(5).collect()]:
        print(f"{never.count()} labels never appeared in spite of their weight: {', '.join(some[:4])}{' ...' if len(some) > 4 else ''}")
    return both.orderBy(F.desc("weight"), "face_id")


def generate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    facts = render.write_generated(spark, configured(a), place(a.folder), a.n, place(a.out), a.shard_size)
    print(popularity(store.read_beside(spark, place(a.out), "arrival")))
    return spark.createDataFrame([(facts["n_items"], facts["n_labels"], facts["n_skipped"])], "items long, labels long, skipped long")


def preview(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    c = configured(a)
    if a.cap_height:
        look = dataclasses.replace(c.render, typography=dataclasses.replace(c.render.typography, cap_height_px=config.Range.of(a.cap_height)))
        c = dataclasses.replace(c, render=look)
    own = render.preview(spark, c, place(a.folder), a.count)
    rows = own.orderBy("idx").collect()
    good = [r for r in rows if r["image"]]
    if not good:
        raise ValueError(f"nothing was drawn: {rows[0]['error']}")
    images = [np.frombuffer(r["image"]["data"], np.uint8).reshape(r["image"]["height"], r["image"]["width"], 3) for r in good]
    names = [f"{r['label']}  {json.loads(r['meta'])['cap_height_px']:.0f}px" for r in good]
    with open(a.out, "wb") as f:
        f.write(render.png(render.sheet(images, a.columns, names=names)))
    facts = spark.createDataFrame([(json.loads(r["meta"])["background"], json.loads(r["meta"])["text_kind"]) for r in good], "background string, kind string")
    print("canvases:", ranked(facts.groupBy("background").agg(F.count(F.lit(1)).alias("n")), "background"), "of", render.count_images(spark, c), "photographs")
    print("texts:", ranked(facts.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind"))
    return spark.createDataFrame([(r["idx"], r["label"], r["meta"], r["error"]) for r in rows], "idx long, label string, meta string, error string")


def recognize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Scores over a finished stream, or over one drawn now from a folder of fonts."""
    model = registry.load(a.model, a.models)  # before anything is drawn
    if a.stream is None:
        if not a.folder:
            raise ValueError("give a stream, or a folder of fonts to draw one from")
        with tempfile.TemporaryDirectory(prefix="tidemark-") as own:
            at = f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + own}/live-{uuid.uuid4().hex}"
            render.write_generated(spark, configured(a), place(a.folder), a.n, at)
            out = scored(spark, store.read_stream(spark, at), model, a.classes)
            store._drop(spark, at)
            return out
    return scored(spark, store.read_stream(spark, place(a.stream), a.limit), model, a.classes)


def scored(spark: SparkSession, items: DataFrame, model: type[registry.Recognizer], classes: bool) -> DataFrame:
    """The headline of a model over items; its classes and worst confusions are printed. Images are described by their ink."""
    if "features" in items.columns:
        features = F.col("features")
    else:
        features = imaging.image_features("image.data", "image.height", "image.width")
    own = items.select(F.lit("stream").alias("stream_id"), "idx", "label", features.alias("features"))
    got = registry.prequential(own, model).select("idx", "label", "pred")
    rows = got.persist(StorageLevel.DISK_ONLY)  # one sequence: its answers are made once, and scored from here
    try:
        found = scoring.result(rows)
        if classes:
            shown(found.classes.select("label", "support", *(F.round(c, 4).alias(c) for c in ("recall", "precision")), F.round("recent_recall", 4).alias("recent")))
        wrong = scoring.worst(found.confusion, 5).collect()
        if wrong:
            print("most confused:", "   ".join(f"{r['true'].split(':')[0]}→{r['predicted'].split(':')[0]} {r['n']}" for r in wrong))
        return spark.createDataFrame(found.headline.toArrow())
    finally:
        rows.unpersist()


def models_list(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = [(n, k.__qualname__, (k.__doc__ or "").strip().split("\n")[0]) for n, k in registry.discover(a.models).items()]
    return spark.createDataFrame(rows, "name string, class string, about string")


def selected(spark: SparkSession, a: argparse.Namespace) -> tuple[assets.Manifest, DataFrame]:
    """The manifest and the pins that --only picks; an error if it picks none."""
    m = assets.load(a.manifest)
    own = assets.matching(assets.pins(spark, m), a.only)
    if own.isEmpty():
        raise ValueError(f"--only {a.only!r} fits none of the {len(m.assets)} assets" if a.only else "the manifest pins nothing")
    return m, own


def assets_status(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    _, own = selected(spark, a)
    files = assets.on_disk(spark, place(a.root))
    states = integrity.status(own, files)
    loose = integrity.untracked(own, files)
    if n := loose.count():
        print(f"{n} files beside the assets are not pinned: {', '.join(r[0] for r in loose.orderBy('path').limit(6).collect())}")
    if n := own.where("license is null").count():
        print(f"{n} assets have no licence recorded")
    a.failed = not loose.isEmpty() or not states.where("state <> 'ok'").isEmpty()
    return states.join(own.select("path", "license"), "path").withColumn("told", integrity.told(F.col("state"))).orderBy("path")


def assets_fetch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    m, own = selected(spark, a)
    rows = assets.due(own, assets.on_disk(spark, place(a.root)), m.release, a.force)
    got = list(assets.fetch(rows, a.root, m.timeout))
    failed = [g for g in got if g[2]]
    size = sum(g[1] or 0 for g in got) / 1e6
    print(f"{len(got) - len(failed)} fetched ({size:.1f} MB), {own.count() - len(got)} already there, {len(failed)} failed")
    a.failed = bool(failed)
    return spark.createDataFrame(got, "path string, bytes long, error string")


def assets_hash(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Entries to paste for files that the manifest does not pin, and for those named that it does."""
    m = assets.load(a.manifest)
    root = os.path.abspath(a.root)
    for p in a.paths:
        at = os.path.abspath(p)
        if os.path.commonpath([root, at]) != root or not os.path.exists(at):
            raise ValueError(f"{p} is not below {a.root}" if os.path.exists(at) else f"there is no {p}")
    named = [os.path.relpath(os.path.abspath(p), root) for p in a.paths if os.path.isfile(p)]
    within = [os.path.relpath(os.path.abspath(p), root) for p in a.paths if os.path.isdir(p)]
    files, pinned = assets.on_disk(spark, place(a.root)), assets.pins(spark, m).select("path", F.lit(True).alias("pinned"))
    below = F.lit(False)
    for w in within:
        below = below | (F.lit(w == ".") | F.col("path").startswith(w + "/"))
    hidden = F.element_at(F.split("path", "/"), -1).startswith(".")
    own = files.join(pinned, "path", "left").where(F.col("path").isin(named) | (below & F.col("pinned").isNull() & ~hidden))
    return own.select(F.coalesce("pinned", F.lit(False)).alias("pinned"), integrity.entry(F.col("path"), F.col("actual")).alias("entry")).orderBy("entry")


def shown(df: DataFrame, rows: int = 100_000) -> None:
    """Print a table, and say so where it goes on."""
    df.show(rows, truncate=False)
    if (n := df.count()) > rows:
        print(f"{n - rows} of {n} rows are not shown")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemark", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *takes: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for arg, how in takes:
            c.add_argument(arg, **how)

    manifest = ("manifest", {}), ("root", {}), ("--only", {})
    drawn = ("--config", {}), ("--seed", {"type": int})
    command("fonts-scan", fonts_scan, ("folder", {}), ("--charset", {"default": "ascii_alnum"}), ("--exclude", {"action": "append", "default": []}), ("--include-variable", {"action": "store_true"}), ("--json", {}))
    command("arrival", arrival, ("folder", {}), *drawn, ("-n", {"type": int, "default": 50_000}))
    command("generate", generate, ("folder", {}), ("out", {}), *drawn, ("-n", {"type": int, "default": 10_000}), ("--shard-size", {"type": int, "default": store.SHARD}))
    command("preview", preview, ("folder", {}), ("out", {}), *drawn, ("--count", {"type": int, "default": 24}), ("--columns", {"type": int, "default": 6}), ("--cap-height", {}))
    command("recognize", recognize, ("stream", {"nargs": "?"}), ("--folder", {}), *drawn, ("-n", {"type": int, "default": 5_000}), ("--model", {"default": "baseline"}), ("--models", {}), ("--limit", {"type": int}), ("--no-classes", {"dest": "classes", "action": "store_false"}))
    command("models-list", models_list, ("--models", {}))
    command("assets-status", assets_status, *manifest)
    command("assets-fetch", assets_fetch, *manifest, ("--force", {"action": "store_true"}))
    command("assets-hash", assets_hash, ("manifest", {}), ("root", {}), ("paths", {"nargs": "+"}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from tidemark.session import session

        spark = session()
        spark.sparkContext.setLogLevel("ERROR")
    try:
        with reported(spark):
            shown(a.run(spark, a))
    except (ValueError, OSError, registry.ModelError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return int(getattr(a, "failed", False))


if __name__ == "__main__":
    sys.exit(main())
