"""Files against pinned checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import digest


def status(pins: DataFrame, files: DataFrame) -> DataFrame:
    """path, state (ok, missing, changed), actual for each pin (path, sha256) against files (path, actual)."""
    both = pins.select("path", digest(F.col("sha256")).alias("want")).join(files.select("path", "actual"), "path", "left")
    return both.select("path", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("want"), "ok").otherwise("changed").alias("state"), "actual")


def told(state: Column) -> Column:
    """What a state means, and what to do about it."""
    return F.when(state == "ok", "as pinned").when(state == "missing", "not on disk: fetch it").otherwise("other bytes than pinned: fetch it by force, or pin these")


def folder(path: str) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def untracked(pins: DataFrame, files: DataFrame) -> DataFrame:
    """path of files without a pin in folders that hold a pinned one; hidden files are left out."""
    known = pins.select(folder("path").alias("folder")).distinct()
    own = files.select("path", folder("path").alias("folder")).where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    return own.join(known, "folder", "left_semi").join(pins.select("path"), "path", "left_anti").select("path")


def duplicate_names(pins: DataFrame) -> DataFrame:
    """name, n of file names pinned more than once."""
    return pins.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def valid_path(path: Column) -> Column:
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def entry(path: Column, sha: Column) -> Column:
    """A manifest entry to paste."""
    return F.format_string("- path: %s\n  sha256: %s\n  license:\n  source:", path, sha)
