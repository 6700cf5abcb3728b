"""Pinned assets: a manifest of paths and checksums, where each is fetched from, and a verified download.

The manifest is a small file by design (one entry an asset) and is read on the driver; checksums of files on disk are
computed where Spark reads them.
"""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import digest, glob_regex
from tidemark.operators import integrity
from tidemark.sources.store import checksums

PIN = "path string, name string, sha256 string, license string, source string"
CHUNK = 1 << 20


class ManifestError(ValueError):
    """A manifest that is missing, isn't YAML or doesn't say what it must."""


class FetchError(RuntimeError):
    """An asset that could not be fetched or isn't what was pinned."""


@dataclass(frozen=True)
class Manifest:
    release: str
    assets: tuple[dict[str, Any], ...] = ()
    timeout: float = 30.0


def load(path: str | Path) -> Manifest:
    """A manifest from a YAML file, checked: known keys, relative paths, SHA-256 given as text, no path or file name twice."""
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text())
    except FileNotFoundError as e:
        raise ManifestError(f"no manifest at {path}") from e
    except yaml.YAMLError as e:
        raise ManifestError(f"{path} is not YAML: {e}") from e
    return parse(data)


def parse(data: Any) -> Manifest:
    if not isinstance(data, dict) or not isinstance(data.get("release"), str) or set(data) - {"release", "assets", "timeout"}:
        raise ManifestError("a manifest has release, assets and timeout only")
    timeout = data.get("timeout", 30.0)
    if isinstance(timeout, bool) or not isinstance(timeout, (int, float)) or timeout <= 0:
        raise ManifestError(f"bad timeout {timeout!r}")
    own = []
    for a in data.get("assets") or ():
        if not isinstance(a, dict) or set(a) - {"path", "sha256", "license", "source"} or not isinstance(a.get("path"), str):
            raise ManifestError(f"bad asset {a!r}")
        at, sha = PurePosixPath(a["path"]), a.get("sha256")
        sha = sha.strip().lower() if isinstance(sha, str) else ""
        if at.is_absolute() or ".." in at.parts or len(sha) != 64 or set(sha) - set("0123456789abcdef"):
            raise ManifestError(f"bad path or checksum of {a['path']!r}")
        own.append({"path": str(at), "name": at.name, "sha256": sha, "license": a.get("license"), "source": a.get("source")})
    for key in ("path", "name"):
        if twice := [k for k, n in Counter(a[key] for a in own).items() if n > 1]:
            raise ManifestError(f"{key} pinned twice: {', '.join(twice)}")
    return Manifest(data["release"], tuple(own), float(timeout))


def pins(spark: SparkSession, manifest: Manifest) -> DataFrame:
    return spark.createDataFrame(list(manifest.assets), PIN)


def matching(own: DataFrame, glob: str | None) -> DataFrame:
    """The pins whose path or file name fits the glob; all without one."""
    return own if glob is None else own.where(F.col("path").rlike(glob_regex(glob)) | F.col("name").rlike(glob_regex(glob)))


def url(release: str, name: Column) -> Column:
    """Where a file of that name is fetched from: {name} in the release is replaced, else the name is appended."""
    if "{name}" in release:
        return F.replace(F.lit(release), F.lit("{name}"), name)
    return F.concat(F.lit(release.rstrip("/") + "/"), name)


def on_disk(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), actual: the SHA-256 of every file below root."""
    base = urllib.parse.urlsplit(root).path.rstrip("/")
    at = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return checksums(spark, root).select(F.substr(at, F.lit(len(base) + 2)).alias("path"), "actual")


def due(own: DataFrame, files: DataFrame, release: str, force: bool = False) -> DataFrame:
    """path, sha256, url of the pins that are missing or changed, or of all if forced."""
    state = integrity.status(own, files).where(F.lit(force) | (F.col("state") != "ok")).select("path")
    return own.join(state, "path", "left_semi").select("path", digest(F.col("sha256")).alias("sha256"), url(release, F.col("name")).alias("url"))


def download(source: str, to: Path, sha256: str, timeout: float = 30.0) -> int:
    """Fetch over http or https into a file beside ``to``, which takes its place once the checksum is right; the bytes read."""
    if urllib.parse.urlsplit(source).scheme.lower() not in ("http", "https"):
        raise FetchError(f"only http and https are fetched: {source}")
    to.parent.mkdir(parents=True, exist_ok=True)
    part, seen, size = to.with_name(to.name + ".part"), hashlib.sha256(), 0
    try:
        with urllib.request.urlopen(source, timeout=timeout) as got, part.open("wb") as out:
            while block := got.read(CHUNK):
                seen.update(block)
                size += out.write(block)
        if seen.hexdigest() != sha256:
            raise FetchError(f"checksum mismatch: pinned {sha256[:12]}, fetched {seen.hexdigest()[:12]} in {size} bytes")
        os.replace(part, to)
    except urllib.error.HTTPError as e:
        raise FetchError(f"HTTP {e.code}") from e
    except OSError as e:
        raise FetchError(f"{type(e).__name__}: {e}") from e
    finally:
        part.unlink(missing_ok=True)
    return size


def fetch(rows: DataFrame, root: str | Path, timeout: float = 30.0) -> Iterator[tuple[str, int | None, str | None]]:
    """(path, bytes, error) for each row of due(), one after the other on the driver: downloads are side effects of one machine."""
    for r in rows.orderBy("path").toLocalIterator():
        try:
            yield r["path"], download(r["url"], Path(root) / r["path"], r["sha256"], timeout), None
        except FetchError as e:
            yield r["path"], None, str(e)
