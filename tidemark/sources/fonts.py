"""Font files as rows of the label space: listed, parsed from their published tables, admitted or rejected.

Files are read by Spark's binaryFile source, so listing runs where Spark reads and never fetches content that is not
needed. Each file is parsed on its own in the task that reads it; what cannot be parsed is a row with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators.labels import admitted

# Name ids by preference, and character maps (platform, encoding) by preference.
FAMILY, SUBFAMILY = (16, 1), (17, 2)
MAPS = [(3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0)]
ENGLISH = {(1, 0), (3, 0x409)}

FACE = "path string, family string, subfamily string, declared int, width_class int, italic boolean, monospace boolean, variable boolean, units_per_em int, n_glyphs int, codepoints array<int>, error string"
_COLUMNS = [c.split()[0] for c in FACE.split(", ")]


def font_files(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, content of .ttf and .otf files (any case) below folder, less those whose name or path fits a glob of exclude."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    own = own.where(F.lower("path").rlike(r"\.(ttf|otf)$"))
    name = F.element_at(F.split("path", "/"), -1)
    for glob in exclude:
        own = own.where(~(name.rlike(keys.glob_regex(glob)) | F.col("path").rlike(keys.glob_regex(glob))))
    return own


def tables(data: bytes) -> dict[str, bytes]:
    """The tables of an sfnt file by tag."""
    if data[:4] not in (b"\0\1\0\0", b"OTTO", b"true"):
        raise ValueError("not a font file")
    out = {}
    for i in range(struct.unpack_from(">H", data, 4)[0]):
        tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
        if at + size > len(data):
            raise ValueError(f"table {tag!r} is cut off")
        out[tag.decode("latin-1")] = data[at : at + size]
    return out


def named(table: bytes | None, ids: tuple[int, ...]) -> str | None:
    """The first name that isn't blank of the ids, in English if it is there, else the last one."""
    if not table:
        return None
    _, n, base = struct.unpack_from(">HHH", table)
    for want in ids:
        found = None
        for i in range(n):
            platform, encoding, language, name, size, at = struct.unpack_from(">6H", table, 6 + 12 * i)
            if name != want:
                continue
            raw = table[base + at : base + at + size]
            try:
                found = raw.decode("mac_roman" if platform == 1 else "utf-16-be")
            except UnicodeDecodeError:
                continue
            if (platform, language) in ENGLISH:
                break
        if found and found.strip():
            return found.strip()
    return None


def _segments(t: bytes) -> dict[int, int]:
    """A map of format 4, glyph 0 and the closing segment left out."""
    n = struct.unpack_from(">H", t, 6)[0] // 2
    ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", t, at) for at in (14, 16 + 2 * n, 16 + 4 * n, 16 + 6 * n))
    out = {}
    for i in range(n):
        for c in range(starts[i], min(ends[i], 0xFFFE) + 1):
            glyph = c
            if offsets[i]:
                at = 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - starts[i])
                glyph = struct.unpack_from(">H", t, at)[0] if at + 2 <= len(t) else 0
                if not glyph:
                    continue
            if glyph := (glyph + deltas[i]) & 0xFFFF:
                out.setdefault(c, glyph)
    return out


def glyphs(table: bytes | None) -> dict[int, int]:
    """The glyph of each mapped code point of the best Unicode map; none without one."""
    if not table:
        return {}
    n = struct.unpack_from(">H", table, 2)[0]
    places = {(p, e): at for p, e, at in (struct.unpack_from(">HHI", table, 4 + 8 * i) for i in range(n))}
    best = next((places[m] for m in MAPS if m in places), None)
    if best is None:
        return {}
    t = table[best:]
    kind = struct.unpack_from(">H", t)[0]
    if kind == 0:
        return {c: g for c, g in enumerate(t[6:262]) if g}
    if kind == 4:
        return _segments(t)
    if kind == 6:
        first, count = struct.unpack_from(">HH", t, 6)
        return {first + i: g for i, g in enumerate(struct.unpack_from(f">{count}H", t, 10)) if g}
    if kind in (12, 13):
        out: dict[int, int] = {}
        for i in range(struct.unpack_from(">I", t, 12)[0]):
            a, b, glyph = struct.unpack_from(">III", t, 16 + 12 * i)
            if b > 0x10FFFF:
                raise ValueError("a code point beyond Unicode")
            out.update((c, g) for c in range(a, b + 1) if (g := glyph + (c - a if kind == 12 else 0)))
        return out
    return {}


def codepoints(table: bytes | None) -> list[int]:
    """The mapped code points of the best Unicode map, sorted."""
    return sorted(glyphs(table))


def parsed(path: str, data: bytes) -> tuple:
    """The columns of FACE for one file."""
    t = tables(data)
    os2, head, post = (t.get(k) for k in ("OS/2", "head", "post"))
    at = lambda table, kind, place, default: struct.unpack_from(kind, table, place)[0] if table else default
    italic = bool(at(os2, ">H", 62, 0) & 1 or at(head, ">H", 44, 0) & 2 or abs(at(post, ">i", 4, 0) / 65536) > 0.5)
    return (
        path, named(t.get("name"), FAMILY) or PurePosixPath(path).stem, named(t.get("name"), SUBFAMILY) or "Regular", at(os2, ">H", 4, None), at(os2, ">H", 6, 5), italic,
        bool(at(post, ">I", 12, 0)), "fvar" in t, at(head, ">H", 18, 1000), struct.unpack_from(">H", t["maxp"], 4)[0], codepoints(t.get("cmap")), None,
    )


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, data in zip(f["path"], f["content"]):
            try:
                rows.append(parsed(path, bytes(data)))
            except (ValueError, KeyError, struct.error) as e:
                rows.append((path, *[None] * (len(_COLUMNS) - 2), f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def faces(files: DataFrame) -> DataFrame:
    """A row for each file (path, content): face_id, weight and the columns of FACE; error is set where it can't be parsed."""
    own = files.mapInPandas(_parse, FACE)
    face_id = F.concat(keys.slug(F.col("family")), F.lit(":"), keys.slug(F.col("subfamily")))
    return own.withColumns({"face_id": F.when(F.col("error").isNull(), face_id), "weight": keys.style_weight(F.col("declared"), F.col("subfamily"))}).drop("declared")


def scan(spark: SparkSession, folder: str, charset: str = "ascii_alnum", exclude: tuple[str, ...] = (), include_variable: bool = False) -> DataFrame:
    """All font files below folder with status kept, rejected or unreadable, and why.

    Ids of several files are made unique in path order, over the readable ones, before any is rejected.
    """
    own = faces(font_files(spark, folder, exclude))
    good = admitted(own.where("error is null"), charset, include_variable)
    bad = own.where("error is not null").withColumns({"reason": F.lit("unreadable"), "status": F.lit("unreadable"), "detail": F.col("error")})
    return good.unionByName(bad)
