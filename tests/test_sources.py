"""Font files, built here table by table, and recognizers found in a folder."""

import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.models import registry
from tidemark.operators import neighbours
from tidemark.sources import fonts


def cmap(chars: str) -> bytes:
    codes = sorted(map(ord, chars))
    n = len(codes) + 1
    ends, starts = [*codes, 0xFFFF], [*codes, 0xFFFF]
    deltas = [(i + 1 - c) % 65536 for i, c in enumerate(codes)] + [1]
    body = struct.pack(">4H", 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *ends) + b"\0\0" + struct.pack(f">{3 * n}H", *starts, *deltas, *[0] * n)
    return struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHH", 4, 6 + len(body), 0) + body


def names(**by_id: str) -> bytes:
    records, text = b"", b""
    for k, v in by_id.items():
        raw = v.encode("utf-16-be")
        records += struct.pack(">6H", 3, 1, 0x409, int(k[1:]), len(raw), len(text))
        text += raw
    return struct.pack(">HHH", 0, len(by_id), 6 + len(records)) + records + text


def font(chars: str, family: str, style: str, weight: int = 400, variable: bool = False, italic: bool = False) -> bytes:
    os2 = bytearray(78)
    struct.pack_into(">HH", os2, 4, weight, 5)
    struct.pack_into(">H", os2, 62, int(italic))
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 1000)
    parts = {"OS/2": bytes(os2), "cmap": cmap(chars), "head": bytes(head), "maxp": struct.pack(">IH", 0x10000, len(chars) + 1), "name": names(n1=family, n2=style), "post": bytes(32)}
    if variable:
        parts["fvar"] = bytes(16)
    out, body, at = struct.pack(">4sHHHH", b"\0\1\0\0", len(parts), 0, 0, 0), b"", 12 + 16 * len(parts)
    for tag, data in parts.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at + len(body), len(data))
        body += data
    return out + body


def test_scan_keeps_rejects_and_reports(spark, tmp_path):
    full = keys.charset("ascii_alnum")
    (tmp_path / "sub").mkdir()
    for name, data in {
        "a.ttf": font(full, "Acme Grötesk", "Bold", 700), "b.TTF": font(full, "Acme Grotesk", "Bold", 0, italic=True), "sub/c.otf": font(full, "Vary", "Regular", variable=True),
        "d.ttf": font(full.replace("Q", ""), "Lack", "Light"), "e.ttf": b"no font at all", "f.ttf": font(full, "Cut", "Off")[:300], "g.txt": b"", "skip.ttf": font(full, "Skip", "Regular"),
    }.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r for r in fonts.scan(spark, f"file://{tmp_path}", exclude=("skip*",)).collect()}
    assert {k: (r["status"], r["reason"]) for k, r in got.items()} == {
        "a.ttf": ("kept", None), "b.TTF": ("kept", None), "c.otf": ("rejected", "variable-font"), "d.ttf": ("rejected", "missing-glyphs"), "e.ttf": ("unreadable", "unreadable"), "f.ttf": ("unreadable", "unreadable"),
    }
    assert (got["a.ttf"]["face_id"], got["b.TTF"]["face_id"]) == ("acme-grotesk:bold", "acme-grotesk:bold#2")
    assert got["b.TTF"]["weight"] == 700 and got["b.TTF"]["italic"] and not got["a.ttf"]["italic"]
    assert sorted(got["a.ttf"]["codepoints"]) == sorted(map(ord, full)) and got["a.ttf"]["n_glyphs"] == 63
    assert got["d.ttf"]["detail"] == "Q"


def test_maps_of_other_formats():
    twelve = struct.pack(">HHHHI", 0, 1, 3, 10, 12) + struct.pack(">HHIII", 12, 0, 40, 0, 2) + struct.pack(">6I", 65, 67, 1, 0x1F600, 0x1F600, 9)
    six = struct.pack(">HHHHI", 0, 1, 0, 3, 12) + struct.pack(">5H", 6, 16, 0, 48, 3) + struct.pack(">3H", 1, 0, 2)
    assert fonts.codepoints(twelve) == [65, 66, 67, 0x1F600] and fonts.codepoints(six) == [48, 50] and fonts.codepoints(None) == []


MODEL = """
from tidemark.models.registry import Recognizer

class Count(Recognizer):
    name = "count"
    def __init__(self): self.n = 0
    def predict(self, features): return None if not self.n else str(self.n)
    def learn(self, features, label): self.n += 1
"""


def test_recognizers_of_a_folder(spark, tmp_path):
    (tmp_path / "count.py").write_text(MODEL)
    (tmp_path / "_own.py").write_text("raise ValueError")
    assert list(registry.discover(tmp_path)) == ["baseline", "count", "last-seen", "replay-head"]
    own = spark.range(40).select((F.col("id") % 3).cast("string").alias("stream_id"), F.col("id").alias("idx"), F.lit("a").alias("label"), F.lit(1.0).alias("features"))
    rows = registry.prequential(own, registry.load("count", tmp_path)).collect()
    assert {(r["idx"], r["pred"]) for r in rows} == {(i, str(i // 3) if i >= 3 else None) for i in range(40)}
    with pytest.raises(registry.ModelNotFound, match="baseline, count, last-seen"):
        registry.load("other", tmp_path)
    (tmp_path / "twin.py").write_text(MODEL)
    with pytest.raises(registry.ModelError, match="several models: count"):
        registry.discover(tmp_path)
    (tmp_path / "twin.py").write_text("1 / 0")
    with pytest.raises(registry.ModelError, match="cannot run .*twin.py: ZeroDivisionError"):
        registry.discover(tmp_path)
