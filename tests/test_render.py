"""Streams drawn from fonts built here: boxes, a ring, a curve and a composed glyph."""

import json
import struct

import numpy as np
import pytest
from test_sources import cmap, font, names

from tidemark import config
from tidemark.__main__ import main
from tidemark.functions import backgrounds, keys
from tidemark.sources import fonts, render, store
from tidemark.sources.outlines import Outlines, coverage, kerned


def box(x0: int, y0: int, x1: int, y1: int) -> bytes:
    """A glyph of one rectangle, all coordinates as 16-bit steps."""
    xs, ys = (x0, x0, x1, x1), (y0, y1, y1, y0)
    steps = [v - p for axis in (xs, ys) for p, v in zip((0, *axis), axis)]
    return struct.pack(">5h", 1, x0, y0, x1, y1) + struct.pack(">HH", 3, 0) + b"\1" * 4 + struct.pack(">8h", *steps) + b"\0\0"


def circle() -> bytes:
    """Four control points: a curve through the middles of a square's sides."""
    return struct.pack(">5h", 1, 0, 0, 400, 400) + struct.pack(">HH", 3, 0) + b"\0" * 4 + struct.pack(">8h", 0, 0, 400, 0, 0, 400, 0, -400)


def drawn_font(chars: str, family: str, height: int = 700, style: str = "Regular") -> bytes:
    glyphs = [b"", *[box(50, 0, 450, height)] * len(chars)]
    loca = np.cumsum([0, *map(len, glyphs)])
    head, hhea = bytearray(54), bytearray(36)
    struct.pack_into(">H", head, 18, 1000)
    struct.pack_into(">h", head, 50, 1)
    struct.pack_into(">H", hhea, 34, 1)
    parts = {"OS/2": bytes(78), "cmap": cmap(chars), "glyf": b"".join(glyphs), "head": bytes(head), "hhea": bytes(hhea), "hmtx": struct.pack(">Hh", 500, 0) + bytes(2 * len(chars)), "loca": struct.pack(f">{len(loca)}I", *loca), "maxp": struct.pack(">IH", 0x10000, len(glyphs)), "name": names(n1=family, n2=style), "post": bytes(32)}
    out, body, at = struct.pack(">4sHHHH", b"\0\1\0\0", len(parts), 0, 0, 0), b"", 12 + 16 * len(parts)
    for tag, data in parts.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at + len(body), len(data))
        body += data
    return out + body


def test_outlines_and_coverage():
    f = Outlines(drawn_font("HI", "Box"))
    assert f.capital_ratio() == 0.7 and set(map(tuple, f.contours(1)[0].tolist())) == {(50, 0), (50, 700), (450, 700), (450, 0)}
    lines, advance = f.set("HI", 20, 1.0)
    assert advance == 21 and len(lines) == 2 and lines[1][:, 0].min() == 12
    got = coverage([np.array([[1, 1], [1, 3], [3.5, 3], [3.5, 1]])], 5, 4)
    assert got[1:3].tolist() == [[0, 1, 1, 0.5, 0]] * 2 and not got[0].any() and not got[3].any()
    ring = [np.array([[0, 0], [0, 4], [4, 4], [4, 0]]), np.array([[1, 1], [3, 1], [3, 3], [1, 3]])]
    assert coverage(ring, 4, 4).sum() == 12
    f.glyf, f.at = circle() + b"", (0, len(circle()))
    assert coverage([x * 0.1 for x in f.contours(0)], 40, 40).sum() == pytest.approx(1600 * 5 / 6, rel=0.03)
    part = struct.pack(">5h", -1, 0, 0, 0, 0) + struct.pack(">HH4bh", 2 | 8, 0, 10, 20, 0, 0, 0)[:6] + struct.pack(">h", 8192)
    f.glyf, f.at = box(0, 0, 100, 100) + part, (0, len(box(0, 0, 100, 100)), len(box(0, 0, 100, 100)) + len(part))
    assert np.ptp(f.contours(1)[0], 0).tolist() == [50, 50] and f.contours(1)[0].min(0).tolist() == [10, 20]
    with pytest.raises(ValueError, match="outlines"):
        Outlines(font("AB", "No", "Glyphs"))


def test_kerning_pairs():
    def part(pairs, coverage):
        body = b"".join(struct.pack(">HHh", *p) for p in pairs)
        return struct.pack(">4H", 0, 14 + len(body), coverage, len(pairs)) + struct.pack(">3H", 6, 0, 0) + body

    table = struct.pack(">HH", 0, 4) + part([(1, 2, -100), (2, 1, 30)], 1) + part([(1, 2, -20)], 1) + part([(2, 1, 5)], 9) + part([(1, 1, 99)], 3)
    assert kerned(table) == {(1, 2): -120, (2, 1): 5} and kerned(None) == {} == kerned(struct.pack(">HH", 1, 0))
    f = Outlines(drawn_font("HI", "Box"))
    f.pairs = kerned(table)
    lines, advance = f.set("HIH", 100)
    assert advance == pytest.approx(150 - 12 + 0.5) and [line[:, 0].min() for line in lines] == pytest.approx([5, 43, 93.5])


def test_backgrounds_repeat_and_stay_in_range():
    for kind in backgrounds.KINDS:
        for h, w in ((14, 32), (220, 900), (1, 1)):
            one, two = (backgrounds.canvas(np.random.default_rng(5), h, w, kind) for _ in range(2))
            assert one.shape == (h, w, 3) and (one == two).all() and 0 <= one.min() and one.max() <= 255
    assert list(backgrounds.usable({"photo": 6.0, "solid": 1.0, "noise": 0.0})) == ["solid"]
    for bad in ({"photo": 1.0}, {"marble": 1.0}):
        with pytest.raises(ValueError):
            backgrounds.usable(bad)


def test_contrast_holds_in_the_ink():
    f, look = Outlines(drawn_font("H", "Box")), config.parse({"render": {"background": {"contrast_ratio": [3, 7]}, "crop": {"pad": 0.2, "neighbor_bleed_prob": 0.5}}}).render
    for i in range(30):
        pixels, facts = render.crop(f, "HHH", np.random.default_rng(i), look)
        x0, y0, x1, y1 = facts["crop_box"]
        assert pixels.shape == (y1 - y0, x1 - x0, 3) and facts["contrast_achieved"] >= 1.8
        left, top = facts["ink_box"][0] - x0, facts["ink_box"][1] - y0
        assert np.abs(pixels[top + 4, left + 4].astype(int) - facts["text_color"]).max() <= 1
    for bad in ({"render": {"crop": {"pads": 1}}}, {"render": {"crop": {"neighbor_bleed_prob": 2}}}, {"render": {"typography": {"cap_height_px": 0}}}, {"render": {"paper": {}}}):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_generate_replay_and_preview(spark, tmp_path, capsys):
    full, d = keys.charset("ascii_alnum"), tmp_path / "fonts"
    d.mkdir()
    for name, height in (("Low", 500), ("Tall", 900)):
        (d / f"{name}.ttf").write_bytes(drawn_font(full, name, height))
    (d / "Empty.ttf").write_bytes(font(full, "Empty", "Regular"))
    (tmp_path / "c.yaml").write_text("seed: 3\nrender: {typography: {cap_height_px: [14, 20]}, corpus: {words: [1, 2]}}")
    c = config.load(tmp_path / "c.yaml")
    one = {r["idx"]: r for r in render.generate(spark, c, f"file://{d}", 40).collect()}
    again = {r["idx"]: r for r in render.generate(spark, c, f"file://{d}", 60).repartition(7).where("idx < 40").collect()}
    assert len(one) == 40 and one == again
    assert {r["label"] for r in one.values() if r["error"]} == {"empty:regular"} and all((r["image"] is None) == bool(r["error"]) for r in one.values())
    facts = [json.loads(r["meta"]) for r in one.values() if r["meta"]]
    assert all(set(f["text"]) <= set(full + " ") and f["text"].strip() for f in facts)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(render, "BROADCAST", 0)
        assert {r["idx"]: r for r in render.generate(spark, c, f"file://{d}", 40).collect()} == one
    assert main(["generate", str(d), str(tmp_path / "s"), "--config", str(tmp_path / "c.yaml"), "-n", "20"], spark) == 0
    replay = store.read_stream(spark, f"file://{tmp_path}/s").select("idx", "label", "image", "meta").collect()
    good = [(i, r["image"], r["meta"]) for i, r in sorted(one.items()) if not r["error"]]
    assert [(r["idx"], r["image"], r["meta"]) for r in replay] == good[:20] and len(replay) == 20
    assert main(["recognize", str(tmp_path / "s")], spark) == 0
    assert main(["preview", str(d), str(tmp_path / "p.png"), "--count", "5", "--columns", "3"], spark) == 0
    seen = spark.read.format("image").load(f"file://{tmp_path}/p.png").select("image.height", "image.width", "image.nChannels").first()
    assert tuple(seen) == (56 + 14 + 8, 3 * 248 + 8, 3)  # two of the five have no outlines
