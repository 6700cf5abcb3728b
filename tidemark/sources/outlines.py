"""Outlines of TrueType fonts, drawn as coverage: winding numbers on a grid FINE times as fine, averaged to pixels.

Text is set by advance widths and the pairs of a ``kern`` table, without ligatures or the kerning of other tables. Outlines of other kinds (CFF) are a ValueError.
"""

from __future__ import annotations

import struct

import numpy as np

from tidemark.sources import fonts

FINE, STEPS, NESTED = 4, 6, 8
CAPITALS = "HXEIT"


class Outlines:
    def __init__(self, data: bytes) -> None:
        t = fonts.tables(data)
        if lacking := {"glyf", "loca", "head", "hhea", "hmtx", "cmap", "maxp"} - set(t):
            raise ValueError(f"no TrueType outlines: {', '.join(sorted(lacking))} missing")
        self.glyf, self.glyphs = t["glyf"], fonts.glyphs(t["cmap"])
        self.units = struct.unpack_from(">H", t["head"], 18)[0] or 1000
        n, long = struct.unpack_from(">H", t["maxp"], 4)[0], struct.unpack_from(">h", t["head"], 50)[0]
        self.at = struct.unpack_from(f">{n + 1}I", t["loca"]) if long else [2 * x for x in struct.unpack_from(f">{n + 1}H", t["loca"])]
        wide = struct.unpack_from(">H", t["hhea"], 34)[0]
        self.widths = [struct.unpack_from(">H", t["hmtx"], 4 * i)[0] for i in range(wide)]
        self.pairs = kerned(t.get("kern"))

    def advance(self, glyph: int) -> int:
        return self.widths[min(glyph, len(self.widths) - 1)] if self.widths else self.units

    def contours(self, glyph: int, level: int = 0) -> list[np.ndarray]:
        """Closed lines of a glyph in font units, curves cut into STEPS."""
        if not 0 <= glyph < len(self.at) - 1 or level > NESTED:
            return []
        data = self.glyf[self.at[glyph] : self.at[glyph + 1]]
        if len(data) < 10:
            return []
        n = struct.unpack_from(">h", data)[0]
        return self._simple(data, n) if n >= 0 else self._composed(data, level)

    def _simple(self, data: bytes, n: int) -> list[np.ndarray]:
        ends = struct.unpack_from(f">{n}H", data, 10)
        if not n:
            return []
        p = 12 + 2 * n + struct.unpack_from(">H", data, 10 + 2 * n)[0]
        flags: list[int] = []
        while len(flags) <= ends[-1]:
            flags += [data[p]] * (1 + (data[p + 1] if data[p] & 8 else 0))
            p += 2 if data[p] & 8 else 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, out = 0, []
            for f in flags[: ends[-1] + 1]:
                if f & short:
                    v, p = v + (data[p] if f & same else -data[p]), p + 1
                elif not f & same:
                    v, p = v + struct.unpack_from(">h", data, p)[0], p + 2
                out.append(v)
            axes.append(out)
        points, on = np.array(axes, float).T, np.array(flags[: ends[-1] + 1]) & 1 == 1
        starts = [0, *(e + 1 for e in ends[:-1])]
        return [_line(points[a : b + 1], on[a : b + 1]) for a, b in zip(starts, ends) if b > a]

    def _composed(self, data: bytes, level: int) -> list[np.ndarray]:
        p, out, more = 10, [], True
        while more:
            flags, part = struct.unpack_from(">HH", data, p)
            kind = (">hh" if flags & 1 else ">bb") if flags & 2 else (">HH" if flags & 1 else ">BB")
            shift = struct.unpack_from(kind, data, p + 4)
            p += 4 + struct.calcsize(kind)
            k = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            s = [x / 16384 for x in struct.unpack_from(f">{k}h", data, p)]
            p += 2 * k
            turn = np.array([1, 0, 0, 1] if not k else s if k == 4 else [s[0], 0, 0, s[-1]], float).reshape(2, 2)
            move = np.array(shift if flags & 2 else (0, 0), float)
            out += [c @ turn + move for c in self.contours(part, level + 1)]
            more = bool(flags & 32)
        return out

    def capital_ratio(self) -> float:
        """Height of a capital over the em, 0.7 where there is none."""
        for c in CAPITALS:
            if lines := self.contours(self.glyphs.get(ord(c), 0)) if ord(c) in self.glyphs else []:
                y = np.concatenate(lines)[:, 1]
                if y.max() > y.min():
                    return float(y.max() - y.min()) / self.units
        return 0.7

    def set(self, text: str, em: float, spacing: float = 0.0) -> tuple[list[np.ndarray], float]:
        """(closed lines in pixels with y downwards from the base line, width of the advances)."""
        scale, pen, out, before = em / self.units, 0.0, [], None
        for i, c in enumerate(text):
            pen += spacing if i else 0.0
            glyph = self.glyphs.get(ord(c), 0)
            pen += self.pairs.get((before, glyph), 0) * scale
            before = glyph
            out += [line * [scale, -scale] + [pen, 0.0] for line in self.contours(glyph)]
            pen += self.advance(glyph) * scale
        return out, pen


def kerned(table: bytes | None) -> dict[tuple[int, int], int]:
    """What is added between two glyphs, from the horizontal pair lists (format 0) of a kern table of version 0."""
    out: dict[tuple[int, int], int] = {}
    if not table or struct.unpack_from(">H", table)[0] != 0:
        return out
    at = 4
    for _ in range(struct.unpack_from(">H", table, 2)[0]):
        _, size, coverage, n = struct.unpack_from(">4H", table, at)
        if coverage >> 8 == 0 and coverage & 1 and not coverage & 6:  # horizontal, neither minima nor across the line
            for k in range(n):
                left, right, value = struct.unpack_from(">HHh", table, at + 14 + 6 * k)
                out[left, right] = value if coverage & 8 else out.get((left, right), 0) + value
        at += size
    return out


def _line(points: np.ndarray, on: np.ndarray) -> np.ndarray:
    """A contour's points as a closed line: two control points in a row have a point halfway between them."""
    full: list[tuple[np.ndarray, bool]] = []
    for i in range(len(points)):
        if not on[i] and not on[i - 1]:
            full.append(((points[i] + points[i - 1]) / 2, True))
        full.append((points[i], bool(on[i])))
    first = next(i for i, (_, o) in enumerate(full) if o)
    full = full[first:] + full[: first + 1]
    out = [full[0][0]]
    u = (np.arange(1, STEPS + 1) / STEPS)[:, None]
    for (a, _), (b, anchored), (c, _) in zip(full, full[1:], full[2:] + full[:1]):
        if anchored:
            out.append(b)
        else:
            out.extend((1 - u) ** 2 * a + 2 * u * (1 - u) * b + u**2 * c)
    return np.array(out)


def coverage(lines: list[np.ndarray], width: int, height: int, dx: float = 0.0, dy: float = 0.0) -> np.ndarray:
    """(height, width) of 0..1: how much of each pixel the shifted lines wind around."""
    fine = np.zeros((height * FINE, width * FINE + 1), np.int32)
    if lines:
        a = (np.concatenate(lines) + [dx, dy]) * FINE
        b = (np.concatenate([np.roll(x, -1, 0) for x in lines]) + [dx, dy]) * FINE
        low, high = (np.clip(np.ceil(f(a[:, 1], b[:, 1]) - 0.5), 0, len(fine)).astype(int) for f in (np.minimum, np.maximum))
        n = high - low
        edge = np.repeat(np.arange(len(n)), n)
        row = low[edge] + np.arange(len(edge)) - np.repeat(n.cumsum() - n, n)
        a, b = a[edge], b[edge]
        x = a[:, 0] + (row + 0.5 - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        np.add.at(fine, (row, np.clip(np.ceil(x - 0.5), 0, width * FINE).astype(int)), np.where(b[:, 1] > a[:, 1], 1, -1))
    return (fine.cumsum(1)[:, :-1] != 0).reshape(height, FINE, width, FINE).mean((1, 3))
