"""Relative luminance and contrast, as column expressions (the published sRGB and WCAG formulas)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import draws

# sRGB transfer constants and luminance weights.
KNEE, SLOPE, OFFSET, GAMMA = 0.04045, 12.92, 0.055, 2.4
RED, GREEN, BLUE = 0.2126, 0.7152, 0.0722


def linear(channel: Column) -> Column:
    """A byte 0..255 as linear light."""
    c = channel / 255.0
    return F.when(c <= KNEE, c / SLOPE).otherwise(F.pow((c + OFFSET) / (1 + OFFSET), F.lit(GAMMA)))


def encoded(light: Column) -> Column:
    """Linear light as a byte value 0..255, not rounded."""
    return 255.0 * F.when(light <= KNEE / SLOPE, light * SLOPE).otherwise((1 + OFFSET) * F.pow(light, F.lit(1 / GAMMA)) - OFFSET)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return RED * linear(r) + GREEN * linear(g) + BLUE * linear(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def solve(reference: Column, ratio: Column, darker: Column) -> Column:
    """The luminance at that contrast from the reference, held to 0..1."""
    out = F.when(darker, (reference + 0.05) / ratio - 0.05).otherwise((reference + 0.05) * ratio - 0.05)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def plan(low: Column, high: Column, ratio: Column, prefer_dark: Column) -> Column:
    """struct(luminance, darker, reference, achieved) for text over a patch whose luminance spans low..high.

    Each side is judged against the end it is closest to. The preferred side stays if it comes within half a percent of
    the ratio or is no worse than the other.
    """
    dark, light = solve(low, ratio, F.lit(True)), solve(high, ratio, F.lit(False))
    got_dark, got_light = contrast(dark, low), contrast(light, high)
    use_dark = F.when(prefer_dark, (got_dark >= 0.995 * ratio) | (got_dark >= got_light)).otherwise(~((got_light >= 0.995 * ratio) | (got_light >= got_dark)))
    return F.struct(
        F.when(use_dark, dark).otherwise(light).alias("luminance"), use_dark.alias("darker"),
        F.when(use_dark, low).otherwise(high).alias("reference"), F.when(use_dark, got_dark).otherwise(got_light).alias("achieved"),
    )


def crop_box(left: Column, top: Column, width: Column, height: Column, pads: list[Column], canvas_w: Column, canvas_h: Column) -> Column:
    """struct(x0, y0, x1, y1): the box with pads (left, top, right, bottom) in parts of its height, half-even rounded, inside the canvas, a pixel at least."""
    unit = F.greatest(F.lit(1), height)
    near = lambda at, pad, end: F.greatest(F.lit(0), F.least(F.bround(at - pad * unit).cast("int"), end - 1))
    far = lambda at, pad, end: F.least(end, F.greatest(F.bround(at + pad * unit).cast("int"), F.lit(1)))
    x0, y0 = near(left, pads[0], canvas_w), near(top, pads[1], canvas_h)
    x1, y1 = far(left + width, pads[2], canvas_w), far(top + height, pads[3], canvas_h)
    return F.struct(x0.alias("x0"), y0.alias("y0"), F.greatest(x1, x0 + 1).alias("x1"), F.greatest(y1, y0 + 1).alias("y1"))


# The distribution of a random colour's saturation, and the least of its values.
SATURATION, LEAST_VALUE = (1.4, 3.0), 0.15


def from_hsv(hue: Column, saturation: Column, value: Column) -> Column:
    """r, g, b (bytes) of hue, saturation and value, each 0 to 1: a channel falls from the value by how far the hue is from it."""

    def channel(turn: int) -> Column:
        k = F.pmod(hue * 6 + turn, F.lit(6.0))
        return F.bround(255 * (value - value * saturation * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))).cast("int")

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


def random_colour(u_hue: Column, u_saturation: Column, u_value: Column) -> Column:
    """r, g, b of an arbitrary colour, of low saturation more often than not."""
    return from_hsv(u_hue, draws.beta(u_saturation, *SATURATION), draws.between(u_value, LEAST_VALUE, 1.0))
