"""Repeatable randomness: every draw is a hash of (namespace, seed, index, purpose) and of nothing else."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(index: Column, purpose: str | Column, seed: int = 0, space: str = "item") -> Column:
    """Uniform in [0, 1), 52 bits of SHA-256."""
    text = F.concat(F.lit(f"{space}:{seed}:"), index.cast("string"), F.lit(":"), F.lit(purpose) if isinstance(purpose, str) else purpose)
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def digest(index: Column, purpose: str, seed: int = 0, space: str = "item") -> Column:
    """A digest that holds four draws: see part."""
    return F.sha2(F.concat(F.lit(f"{space}:{seed}:"), index.cast("string"), F.lit(f":{purpose}")), 256)


def part(of: Column, k: int) -> Column:
    """Draw k (0 to 3) of a digest, uniform in [0, 1); draw 0 is that of uniform."""
    return F.conv(F.substring(of, 13 * k + 1, 13), 16, 10).cast("double") / float(1 << 52)


def uniform_sql(index: str, purpose: str, seed: int = 0, space: str = "item", k: int = 0) -> str:
    return f"(('0x' || substr(sha256('{space}:{seed}:' || ({index}) || ':{purpose}'), {13 * k + 1}, 13))::BIGINT::DOUBLE / {1 << 52})"


def between(u: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + u * (hi - lo)


def log_between(u: Column, lo: float, hi: float) -> Column:
    return F.exp(F.log(F.lit(lo)) + u * (F.log(F.lit(hi)) - F.log(F.lit(lo))))


def integer(u: Column, lo: int, hi: int) -> Column:
    """An integer of lo..hi."""
    return (F.floor(u * (hi - lo + 1)) + lo).cast("int")


def choice(u: Column, values: Sequence[str]) -> Column:
    """One of some values, each as likely as another."""
    if any("\n" in v for v in values):
        raise ValueError("values to choose from must be without line ends")
    return F.element_at(F.split(F.lit("\n".join(values)), "\n", -1), integer(u, 1, len(values)))  # one constant, however many there are


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """A key, by weight: keys in sorted order, those without weight left out."""
    own = sorted((k, w) for k, w in weights.items() if w > 0)
    if not own:
        raise ValueError("all weights are zero")
    total, at, out = sum(w for _, w in own), 0.0, None
    for k, w in own:
        at += w
        out = F.when(u * total < at, k) if out is None else out.when(u * total < at, k)
    return out.otherwise(own[-1][0])


def weighted_sql(u: str, weights: dict[str, float]) -> str:
    own, at, cases = sorted((k, w) for k, w in weights.items() if w > 0), 0.0, []
    total = sum(w for _, w in own)
    for k, w in own:
        at += w
        cases.append(f"WHEN {u} * {total!r}::DOUBLE < {at!r} THEN '{k}'")
    return f"CASE {' '.join(cases)} ELSE '{own[-1][0]}' END"


#: Stretches of equal probability of an inverse distribution.
STEPS = 4096


@lru_cache(32)
def beta_table(a: float, b: float) -> str:
    """The inverse of a Beta distribution at STEPS + 1 equal steps of probability, joined by commas.

    The density is integrated over x = sin(t)^2, where it has no poles for a and b of 0.5 and more, by Simpson's rule; the
    integral is inverted by halving and interpolation.
    """
    if a < 0.5 or b < 0.5:
        raise ValueError("beta variates need a and b of 0.5 or more")
    t = np.linspace(0, np.pi / 2, (1 << 17) + 1)
    density = np.sin(t) ** (2 * a - 1) * np.cos(t) ** (2 * b - 1)
    parts = (density[:-2:2] + 4 * density[1::2] + density[2::2]) / 6
    mass = np.append(0, np.cumsum(parts))
    at = np.interp(np.linspace(0, mass[-1], STEPS + 1), mass, t[::2])
    return ",".join(f"{x:.15g}" for x in np.sin(at) ** 2)


def beta(u: Column, a: float, b: float) -> Column:
    """A Beta(a, b) variate of a uniform one, between the table's steps in proportion."""
    table = F.split(F.lit(beta_table(a, b)), ",").cast("array<double>")  # folded to a constant
    step = F.floor(u * STEPS)
    low = F.get(table, step.cast("int"))
    return low + (u * STEPS - step) * (F.get(table, (step + 1).cast("int")) - low)
