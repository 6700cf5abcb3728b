"""Closed configuration: unknown keys, empty ranges and negative weights are errors when a file is loaded."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from tidemark.functions.text import KINDS


# The keys and defaults of all configuration classes below are those of existing configuration files.


@dataclass(frozen=True)
class Range:
    """A closed interval; also given as [lo, hi] or one number."""

    lo: float
    hi: float

    def __post_init__(self) -> None:
        if not self.lo <= self.hi:
            raise ValueError(f"empty range {self.lo}..{self.hi}")

    @classmethod
    def of(cls, value: Any) -> Range:
        if isinstance(value, Range):
            return value
        if isinstance(value, str) and ":" in value:
            value = [float(x) for x in value.split(":")]
        if isinstance(value, dict):
            return cls(**value)
        return cls(*value) if isinstance(value, (list, tuple)) else cls(value, value)


@dataclass(frozen=True)
class Rule:
    """How common a label is, and when it may arrive: weight (None: the default), from start up to stop."""

    weight: float | None = None
    start: int = 0
    stop: int | None = None

    def __post_init__(self) -> None:
        if self.weight is not None and self.weight < 0 or self.start < 0 or self.stop is not None and self.stop <= self.start:
            raise ValueError(f"bad rule {self}")


@dataclass(frozen=True)
class Arrival:
    default_weight: float = 1.0
    fonts: dict[str, Rule] = field(default_factory=dict)


@dataclass(frozen=True)
class Fonts:
    font_dir: str = "assets/fonts"
    admission_charset: str = "ascii_alnum"
    exclude: tuple[str, ...] = ()
    include_variable: bool = False


@dataclass(frozen=True)
class Corpus:
    kinds: dict[str, float] = field(default_factory=lambda: dict(KINDS))
    words: Range = Range(2, 5)
    casing: dict[str, float] = field(default_factory=lambda: {"as_is": 4.0, "title": 3.0, "upper": 2.0, "lower": 1.0})


@dataclass(frozen=True)
class Typography:
    """Height of capitals in pixels, drawn evenly over its logarithm; letter_spacing is a share of it."""

    cap_height_px: Range = Range(18.0, 64.0)
    letter_spacing: Range = Range(0.0, 0.0)


@dataclass(frozen=True)
class Background:
    sources: dict[str, float] = field(default_factory=lambda: {"photo": 6.0, "noise": 1.0, "blobs": 1.0, "geometric": 0.75, "gradient": 0.75, "vignette": 0.25, "solid": 0.25})
    photo_dir: str = "assets/backgrounds"
    photo_scale: Range = Range(0.5, 3.0)
    contrast_ratio: Range = Range(4.5, 16.0)
    dark_text_prob: float = 0.6
    saturated_prob: float = 0.25
    scrim_prob: float = 0.15
    scrim_opacity: Range = Range(0.25, 0.8)
    min_contrast: float = 1.9


@dataclass(frozen=True)
class Crop:
    """Padding and gaps are shares of the height of the ink."""

    pad: Range = Range(-0.04, 0.35)
    neighbor_bleed_prob: float = 0.0
    neighbor_gap: Range = Range(0.15, 0.7)


@dataclass(frozen=True)
class Render:
    corpus: Corpus = field(default_factory=Corpus)
    typography: Typography = field(default_factory=Typography)
    background: Background = field(default_factory=Background)
    crop: Crop = field(default_factory=Crop)

    def __post_init__(self) -> None:
        if self.typography.cap_height_px.lo <= 0:
            raise ValueError("cap_height_px must be positive")
        for part in (self.background, self.crop):
            for f in dataclasses.fields(part):
                if f.name.endswith("_prob") and not 0 <= getattr(part, f.name) <= 1:
                    raise ValueError(f"{f.name} is no probability")
        for weights in (self.corpus.kinds, self.corpus.casing, self.background.sources):
            if min(weights.values(), default=0) < 0:
                raise ValueError("a weight is negative")


@dataclass(frozen=True)
class StreamConfig:
    seed: int = 0
    fonts: Fonts = field(default_factory=Fonts)
    arrival: Arrival = field(default_factory=Arrival)
    render: Render = field(default_factory=Render)


def _build(kind: type, data: dict[str, Any]) -> Any:
    names = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(set(data) - names):
        raise ValueError(f"unknown keys for {kind.__name__}: {', '.join(unknown)}")
    ranges = {f.name for f in dataclasses.fields(kind) if f.type == "Range"}
    return kind(**{k: Range.of(v) if k in ranges else v for k, v in data.items()})


def load(path: str | Path | None) -> StreamConfig:
    """A configuration from a YAML file; the defaults without one."""
    if path is None:
        return StreamConfig()
    import yaml

    return parse(yaml.safe_load(Path(path).read_text()) or {})


def parse(data: dict[str, Any]) -> StreamConfig:
    data = dict(data)
    if "fonts" in data:
        own = dict(data["fonts"])
        data["fonts"] = _build(Fonts, own | {"exclude": tuple(own.get("exclude", ()))})
    if "arrival" in data:
        own = dict(data["arrival"])
        data["arrival"] = _build(Arrival, own | {"fonts": {k: _build(Rule, v or {}) for k, v in (own.get("fonts") or {}).items()}})
    if "render" in data:
        parts = {"corpus": Corpus, "typography": Typography, "background": Background, "crop": Crop}
        data["render"] = _build(Render, {k: _build(parts[k], v or {}) if k in parts else v for k, v in (data["render"] or {}).items()})
    return _build(StreamConfig, data)
