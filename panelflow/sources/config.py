"""Settings: bounded values, paths relative to their file, the key from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


def bounded(default, least, most):
    return field(default=default, metadata={"least": least, "most": most})


def one_of(*choices):
    return field(default=choices[0], metadata={"choices": choices})


# Defaults and bounds of every section.


@dataclass(frozen=True)
class Detecting:
    input_size: int = bounded(1024, 320, 3072)
    additional_input_sizes: tuple = field(default=(), metadata={"each": (320, 3072)})
    nms: float = bounded(0.35, 0.05, 0.95)
    confidence: float = bounded(0.30, 0.01, 0.99)
    raw_support_threshold: int = bounded(30, 1, 254)
    raw_support_dilate: int = bounded(2, 0, 32)
    fallback_enabled: bool = False
    fallback_min_area: int = bounded(48, 1, 1_000_000)
    fallback_max_area_ratio: float = bounded(0.20, 0.0, 1.0)
    fallback_padding: int = bounded(4, 0, 128)
    fallback_min_density: float = bounded(0.012, 0.0, 1.0)
    fallback_min_components: int = bounded(2, 1, 100)


@dataclass(frozen=True)
class Grouping:
    enabled: bool = True
    dedup: bool = True
    translate_groups: bool = True
    min_region_area: int = bounded(36, 1, 1_000_000)
    drop_thin_ratio: float = bounded(0.015, 0.0, 1.0)


@dataclass(frozen=True)
class Reading:
    min_quality: float = bounded(0.46, 0.0, 1.0)
    short_min_quality: float = bounded(0.66, 0.0, 1.0)
    fallback_min_quality: float = bounded(0.74, 0.0, 1.0)
    fallback_min_agreement: float = bounded(0.70, 0.0, 1.0)
    crop_padding_ratio: float = bounded(0.08, 0.0, 0.5)
    crop_padding_min: int = bounded(4, 0, 128)
    views: str = one_of("adaptive", "always", "off")
    noise_filter: bool = True
    reject_symbols: bool = True


@dataclass(frozen=True)
class Translating:
    api_key: str = ""
    model: str = ""
    batch_size: int = bounded(20, 1, 200)
    temperature: float = bounded(0.2, 0.0, 2.0)
    retry_temperature: float = bounded(0.0, 0.0, 2.0)
    context: int = bounded(5, 0, 20)
    page_context: str = one_of("page", "window")
    timeout: float = bounded(90.0, 10.0, 600.0)
    content_retries: int = bounded(2, 0, 5)
    validate: bool = True
    max_length_ratio: float = bounded(4.0, 1.5, 20.0)
    glossary_path: str = ""


@dataclass(frozen=True)
class Layout:
    direction: str = one_of("auto", "vertical", "horizontal")
    scope: str = one_of("group_mask", "region", "group_bbox")
    mode: str = one_of("preserve", "tight", "group")
    font_min: int = bounded(10, 4, 300)
    font_max: int = bounded(180, 4, 500)
    growth: float = bounded(1.15, 0.5, 4.0)
    shrink: float = bounded(0.85, 0.3, 1.5)
    keep: float = bounded(0.92, 0.5, 1.5)

    def __post_init__(self) -> None:
        if self.font_max < self.font_min or self.keep < self.shrink:
            raise ValueError("font_max must not lie below font_min, nor keep below shrink")


@dataclass(frozen=True)
class Erasing:
    method: str = one_of("hybrid", "white", "telea", "navier_stokes")
    mask_dilate: int = bounded(1, 0, 128)
    ring: int = bounded(5, 1, 64)
    flat_spread: float = bounded(18.0, 0.0, 128.0)
    dominant_tolerance: int = bounded(18, 1, 128)
    dominant_ratio: float = bounded(0.78, 0.0, 1.0)
    min_ring_pixels: int = bounded(24, 1, 1_000_000)
    only_translated: bool = True


SECTIONS = {"detecting": Detecting, "grouping": Grouping, "reading": Reading, "translating": Translating, "layout": Layout, "erasing": Erasing}


@dataclass(frozen=True)
class Settings:
    detecting: Detecting = Detecting()
    grouping: Grouping = Grouping()
    reading: Reading = Reading()
    translating: Translating = Translating()
    layout: Layout = Layout()
    erasing: Erasing = Erasing()
    input_dir: str = "input"
    output_dir: str = "output"

    @classmethod
    def load(cls, path: str, text: str | None = None) -> Settings:
        """Reads YAML where PyYAML is there, else JSON; unknown names and values out of bounds raise."""
        source = Path(path).read_text(encoding="utf-8") if text is None else text
        try:
            import yaml

            raw = yaml.safe_load(source) or {}
        except ImportError:
            import json

            raw = json.loads(source or "{}")
        made = {k: build(SECTIONS[k], v or {}) if k in SECTIONS else v for k, v in raw.items()}
        here = Path(path).resolve().parent
        out = cls(**made)
        return cls(**{f.name: getattr(out, f.name) for f in fields(cls)} | {k: str((here / getattr(out, k)).resolve()) for k in ("input_dir", "output_dir")})

    def key(self) -> str:
        given = self.translating.api_key.strip()
        return given if given and given.lower() not in ("your-api-key", "changeme") else os.environ.get("PANELFLOW_API_KEY", "")

    def overridden(self, no_grouping: bool = False, page_context: str | None = None, scope: str | None = None) -> Settings:
        """Settings changed for one run; without grouping nothing that rests on groups is done either."""
        out = self
        if no_grouping:
            out = replace(out, grouping=replace(out.grouping, enabled=False, dedup=False, translate_groups=False))
        if page_context:
            out = replace(out, translating=checked(replace(out.translating, page_context=page_context)))
        return replace(out, layout=checked(replace(out.layout, scope=scope))) if scope else out


def checked(made):
    """The section, or an error for the first value out of its bounds."""
    for f in fields(made):
        v, rule = getattr(made, f.name), f.metadata
        if "least" in rule and not rule["least"] <= v <= rule["most"]:
            raise ValueError(f"{f.name} = {v} is not between {rule['least']} and {rule['most']}")
        if "choices" in rule and v not in rule["choices"]:
            raise ValueError(f"{f.name} = {v} is none of {', '.join(rule['choices'])}")
        if "each" in rule and not all(rule["each"][0] <= x <= rule["each"][1] for x in v):
            raise ValueError(f"{f.name} = {v} has a value that is not between {rule['each'][0]} and {rule['each'][1]}")
    return made


def build(kind, values: dict):
    # a list keeps the first of equal values
    return checked(kind(**{k: tuple(dict.fromkeys(v)) if isinstance(v, list) else v for k, v in values.items()}))
