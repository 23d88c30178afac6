"""Settings of a conversion, from defaults and a JSON file; unknown names and values out of range are refused."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    # Names and defaults of the settings.
    colors: int = 10
    min_area: int = 18
    max_raster: int = 64
    raster_fallback: bool = True
    fidelity_fallback: bool = False
    ocr: bool = True
    language: str = "eng"
    font_family: str = "auto"
    smooth_icons: bool = False
    pixel_boundary_icons: bool = False
    estimate_alpha: bool = False
    icon_palette_size: int | None = None
    icon_blur: float = 0.5
    icon_cache_dir: str | None = None

    def __post_init__(self) -> None:
        size = self.icon_palette_size
        rules = (
            (2 <= self.colors <= 32, "colors must be 2 to 32"),
            (self.min_area >= 1, "min_area must be positive"),
            (self.max_raster >= 0, "max_raster must not be negative"),
            (0 < len(self.font_family) <= 100, "font_family must be a name"),
            (size is None or (type(size) is int and 2 <= size <= 32), "icon_palette_size must be 2 to 32"),
            (math.isfinite(self.icon_blur) and 0 <= self.icon_blur <= 4, "icon_blur must be 0 to 4"),
            (not (self.smooth_icons and self.pixel_boundary_icons), "smooth_icons and pixel_boundary_icons exclude each other"),
        )
        for good, why in rules:
            if not good:
                raise ValueError(why)


def read_options(path: str | None) -> Options:
    if not path:
        return Options()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := sorted(set(given) - {x.name for x in fields(Options)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Options(**given)
