"""A batch of images as one DataFrame of pixels.

Columns: image_id, x, y, w, h (the image's size) and one channel c0, or four c0..c3.  Formats:
RGBA8 (whole numbers 0..255), R32F (one channel), RGBA16F and RGBA32F (floats).  What all images of
a batch share stands in the Raster itself: format, mosaic pattern, levels, colour data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

FORMATS = ("RGBA8", "R32F", "RGBA16F", "RGBA32F")
KEYS = ("image_id", "x", "y", "w", "h")


@dataclass(frozen=True)
class Raster:
    pixels: DataFrame
    fmt: str = "RGBA8"
    cfa: str = "None"
    black: float = 0.0
    white: float = 1.0
    cam_mul: tuple[float, float, float] = (1.0, 1.0, 1.0)
    pre_mul: tuple[float, float, float] = (1.0, 1.0, 1.0)
    has_daylight_wb: bool = False
    rgb_cam: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    linear: bool = False

    def __post_init__(self):
        if self.fmt not in FORMATS:
            raise ValueError(f"unknown format {self.fmt!r}")

    @property
    def channels(self) -> list[str]:
        return ["c0"] if self.fmt == "R32F" else ["c0", "c1", "c2", "c3"]

    @property
    def colours(self) -> list[str]:
        """The channels that filters work on: all but alpha."""
        return self.channels[:3]

    @property
    def scale(self) -> float:
        """What stands for full white."""
        return 255.0 if self.fmt == "RGBA8" else 1.0

    def with_pixels(self, pixels: DataFrame, fmt: str | None = None) -> Raster:
        """A mosaic whose format changes is no mosaic any more, and linear."""
        out = replace(self, pixels=pixels, fmt=fmt or self.fmt)
        if self.cfa != "None" and out.fmt != "R32F":
            out = replace(out, cfa="None", linear=True)
        return out
