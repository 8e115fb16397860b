"""Column expressions on pixel values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquilt.plans.raster import Raster

#: Luma weights of the two video standards.
LUMA_601, LUMA_709 = (0.299, 0.587, 0.114), (0.2126, 0.7152, 0.0722)
#: 2x2 tiles of the mosaic patterns, row by row; 0 red, 1 green, 2 blue.
TILES = {"RGGB": (0, 1, 1, 2), "BGGR": (2, 1, 1, 0), "GRBG": (1, 0, 2, 1), "GBRG": (1, 2, 0, 1)}


def luma(r: Raster, weights: tuple[float, float, float] = LUMA_601) -> Column:
    if r.fmt == "R32F":
        return F.col("c0")
    return sum((F.col(c) * w for c, w in zip(r.colours[1:], weights[1:])), F.col("c0") * weights[0])


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def whole(v: Column) -> Column:
    """Truncation to a byte; rounding to nine digits first keeps 3 * (1 / 3) at 1."""
    return F.floor(F.round(clamp(v, 0, 255), 9)).cast("double")


def half(v: Column) -> Column:
    """A half float with a truncated mantissa: tiny values become 0, large ones 65504."""
    size = F.abs(v)
    step = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 10)
    near = F.floor(size / step) * step
    kept = F.when(F.isnan(v) | (size >= 65504), F.lit(65504.0)).when(size < 2.0**-14, F.lit(0.0)).otherwise(near)
    return F.when(v < 0, -kept).otherwise(kept)


def pack(fmt: str, v: Column) -> Column:
    return whole(v) if fmt == "RGBA8" else half(v) if fmt == "RGBA16F" else v


def srgb_decode(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def srgb_encode(c: Column) -> Column:
    c = clamp(c, 0, 1)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def cfa_colour(cfa: str, x: Column, y: Column) -> Column:
    """0, 1 or 2 at a place of the mosaic; green where there is no known pattern."""
    if cfa not in TILES:
        return F.lit(1)
    tile = TILES[cfa]
    at = F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2))
    return F.when(at == 0, tile[0]).when(at == 1, tile[1]).when(at == 2, tile[2]).otherwise(tile[3])
