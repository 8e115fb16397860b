"""Thresholds: a mask of 0 and 1 from the luma against a level, a histogram's or a neighbourhood's."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquilt.functions.neighbours import extremes, moments, tap
from pixelquilt.functions.pixels import luma
from pixelquilt.operators import statistics
from pixelquilt.plans.raster import KEYS, Raster
from pixelquilt.plans.registry import Param, operator

INVERT = Param("invert", 0, kind="bool", help="swap 0 and 1")
WINDOW = Param("window", 15, 3, 201, 2, "int", "side of the square around a pixel")


def _mask(r: Raster, rows, t: Column, invert: float, value: Column | None = None) -> Raster:
    above = (luma(r) if value is None else value) > t
    mask = (~above if invert else above).cast("double")
    return r.with_pixels(rows.select(*KEYS, mask.alias("c0")), "R32F")


def _radius(window: float) -> int:
    return max(1, (max(3, int(window)) - 1) // 2)


@operator("threshold", "threshold", Param("level", 128, 0, 255, 1, help="level in source units"), INVERT)
def threshold(r: Raster, level: float, invert: float) -> Raster:
    return _mask(r, r.pixels, F.lit(float(level)), invert)


def _by_histogram(name: str, find) -> None:
    @operator(name, "threshold", INVERT)
    def build(r: Raster, invert: float) -> Raster:
        levels = find(statistics.binned(r))
        return _mask(r, r.pixels.join(levels, "image_id"), F.col("t"), invert)


_by_histogram("threshold_otsu", statistics.otsu)
_by_histogram("threshold_triangle", statistics.triangle)
_by_histogram("threshold_isodata", statistics.isodata)


def _by_moments(r: Raster, window: float, t: Column, invert: float) -> Raster:
    """Against the mean and sd of the luma in the window, which shrinks at borders."""
    rows = moments(r.pixels.select(*KEYS, luma(r).alias("l")), "l", _radius(window))
    return _mask(r, rows, t, invert, F.col("l"))


@operator("threshold_niblack", "threshold", WINDOW, INVERT, Param("k", -0.2, -1, 1, 0.01, help="weight of the deviation"))
def niblack(r: Raster, window: float, invert: float, k: float) -> Raster:
    return _by_moments(r, window, F.col("mean") + k * F.col("sd"), invert)


@operator("threshold_sauvola", "threshold", WINDOW, INVERT, Param("k", 0.2, 0, 1, 0.01, help="weight of the deviation"), Param("r", 128, 1, 255, 1, help="deviation of full contrast"))
def sauvola(r_: Raster, window: float, invert: float, k: float, r: float) -> Raster:
    t = F.col("mean") * (1 + k * (F.col("sd") / max(r, 1e-6) - 1))
    return _by_moments(r_, window, t, invert)


@operator("threshold_adaptive_mean", "threshold", WINDOW, INVERT, Param("c", 5, -64, 64, 1, help="what the level lies below the mean"))
def adaptive_mean(r: Raster, window: float, invert: float, c: float) -> Raster:
    return _by_moments(r, window, F.col("mean") - c, invert)


@operator("threshold_bernsen", "threshold", WINDOW, INVERT, Param("contrast_min", 15, 0, 128, 1, help="contrast below which a window is uniform"), Param("uniform_level", 128, 0, 255, 1, help="level for uniform windows"))
def bernsen(r: Raster, window: float, invert: float, contrast_min: float, uniform_level: float) -> Raster:
    rows = extremes(r.pixels.select(*KEYS, luma(r).alias("l")), "l", _radius(window))
    mid = (F.col("lo") + F.col("hi")) / 2
    t = F.when(F.col("hi") - F.col("lo") < contrast_min, F.when(mid >= uniform_level, -1e30).otherwise(1e30)).otherwise(mid)
    return _mask(r, rows, t, invert, F.col("l"))


def gauss(sigma: float, radius: int) -> list[float]:
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


@operator("threshold_adaptive_gaussian", "threshold", WINDOW, INVERT, Param("sigma", 3, 0.1, 32, 0.1, help="width of the bell"), Param("c", 5, -64, 64, 1, help="what the level lies below the mean"))
def adaptive_gaussian(r: Raster, window: float, invert: float, sigma: float, c: float) -> Raster:
    k = _radius(window)
    weights = gauss(sigma, k)
    rows = r.pixels.withColumn("m", luma(r))
    for axis in ("x", "y"):
        rows = rows.withColumn("m", sum((tap("m", axis, i - k) * g for i, g in enumerate(weights)), F.lit(0.0)))
    return _mask(r, rows, F.col("m") - c, invert)
