"""White balance gains from a colour temperature; numbers of a raster, never of a pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelquilt.plans.raster import Raster

#: Daylight, the range of temperatures, and linear sRGB from XYZ under D65.
D65, COLDEST, HOTTEST = 6504.0, 2000.0, 25000.0
XYZ_TO_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
#: Cubic fits of the Planckian locus, x in 1/T and y in x, highest power first.
X_BELOW_4000, X_ABOVE = (-0.2661239e9, -0.2343589e6, 0.8776956e3, 0.179910), (-3.0258469e9, 2.1070379e6, 0.2226347e3, 0.240390)
Y_BELOW_2222, Y_BELOW_4000, Y_ABOVE = (-1.1063814, -1.34811020, 2.18555832, -0.20219683), (-0.9549476, -1.37418593, 2.09137015, -0.16748867), (3.0817580, -5.87338670, 3.75112997, -0.37001483)


def _poly(c: tuple, v: float) -> float:
    return ((c[0] * v + c[1]) * v + c[2]) * v + c[3]


def kelvin_gains(kelvin: float, tint: float) -> tuple[float, float, float]:
    """Gains that make light of this temperature grey, green being 1."""
    t = min(max(kelvin, 1667.0), HOTTEST)
    x = _poly(X_BELOW_4000 if t <= 4000 else X_ABOVE, 1 / t)
    y = _poly(Y_BELOW_2222 if t <= 2222 else Y_BELOW_4000 if t <= 4000 else Y_ABOVE, x)
    y = min(max(y - tint * 0.05, 0.05), 0.95)
    light = (x / y, 1.0, (1 - x - y) / y)
    r, g, b = (max(sum(m * v for m, v in zip(row, light)), 0.02) for row in XYZ_TO_SRGB)
    return g / r, 1.0, g / b


def relative_gains(r: Raster, kelvin: float, tint: float) -> list[float]:
    """Gains for a raster, of luma 1; relative to what its camera applied, where a daylight reference is known."""
    if kelvin > 1 and r.has_daylight_wb:
        asked, day = kelvin_gains(kelvin, tint), kelvin_gains(D65, 0.0)
        gains = [a / d for a, d in zip(asked, day)]
        for i in (0, 2):
            gains[i] /= max(r.cam_mul[i] / max(r.pre_mul[i], 1e-6), 1e-6)
    else:
        gains = [1 + 0.15 * tint, 1 - 0.3 * tint, 1 + 0.15 * tint]
    gains = [max(g, 0.0) for g in gains]
    size = 0.2126 * gains[0] + 0.7152 * gains[1] + 0.0722 * gains[2]
    return [g / max(size, 1e-6) for g in gains]


def as_shot(r: Raster) -> tuple[float, float]:
    """(kelvin, tint) that the camera's own gains stand for; zeros without a daylight reference."""
    if not r.has_daylight_wb:
        return 0.0, 0.0
    red, blue = (np.array([r.cam_mul[i] / max(r.pre_mul[i], 1e-6)]) for i in (0, 2))
    kelvin, tint = as_shot_of(red, blue)
    return float(kelvin[0]), float(tint[0])


def _gains_of(kelvin: np.ndarray, tint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue gains of ``kelvin_gains`` for many lights."""
    t = np.clip(kelvin, 1667.0, HOTTEST)
    x = np.where(t <= 4000, _poly(X_BELOW_4000, 1 / t), _poly(X_ABOVE, 1 / t))
    y = np.where(t <= 2222, _poly(Y_BELOW_2222, x), np.where(t <= 4000, _poly(Y_BELOW_4000, x), _poly(Y_ABOVE, x)))
    y = np.clip(y - tint * 0.05, 0.05, 0.95)
    light = x / y, np.ones_like(y), (1 - x - y) / y
    r, g, b = (np.maximum(row[0] * light[0] + row[1] * light[1] + row[2] * light[2], 0.02) for row in XYZ_TO_SRGB)
    return g / r, g / b


def as_shot_of(red: np.ndarray, blue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kelvin, tint) for many pairs of gains relative to daylight, by bisections in step: the
    temperature on red against blue, the tint on green, which is the mean of what both leave over."""
    day_red, _, day_blue = kelvin_gains(D65, 0.0)
    red, blue = np.maximum(red, 1e-6), np.maximum(blue, 1e-6)
    kelvin, tint = np.full(len(red), D65), np.zeros(len(red))
    for _ in range(8):
        low, high = np.full(len(red), COLDEST), np.full(len(red), HOTTEST)
        for _ in range(32):
            kelvin = (low + high) / 2
            r, b = _gains_of(kelvin, tint)
            up = r / day_red / np.maximum(b / day_blue, 1e-6) < red / blue
            low, high = np.where(up, kelvin, low), np.where(up, high, kelvin)
        kelvin = (low + high) / 2
        low, high = np.full(len(red), -1.0), np.ones(len(red))
        for _ in range(32):
            tint = (low + high) / 2
            r, b = _gains_of(kelvin, tint)
            up = 0.5 * (r / day_red / red + b / day_blue / blue) > 1
            low, high = np.where(up, tint, low), np.where(up, high, tint)
        tint = (low + high) / 2
    return kelvin, tint


def as_shot_table(descriptors: DataFrame) -> DataFrame:
    """(image_id, kelvin, tint) of each descriptor; zeros without a daylight reference.  A map over Arrow batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(3).fill_null(False).to_numpy(zero_copy_only=False)
            kelvin, tint = np.zeros(len(has)), np.zeros(len(has))
            if has.any():
                gain = lambda i, j: np.array([v[j] for v, h in zip(batch.column(i).to_pylist(), has) if h], dtype=float)
                red, blue = (gain(1, j) / np.maximum(gain(2, j), 1e-6) for j in (0, 2))
                kelvin[has], tint[has] = as_shot_of(red, blue)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kelvin), pa.array(tint)], ["image_id", "kelvin", "tint"])

    return descriptors.select("image_id", "cam_mul", "pre_mul", "has_daylight_wb").mapInArrow(work, "image_id long, kelvin double, tint double")
