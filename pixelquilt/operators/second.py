"""Second plans of operators whose first ones are windows along rows and columns: NumPy over tiles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.functions.neighbours import tiled
from pixelquilt.functions.pixels import pack
from pixelquilt.operators import statistics
from pixelquilt.operators.threshold import gauss
from pixelquilt.plans import registry
from pixelquilt.plans.raster import KEYS, Raster
from pixelquilt.plans.registry import second_plan


def _separable(r: Raster, weights: list[float], channels: list[str]) -> DataFrame:
    """Weighted sums along rows, then along columns, of each tile with its surroundings."""
    k = len(weights) // 2

    def fn(a: np.ndarray, pad: tuple) -> np.ndarray:
        a = sum(g * a[..., i : a.shape[-1] - 2 * k + i] for i, g in enumerate(weights))
        return sum(g * a[..., i : a.shape[-2] - 2 * k + i, :] for i, g in enumerate(weights))

    return tiled(r.pixels, channels, k, fn)


@second_plan("box_blur")
def box_blur(r: Raster, radius: float) -> Raster:
    n = 2 * int(radius) + 1
    rows = _separable(r, [1.0] * n, r.channels)
    return r.with_pixels(rows.select(*KEYS, *[pack(r.fmt, F.col(c) / float(n * n)).alias(c) for c in r.channels]))


@second_plan("gaussian_blur")
def gaussian_blur(r: Raster, sigma: float) -> Raster:
    rows = _separable(r, gauss(sigma, min(max(math.ceil(3 * sigma), 1), 64)), r.channels)
    return r.with_pixels(rows.select(*KEYS, *[pack(r.fmt, F.col(c)).alias(c) for c in r.channels]))


@second_plan("kuwahara")
def kuwahara(r: Raster, radius: float) -> Raster:
    k, digits = int(radius), 6 if r.fmt == "RGBA8" else 12

    def fn(a: np.ndarray, pad: tuple) -> np.ndarray:
        l = a[0] if len(a) == 1 else 0.299 * a[0] + 0.587 * a[1] + 0.114 * a[2]
        h, w = a.shape[-2] - 2 * k, a.shape[-1] - 2 * k
        square = lambda v, x, y: sum(v[..., y + j : y + j + h, x + i : x + i + w] for j in range(k + 1) for i in range(k + 1)) / (k + 1) ** 2
        corners = [(0, 0), (k, 0), (0, k), (k, k)]
        calm = np.stack([np.round(np.maximum(0.0, square(l * l, *c) - square(l, *c) ** 2), digits) for c in corners])
        best = calm.argmin(0)
        return np.choose(best, [square(a, *c) for c in corners])

    rows = tiled(r.pixels, r.colours, k, fn)
    if len(r.channels) == 4:
        rows = rows.join(r.pixels.select("image_id", "x", "y", "c3"), ["image_id", "x", "y"])
    return r.with_pixels(rows.select(*KEYS, *[pack(r.fmt, F.col(c)).alias(c) for c in r.colours], *r.channels[3:]))


def compare_plans(r: Raster, *steps: tuple[str, dict] | str, at: int = -1, tolerance: float | None = None, amplify: float = 16.0) -> tuple[str, DataFrame, Raster]:
    """(operator, statistics, picture) of the two plans' difference at one step of a chain.

    The chain runs twice up to that step, all operators with a second plan by their first, then by
    their second one, so the step is compared in its context.  at: number of the step; below 0 the
    first that has a second plan.  tolerance: 1 for bytes and 0.001 for floats if not given.
    """
    named = [(s, {}) if isinstance(s, str) else s for s in steps]
    if not named:
        raise ValueError("no steps to compare")
    if at < 0:
        at = next((i for i, (n, _) in enumerate(named) if registry.has_second_plan(n)), -1)
        if at < 0:
            raise ValueError("no step of this chain has a second plan")
    if at >= len(named):
        raise ValueError("step out of range")
    name = named[at][0]
    registry.get_second(name)  # an error without one
    one, two = r, r
    for n, given in named[: at + 1]:
        one = registry.get(n)(one, **given)
        two = (registry.get_second(n) if registry.has_second_plan(n) else registry.get(n))(two, **given)
    if tolerance is None:
        tolerance = 1.0 if one.fmt == "RGBA8" else 1e-3
    return name, statistics.compare(one, two, tolerance), statistics.diff_image(one, two, amplify)
