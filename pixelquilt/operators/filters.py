"""Filters.  Separable ones are windows along rows and columns; the others run over tiles in NumPy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pixelquilt.functions.neighbours import box_sums, line_sum, tap, tiled
from pixelquilt.functions.pixels import LUMA_601, luma, pack
from pixelquilt.operators.threshold import gauss
from pixelquilt.plans.raster import KEYS, Raster
from pixelquilt.plans.registry import Param, operator

RADIUS = "pixels on each side"


def _packed(r: Raster, rows, own: list[str]) -> Raster:
    return r.with_pixels(rows.select(*KEYS, *[pack(r.fmt, F.col(c)).alias(c) if c in own else c for c in r.channels]))


@operator("box_blur", "filter", Param("radius", 3, 1, 64, 1, "int", RADIUS))
def box_blur(r: Raster, radius: float) -> Raster:
    """Alpha too."""
    k = int(radius)
    rows = box_sums(r.pixels, r.channels, (-k, k), (-k, k))
    return _packed(r, rows.withColumns({c: F.col(c) / float((2 * k + 1) ** 2) for c in r.channels}), r.channels)


@operator("gaussian_blur", "filter", Param("sigma", 2, 0.1, 20, 0.1, help="width of the bell"))
def gaussian_blur(r: Raster, sigma: float) -> Raster:
    """Alpha too."""
    k = min(max(math.ceil(3 * sigma), 1), 64)
    rows = r.pixels
    for axis in ("x", "y"):
        rows = rows.withColumns({c: sum((tap(c, axis, i - k) * g for i, g in enumerate(gauss(sigma, k))), F.lit(0.0)) for c in r.channels})
    return _packed(r, rows, r.channels)


@operator("guided_filter", "filter", Param("radius", 4, 1, 64, 1, "int", RADIUS), Param("eps", 0.1, 0.001, 1, 0.005, help="contrast that is smoothed, 1 being full white"))
def guided_filter(r: Raster, radius: float, eps: float) -> Raster:
    k, e, n = int(radius), (eps * r.scale) ** 2, float((2 * int(radius) + 1) ** 2)
    names = r.colours
    rows = r.pixels.withColumns({f"m{c}": F.col(c) for c in names} | {f"q{c}": F.col(c) * F.col(c) for c in names})
    rows = box_sums(rows, [f"m{c}" for c in names] + [f"q{c}" for c in names], (-k, k), (-k, k))
    var = {c: F.greatest(F.lit(0.0), F.col(f"q{c}") / n - (F.col(f"m{c}") / n) * (F.col(f"m{c}") / n)) for c in names}
    rows = rows.withColumns({f"a{c}": var[c] / (var[c] + e) for c in names})
    rows = rows.withColumns({f"b{c}": (1 - F.col(f"a{c}")) * F.col(f"m{c}") / n for c in names})
    rows = box_sums(rows, [f"a{c}" for c in names] + [f"b{c}" for c in names], (-k, k), (-k, k))
    return _packed(r, rows.withColumns({c: F.col(f"a{c}") / n * F.col(c) + F.col(f"b{c}") / n for c in names}), names)


@operator("kuwahara", "filter", Param("radius", 3, 1, 32, 1, "int", RADIUS))
def kuwahara(r: Raster, radius: float) -> Raster:
    """The mean of the calmest of four squares that meet in the pixel, the first of equal ones."""
    k, n = int(radius), float((int(radius) + 1) ** 2)
    rows = r.pixels.withColumns({"l": luma(r), "q": luma(r) * luma(r)})
    names = [*r.colours, "l", "q"]
    spans = {"a": (-k, 0), "b": (0, k)}
    rows = rows.withColumns({f"{c}_{s}": line_sum(c, "x", *spans[s]) for c in names for s in spans})
    corners = [("a", "a"), ("b", "a"), ("a", "b"), ("b", "b")]
    rows = rows.withColumns({f"{c}_{i}": line_sum(f"{c}_{x}", "y", *spans[y]) for c in names for i, (x, y) in enumerate(corners)})
    #: Rounded far below what matters at the format's scale, as the variances of equal squares may differ in their last digits.
    digits = 6 if r.fmt == "RGBA8" else 12
    calm = [F.struct(F.round(F.greatest(F.lit(0.0), F.col(f"q_{i}") / n - (F.col(f"l_{i}") / n) * (F.col(f"l_{i}") / n)), digits).alias("v"), F.lit(i).alias("i"), *[(F.col(f"{c}_{i}") / n).alias(c) for c in r.colours]) for i in range(4)]
    rows = rows.withColumn("best", F.least(*calm))
    return _packed(r, rows.withColumns({c: F.col(f"best.{c}") for c in r.colours}), r.colours)


def _shift(a: np.ndarray, pad: int, dx: int, dy: int) -> np.ndarray:
    """The part without the padding, taken dx and dy further on."""
    h, w = a.shape[-2:]
    return a[..., pad + dy : h - pad + dy, pad + dx : w - pad + dx]


def _offsets(k: int):
    return [(dx, dy) for dy in range(-k, k + 1) for dx in range(-k, k + 1)]


def _luma(a: np.ndarray) -> np.ndarray:
    return a[0] if len(a) == 1 else LUMA_601[0] * a[0] + LUMA_601[1] * a[1] + LUMA_601[2] * a[2]


def _over_tiles(r: Raster, radius: int, fn) -> Raster:
    """fn(block) or, for steps that must keep the edge values at the edge, fn(block, padding)."""
    with_pad = fn.__code__.co_argcount == 2
    rows = tiled(r.pixels, r.colours, radius, fn if with_pad else lambda a, pad: fn(a))
    if len(r.channels) == 4:
        rows = rows.join(r.pixels.select("image_id", "x", "y", "c3"), ["image_id", "x", "y"])
    return _packed(r, rows, r.colours)


@operator("median_blur", "filter", Param("radius", 2, 1, 32, 1, "int", RADIUS))
def median_blur(r: Raster, radius: float) -> Raster:
    k = int(radius)
    return _over_tiles(r, k, lambda a: np.median(np.stack([_shift(a, k, *d) for d in _offsets(k)]), axis=0))


@operator("bilateral", "filter", Param("sigma_space", 3, 0.1, 32, 0.1, help="width of the bell in space"), Param("sigma_range", 0.1, 0.001, 1, 0.005, help="width in colour, 1 being full white"))
def bilateral(r: Raster, sigma_space: float, sigma_range: float) -> Raster:
    k, sr = min(max(math.ceil(2 * sigma_space), 1), 32), sigma_range * r.scale

    def fn(a: np.ndarray) -> np.ndarray:
        mid = _shift(a, k, 0, 0)
        total, weights = np.zeros_like(mid), np.zeros(mid.shape[1:])
        for dx, dy in _offsets(k):
            other = _shift(a, k, dx, dy)
            w = np.exp(-(dx * dx + dy * dy) / (2 * sigma_space**2)) * np.exp(-((other - mid) ** 2).sum(0) / (2 * sr * sr))
            total += w * other
            weights += w
        return total / np.maximum(weights, 1e-8)

    return _over_tiles(r, k, fn)


@operator("symmetric_nearest", "filter", Param("radius", 3, 1, 32, 1, "int", RADIUS))
def symmetric_nearest(r: Raster, radius: float) -> Raster:
    """The mean of the pixel and of that one of each pair of opposite neighbours that is closer in luma."""
    k = int(radius)

    def fn(a: np.ndarray) -> np.ndarray:
        l, mid = _luma(a), _shift(_luma(a), k, 0, 0)
        total, n = _shift(a, k, 0, 0).copy(), 1
        for dx, dy in _offsets(k):
            if dy < 0 or dy == 0 and dx < 0:
                first = np.abs(_shift(l, k, dx, dy) - mid) <= np.abs(_shift(l, k, -dx, -dy) - mid)
                total += np.where(first, _shift(a, k, dx, dy), _shift(a, k, -dx, -dy))
                n += 1
        return total / n

    return _over_tiles(r, k, fn)


@operator("nonlocal_means", "filter", Param("patch", 1, 1, 7, 1, "int", "radius of what is compared"), Param("search", 3, 1, 21, 1, "int", "radius of what is averaged"), Param("strength", 0.1, 0.001, 1, 0.005, help="difference that still counts as alike, 1 being full white"))
def nonlocal_means(r: Raster, patch: float, search: float, strength: float) -> Raster:
    p, s, h2 = int(patch), int(search), (strength * r.scale) ** 2
    pad = p + s

    def fn(a: np.ndarray) -> np.ndarray:
        mid = _shift(a, pad, 0, 0)
        total, weights = np.zeros_like(mid), np.zeros(mid.shape[1:])
        for sx, sy in _offsets(s):
            other = _shift(a, pad, sx, sy)
            near = ((mid - other) ** 2).mean(0) <= 9 * h2
            dist = sum(((_shift(a, pad, px, py) - _shift(a, pad, sx + px, sy + py)) ** 2).mean(0) for px, py in _offsets(p)) / (2 * p + 1) ** 2
            w = np.where(near, np.exp(-dist / h2), 0.0)
            total += w * other
            weights += w
        return total / np.maximum(weights, 1e-8)

    return _over_tiles(r, pad, fn)


def sector_weights(radius: int, sectors: int) -> np.ndarray:
    """(sector, dy, dx): wedges of the disc with soft borders, the sectors of each place adding up to 1."""
    arc = 2 * math.pi / sectors
    out = np.zeros((sectors, 2 * radius + 1, 2 * radius + 1))
    for dx, dy in _offsets(radius):
        d2 = dx * dx + dy * dy
        if d2 > radius * radius:
            continue
        for s in range(sectors):
            if d2 == 0:
                out[s, radius, radius] = 1.0 / sectors
                continue
            turn = math.atan2(dy, dx) - s * arc
            turn = abs((turn + math.pi) % (2 * math.pi) - math.pi)
            out[s, dy + radius, dx + radius] = math.exp(-turn * turn / (2 * (arc / 2) ** 2)) * math.exp(-d2 / (2 * (radius / 2) ** 2))
    total = out.sum(0)
    return np.where(total > 0, out / np.where(total > 0, total, 1), 0)


@operator("kuwahara_generalized", "filter", Param("radius", 4, 1, 32, 1, "int", RADIUS), Param("sectors", 8, 3, 16, 1, "int", "wedges of the disc"), Param("sharpness", 8, 0.1, 32, 0.5, help="how strongly calm wedges are preferred"))
def kuwahara_generalized(r: Raster, radius: float, sectors: float, sharpness: float) -> Raster:
    k, weights, scale = int(radius), sector_weights(int(radius), int(sectors)), r.scale

    def fn(a: np.ndarray) -> np.ndarray:
        l = _luma(a)
        total, norm = 0.0, 0.0
        for w in weights:
            size = w.sum()
            if size <= 1e-8:
                continue
            use = [(dx, dy, w[dy + k, dx + k]) for dx, dy in _offsets(k) if w[dy + k, dx + k] > 0]
            mean = sum(_shift(a, k, dx, dy) * g for dx, dy, g in use) / size
            square = sum(_shift(l, k, dx, dy) ** 2 * g for dx, dy, g in use) / size
            var = np.maximum(0.0, square - _luma(mean) ** 2) / scale**2
            v = 1 / (1 + var ** (sharpness * 0.5))
            total, norm = total + mean * v, norm + v
        return total / np.maximum(norm, 1e-8)

    return _over_tiles(r, k, fn)


@operator("anisotropic_diffusion", "filter", Param("iterations", 10, 1, 200, 1, "int", "steps"), Param("lambda_", 0.2, 0.01, 0.25, 0.01, help="share that flows in one step"), Param("k", 0.05, 0.001, 1, 0.005, help="difference that stops the flow, 1 being full white"), Param("exponential", 1, kind="bool", help="the stopping function is a bell"))
def anisotropic_diffusion(r: Raster, iterations: float, lambda_: float, k: float, exponential: float) -> Raster:
    """A tile takes as many pixels around it along as there are steps, so its own ones come out exact."""
    n, lam, kk = int(iterations), min(lambda_, 0.25), (k * r.scale) ** 2

    def fn(a: np.ndarray, pad: tuple) -> np.ndarray:
        inside = tuple(slice(p, size - q) for (p, q), size in zip(pad, a.shape))
        for _ in range(n):
            b = np.pad(a, ((0, 0), (0, 0), (1, 1), (1, 1)), mode="edge")
            flow = 0.0
            for dx, dy in ((0, -1), (0, 1), (1, 0), (-1, 0)):
                d = _shift(b, 1, dx, dy) - a
                flow = flow + d * (np.exp(-d * d / kk) if exponential else 1 / (1 + d * d / kk))
            a = np.pad((a + lam * flow)[inside], pad, mode="edge")
        return _shift(a, n, 0, 0)

    return _over_tiles(r, n, fn)
