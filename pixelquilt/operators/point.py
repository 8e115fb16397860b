"""Point operators: projections that Catalyst fuses into one stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelquilt.functions.pixels import LUMA_709, cfa_colour, clamp, pack, srgb_decode, srgb_encode
from pixelquilt.functions.white_balance import relative_gains
from pixelquilt.plans.raster import KEYS, Raster
from pixelquilt.plans.registry import Param, operator


@operator("grayscale", "color", *[Param(f"{c}_weight", d, 0, 1, 0.01, help=f"weight of {n}") for c, d, n in (("r", 0.299, "red"), ("g", 0.587, "green"), ("b", 0.114, "blue"))])
def grayscale(r: Raster, r_weight: float, g_weight: float, b_weight: float) -> Raster:
    """Of all formats; a single channel stays as it is."""
    if r.fmt == "R32F":
        return r
    total = max(1e-4, r_weight + g_weight + b_weight)
    g = pack(r.fmt, (F.col("c0") * r_weight + F.col("c1") * g_weight + F.col("c2") * b_weight) / total)
    return r.with_pixels(r.pixels.select(*KEYS, g.alias("c0"), g.alias("c1"), g.alias("c2"), "c3"))


@operator("brightness", "adjust", Param("brightness", 0, -1, 1, 0.01, help="added, 1 being full white"), Param("gain", 1, 0, 4, 0.05, help="factor"))
def brightness(r: Raster, brightness: float, gain: float) -> Raster:
    cols = [pack(r.fmt, F.col(c) * gain + brightness * r.scale).alias(c) for c in r.colours]
    return r.with_pixels(r.pixels.select(*KEYS, *cols, *r.channels[3:]))


def _luma(c: list[Column]) -> Column:
    return c[0] * LUMA_709[0] + c[1] * LUMA_709[1] + c[2] * LUMA_709[2]


def _smooth(x: Column, low: float, high: float) -> Column:
    t = clamp((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


_UNIT = [Param(n, 0, -1, 1, 0.01, help=f"strength of {n}") for n in ("contrast", "highlights", "shadows", "whites", "blacks", "vibrance", "saturation")]


@operator("basic_adjust", "adjust", Param("kelvin", 0, 0, 25000, 50, help="colour temperature of the light, 0 for as shot"), Param("tint", 0, -1, 1, 0.01, help="green against magenta"), Param("exposure", 0, -5, 5, 0.05, help="stops"), *_UNIT)
def basic_adjust(r: Raster, kelvin: float, tint: float, exposure: float, contrast: float, highlights: float, shadows: float, whites: float, blacks: float, vibrance: float, saturation: float) -> Raster:
    """Ten tonal steps in linear light, each left out where its parameter is about 0.

    Every step is a projection of its own, so that what it reads is computed once.
    """
    white = 0.70 if r.linear else 1.0
    names = ["_r", "_g", "_b"]
    source = r.colours if len(r.colours) == 3 else ["c0"] * 3
    gain = [g * 2.0**exposure for g in relative_gains(r, kelvin, tint)]
    px = r.pixels.withColumns({n: (F.col(c) / r.scale if r.linear else srgb_decode(F.col(c) / r.scale)) * g for n, c, g in zip(names, source, gain)})
    c = [F.col(n) for n in names]
    step = lambda px, values: px.withColumns(dict(zip(names, values)))
    px = px.withColumn("_l", _luma(c))
    lum, on = F.col("_l"), lambda p: abs(p) > 1e-4
    if on(highlights):
        px = px.withColumn("_a", -highlights * _smooth(lum, 0.35, white))
        a = F.col("_a")
        pulled = [(v - F.greatest(v - white, F.lit(0.0)) * a) * (1 - 0.35 * a) for v in c]
        px = step(px, [F.when(a > 0, p).otherwise(v * (1 - a)) for p, v in zip(pulled, c)])
    if on(shadows):
        px = step(px, [v * (1 + shadows * (1 - _smooth(lum, 0.0, 0.5))) for v in c])
    if on(whites):
        px = px.withColumn("_k", clamp(_luma(c), 0, 1))
        px = step(px, [v * (1 + whites * F.col("_k")) for v in c])
    if on(blacks):
        px = px.withColumn("_k", clamp(_luma(c), 0, 1))
        px = step(px, [F.greatest(v + 0.1 * blacks * (1 - F.col("_k")), F.lit(0.0)) for v in c])
    if on(contrast):
        px = step(px, [F.greatest((v - 0.18) * (1 + contrast) + 0.18, F.lit(0.0)) for v in c])
    px = px.withColumn("_l", _luma(c))
    if on(vibrance):
        top, low = F.greatest(*c), F.least(*c)
        px = px.withColumn("_k", F.when(top <= 1e-6, F.lit(0.0)).otherwise((top - low) / top))
        px = step(px, [lum + (v - lum) * (1 + vibrance * (1 - F.col("_k"))) for v in c])
    if on(saturation):
        px = step(px, [lum + (v - lum) * (1 + saturation) for v in c])
    out = [F.greatest(v, F.lit(0.0)) for v in c]
    if len(r.colours) == 1:
        out = [_luma(out)]
    out = [pack(r.fmt, (v if r.linear else srgb_encode(v)) * r.scale).alias(n) for v, n in zip(out, r.colours)]
    return r.with_pixels(px.select(*KEYS, *out, *r.channels[3:]))


@operator("demosaic_passthrough", "demosaic", Param("colour", 1, kind="bool", help="tint each place with its mosaic colour"))
def demosaic_passthrough(r: Raster, colour: float) -> Raster:
    s = clamp((F.col("c0") - r.black) / max(r.white - r.black, 1e-6), 0, 4)
    own = cfa_colour(r.cfa, F.col("x"), F.col("y"))
    tint = bool(colour) and r.cfa != "None"
    cols = [pack("RGBA16F", F.when(own == i, s).otherwise(0.0) if tint else s).alias(f"c{i}") for i in range(3)]
    return r.with_pixels(r.pixels.select(*KEYS, *cols, F.lit(1.0).alias("c3")), "RGBA16F")
