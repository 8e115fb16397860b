"""What a viewer shows: normalised pixels, thumbnails, and the values around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.functions.pixels import clamp
from pixelquilt.operators.statistics import image_stats
from pixelquilt.plans.raster import KEYS, Raster


def display(r: Raster, fixed_range: bool = False) -> Raster:
    """RGBA8 for the screen: single channels from their image's least to most value (or 0..1), floats from 0..1."""
    px = r.pixels
    if r.fmt == "RGBA8":
        return r
    if r.fmt == "R32F":
        if fixed_range:
            v = F.floor(clamp(F.col("c0"), 0, 1) * 255)
        else:
            span = px.groupBy("image_id").agg(F.min("c0").alias("lo"), F.max("c0").alias("hi"))
            px = px.join(span.withColumn("range", F.expr("if(hi - lo <= 1e-8, 1, hi - lo)")), "image_id")
            v = F.floor(F.round((F.col("c0") - F.col("lo")) / F.col("range") * 255, 9))
        v = v.cast("double")
        return Raster(px.select(*KEYS, v.alias("c0"), v.alias("c1"), v.alias("c2"), F.lit(255.0).alias("c3")), "RGBA8")
    more = 0.5 if r.fmt == "RGBA16F" else 0.0
    return Raster(px.select(*KEYS, *[F.floor(clamp(F.col(c), 0, 1) * 255 + more).cast("double").alias(c) for c in r.channels]), "RGBA8")


def thumbnail(r: Raster, side: int = 64) -> DataFrame:
    """(image_id, x, y, c0..c3): RGBA8 means of whole blocks, in whole numbers; partial last blocks are left
    out, but for one along an axis that has no whole one.

    Floats go from 0..1, a single channel from the sensor's black to its white.
    """
    byte = lambda v: F.floor(clamp(v, 0, 1) * 255)
    px = r.pixels
    if r.fmt == "R32F":
        v = byte((F.col("c0") - r.black) / max(r.white - r.black, 1e-6))
        px = px.select(*KEYS, v.alias("c0"), v.alias("c1"), v.alias("c2"), F.lit(255).alias("c3"))
    elif r.fmt != "RGBA8":
        px = px.withColumns({c: byte(F.col(c)) for c in r.channels})
    px = px.withColumn("step", F.greatest(F.lit(1), F.ceil(F.greatest("w", "h") / side)).cast("int")).where("x div step < greatest(1, w div step) and y div step < greatest(1, h div step)")
    keys = ["image_id", F.expr("cast(x div step as int)").alias("x"), F.expr("cast(y div step as int)").alias("y")]
    return px.groupBy(*keys).agg(*[F.expr(f"sum(cast({c} as bigint)) div count(1)").alias(c) for c in ("c0", "c1", "c2", "c3")])


def region(r: Raster, x: int, y: int, size: int = 15) -> Raster:
    """The square of pixels around a place, moved to lie inside the image; a filter that reaches the scan."""
    low = lambda at, n: F.greatest(F.lit(0), F.least(F.lit(at - size // 2), F.col(n) - size))
    near = (F.col("x") >= low(x, "w")) & (F.col("x") < low(x, "w") + size) & (F.col("y") >= low(y, "h")) & (F.col("y") < low(y, "h") + size)
    return r.with_pixels(r.pixels.where(near))


#: Bytes a pixel.
_BYTES = {"RGBA8": 4, "R32F": 4, "RGBA16F": 8, "RGBA32F": 16}


def info(r: Raster) -> DataFrame:
    """What a viewer says about each image, as text: size, storage, statistics of the luma, and where
    they matter (more than 1 % of the pixels, floats beyond white) clipped shares and headroom, else null."""
    sizes = r.pixels.groupBy("image_id").agg(F.first("w").cast("long").alias("w"), F.first("h").cast("long").alias("h"))
    d = image_stats(r).join(sizes, "image_id")
    digits = 1 if r.fmt == "RGBA8" else 3
    #: Half to even, and with the sign of what rounds to zero.
    text = lambda c, n=digits: F.concat(F.when((c < 0) & (F.bround(c, n) == 0), "-").otherwise(""), F.format_string(f"%.{n}f", F.bround(c, n)))
    area = F.col("w") * F.col("h")
    said = {
        "size": F.concat(F.col("w"), F.lit(" x "), F.col("h"), F.lit("  ("), text(area / 1e6, 1), F.lit(" MP)")),
        "storage": F.concat(F.lit(f"{r.fmt}   "), text(area * _BYTES[r.fmt] / 1e6, 1), F.lit(" MB")),
        "stats": F.concat(F.lit("mean "), text(F.col("mean")), F.lit("   median "), text(F.col("median")), F.lit("   stddev "), text(F.col("sd"))),
        "clipped": F.when((F.col("clip_low") > 0.01) | (F.col("clip_high") > 0.01), F.concat(F.lit("clipped: "), text(F.col("clip_low") * 100, 1), F.lit("% black, "), text(F.col("clip_high") * 100, 1), F.lit("% white"))),
        "headroom": F.when(F.col("headroom"), F.concat(F.lit("headroom to "), text(F.col("max_value"), 2), F.lit(" ("), text(F.log2(F.col("max_value")), 1), F.lit(" stops above white)"))),
    }
    return d.select("image_id", *[e.alias(n) for n, e in said.items()])
