"""Edges: Sobel gradients, thinning, hysteresis and the chain of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelquilt.functions.neighbours import tap
from pixelquilt.functions.pixels import luma
from pixelquilt.plans.components import connected
from pixelquilt.plans.raster import KEYS, Raster
from pixelquilt.plans.registry import Param, get, operator
from pixelquilt.plans.scratch import materialize

LOW = Param("low", 0.1, 0, 4, 0.01, help="least strength of an edge pixel that touches a strong one")
HIGH = Param("high", 0.3, 0, 4, 0.01, help="strength of a strong edge pixel")


def gradients(r: Raster, scale: float = 1.0):
    """Rows with gx, gy, mag: 3 x 3, the luma going to 1 for full white."""
    rows = r.pixels.withColumn("l", luma(r) if r.fmt == "R32F" else luma(r) / 255.0)
    rows = rows.withColumns({"dx": tap("l", "x", 1) - tap("l", "x", -1), "sx": tap("l", "x", -1) + 2 * F.col("l") + tap("l", "x", 1)})
    rows = rows.withColumns({"gx": tap("dx", "y", -1) + 2 * F.col("dx") + tap("dx", "y", 1), "gy": tap("sx", "y", 1) - tap("sx", "y", -1)})
    mag = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) * scale
    return rows.withColumn("mag", mag).withColumns({"gx": F.col("gx") * scale, "gy": F.col("gy") * scale})


@operator("sobel", "edge", Param("scale", 1, 0, 8, 0.05, help="factor of all three results"))
def sobel(r: Raster, scale: float) -> tuple[Raster, Raster, Raster]:
    rows = gradients(r, scale)
    return tuple(r.with_pixels(rows.select(*KEYS, F.col(c).alias("c0")), "R32F") for c in ("gx", "gy", "mag"))


def _thin(rows):
    """c0 is mag where it is no smaller than both neighbours along the gradient, else 0."""
    for k, name in ((-1, "left"), (1, "right")):
        rows = rows.withColumn(name, tap("mag", "x", k))
    taps = {f"{side}_{name}": tap(c, "y", k) for k, side in ((-1, "up"), (1, "down")) for name, c in (("left", "left"), ("mid", "mag"), ("right", "right"))}
    rows = rows.withColumns(taps)
    c, x, y = F.col, F.abs(F.col("gx")), F.abs(F.col("gy"))
    same = (c("gx") >= 0) == (c("gy") >= 0)
    one = F.when(x > 2.414 * y, c("left")).when(y > 2.414 * x, c("up_mid")).when(same, c("up_left")).otherwise(c("up_right"))
    two = F.when(x > 2.414 * y, c("right")).when(y > 2.414 * x, c("down_mid")).when(same, c("down_right")).otherwise(c("down_left"))
    return rows.select(*KEYS, F.when((c("mag") >= one) & (c("mag") >= two), c("mag")).otherwise(F.lit(0.0)).alias("c0"))


@operator("non_max_suppression", "edge stage", inputs=3)
def non_max_suppression(gx: Raster, gy: Raster, mag: Raster) -> Raster:
    at = ["image_id", "x", "y"]
    rows = mag.pixels.withColumnRenamed("c0", "mag").join(gx.pixels.select(*at, F.col("c0").alias("gx")), at).join(gy.pixels.select(*at, F.col("c0").alias("gy")), at)
    return mag.with_pixels(_thin(rows))


@operator("hysteresis", "edge stage", LOW, HIGH)
def hysteresis(r: Raster, low: float, high: float) -> Raster:
    """1 for strong pixels and for weak ones that 8-neighbours connect with them.

    Weak pixels are labelled by connected component, in rounds that grow with the logarithm of a
    path's length; components with a strong pixel stay.
    """
    low, high = min(low, high), max(low, high)
    at = ["image_id", "x", "y"]
    place = lambda dx, dy: F.struct("image_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
    weak = materialize(r.pixels.where(F.col("c0") >= low).select(*at, (F.col("c0") >= high).alias("strong")), "weak")
    near = weak.select(place(0, 0).alias("a"), F.explode(F.array(*[place(dx, dy) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])).alias("b"))
    labels = connected(near.join(weak.select(place(0, 0).alias("b")), "b", "left_semi").select("a", "b"))
    weak = weak.join(labels.select("node.*", "component"), at, "left").withColumn("component", F.coalesce("component", place(0, 0)))
    hit = weak.join(weak.where("strong").select("component").distinct(), "component", "left_semi").select(*at, F.lit(1.0).alias("hit"))
    return r.with_pixels(r.pixels.join(hit, at, "left").select(*KEYS, F.coalesce("hit", F.lit(0.0)).alias("c0")))


@operator("canny", "edge", Param("sigma", 1.4, 0.1, 20, 0.1, help="width of the blur before"), LOW, HIGH)
def canny(r: Raster, sigma: float, low: float, high: float) -> Raster:
    smooth = get("gaussian_blur").build(r, sigma=sigma)
    thin = r.with_pixels(_thin(gradients(smooth, 1.0)), "R32F")
    return hysteresis.build(thin, low=low, high=high)
