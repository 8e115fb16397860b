"""A mixed batch: images of any formats and cameras, with a descriptor for each.

Where a ``Raster`` holds what all its images share, a ``Batch`` has a table with one row an image,
which joins its pixels by (image_id, y): a shuffle that windows along rows need anyway, so a large
image is many groups also here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt.plans.raster import KEYS, Raster

#: Columns of a descriptor; the colour data are those of ``Raster``.
DESCRIPTOR = ("image_id", "name", "w", "h", "fmt", "cfa", "black", "white", "cam_mul", "pre_mul", "has_daylight_wb", "rgb_cam", "linear", "version")
CHANNELS = ("c0", "c1", "c2", "c3")


@dataclass(frozen=True)
class Batch:
    """pixels: image_id, x, y, w, h, c0..c3 (c1..c3 null in one-channel images); descriptors: see DESCRIPTOR."""

    pixels: DataFrame
    descriptors: DataFrame

    def where(self, which: Column) -> Batch:
        """The images whose descriptor fulfils a condition."""
        kept = self.descriptors.where(which)
        return Batch(self.pixels.join(kept.select("image_id"), "image_id", "left_semi"), kept)

    def union(self, other: Batch) -> Batch:
        return Batch(self.pixels.unionByName(other.pixels), self.descriptors.unionByName(other.descriptors))

    def raster(self, fmt: str) -> Raster:
        """The images of one format that are no mosaics, for operators that need no descriptor."""
        own = self.where((F.col("fmt") == fmt) & (F.col("cfa") == "None"))
        return Raster(own.pixels.select(*KEYS, *(CHANNELS[:1] if fmt == "R32F" else CHANNELS)), fmt, linear=fmt == "RGBA16F")


def from_raster(r: Raster, name: str = "image") -> Batch:
    """A raster as a batch, its images named by their numbers."""
    each = r.pixels.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    own = {"name": F.concat(F.lit(f"{name}-"), F.col("image_id").cast("string")), "fmt": F.lit(r.fmt), "cfa": F.lit(r.cfa), "black": F.lit(float(r.black)), "white": F.lit(float(r.white)), "cam_mul": numbers(r.cam_mul), "pre_mul": numbers(r.pre_mul), "has_daylight_wb": F.lit(r.has_daylight_wb), "rgb_cam": numbers(r.rgb_cam), "linear": F.lit(r.linear), "version": F.lit(0).cast("long")}
    px = r.pixels if len(r.channels) == 4 else r.pixels.withColumns({c: F.lit(None).cast("double") for c in CHANNELS[1:]})
    return Batch(px.select(*KEYS, *CHANNELS), each.withColumns(own).select(*DESCRIPTOR))
