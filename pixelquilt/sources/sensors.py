"""Sensor mosaics from decoded readouts: a table of sensor lines and one of what the cameras say.

Lines: (image_id, line, counts), a row for each line of the sensor, margins included.  Camera data,
a row an image: name, colours (of the sensor's first 2 x 2 places row by row, 0 red, 1 and 3 green,
2 blue; 36 of them for X-Trans), left, top, width, height of the visible frame, black, cblack,
maximum, cam_mul, pre_mul, rgb_cam.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt.functions.pixels import TILES
from pixelquilt.plans.batch import CHANNELS, DESCRIPTOR, Batch

_IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def sensor_lines(df: DataFrame, key: str, values: str, raw_width: int) -> DataFrame:
    """(image_id, line, counts) of readouts that are one array a row."""
    n = F.ceil(F.size(values) / raw_width).cast("int")
    rows = df.select(F.col(key).cast("long").alias("image_id"), F.col(values).alias("v"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("line")).where(F.size("v") > 0)
    return rows.select("image_id", F.col("line").cast("int"), F.slice("v", F.col("line") * raw_width + 1, raw_width).cast("array<double>").alias("counts"))


def _pattern(colours: Column, left: Column, top: Column) -> Column:
    """Name of the pattern that the visible frame begins with: an odd margin shifts it."""
    folded = F.transform(colours, lambda c: F.when(c == 3, 1).otherwise(c))
    at = [F.element_at(folded, (F.pmod(top + r, F.lit(2)) * 2 + F.pmod(left + c, F.lit(2)) + 1).cast("int")) for r in (0, 1) for c in (0, 1)]
    tile, out = F.array(*at), F.lit("None")
    for name, known in TILES.items():
        out = F.when(tile == F.array(*[F.lit(k) for k in known]), F.lit(name)).otherwise(out)
    return F.when(F.size(colours) == 36, F.lit("XTrans")).when(F.size(colours) == 4, out).otherwise(F.lit("None"))


def _gains(v: Column) -> Column:
    """Of red, green, blue, green being 1; 1 for what isn't known."""
    at = lambda i: F.coalesce(F.try_element_at(v, F.lit(i)).cast("double"), F.lit(0.0))
    green = F.when(at(2) > 0, at(2)).otherwise(1.0)
    return F.array(*[F.when(at(i) > 0, at(i) / green).otherwise(1.0) if i != 2 else F.lit(1.0) for i in (1, 2, 3)])


def descriptors(cameras: DataFrame) -> DataFrame:
    """A descriptor an image, with left, top, and ``problem`` where the camera's data give no mosaic.

    Nulls count as unknown: no black, white 1 above it, gains 1, colours as they are.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    whole = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    known = lambda i: F.coalesce(F.try_element_at("pre_mul", F.lit(i)).cast("double"), F.lit(0.0)) > 0
    extra = F.aggregate(F.slice(F.coalesce("cblack", F.array().cast("array<double>")), 1, 4), F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))
    d = cameras.withColumns({"left": whole("left"), "top": whole("top"), "w": whole("width"), "h": whole("height"), "black": number("black") + extra / 4, "white": number("maximum"), "has_daylight_wb": known(1) & known(3)})
    d = d.withColumns({
        "cfa": F.coalesce(_pattern(F.col("colours"), F.col("left"), F.col("top")), F.lit("None")),
        "white": F.when(F.col("white") <= F.col("black"), F.col("black") + 1).otherwise(F.col("white")),
        "cam_mul": _gains(F.col("cam_mul")),
        "pre_mul": F.when(F.col("has_daylight_wb"), _gains(F.col("pre_mul"))).otherwise(F.array(*[F.lit(1.0)] * 3)),
        "size": F.aggregate(F.coalesce("rgb_cam", F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + F.abs(F.coalesce(v.cast("double"), F.lit(0.0)))),
    })
    d = d.withColumn("rgb_cam", F.when((F.col("size") < 1e-6) | (F.size("rgb_cam") != 9), F.array(*map(F.lit, _IDENTITY))).otherwise(F.transform("rgb_cam", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))))
    problem = F.when(F.col("colours").isNull() | (F.size("colours") == 0), F.lit("no mosaic")).when(F.col("cfa") == "None", F.lit("unknown colour pattern")).when((F.col("w") <= 0) | (F.col("h") <= 0), F.lit("no visible frame"))
    d = d.withColumns({"fmt": F.lit("R32F"), "linear": F.lit(False), "version": F.lit(0).cast("long"), "problem": problem, "image_id": F.col("image_id").cast("long"), "name": F.coalesce(F.col("name").cast("string"), F.col("image_id").cast("string"))})
    return d.select(*DESCRIPTOR, "left", "top", "problem")


def load(lines: DataFrame, cameras: DataFrame) -> tuple[Batch, DataFrame]:
    """The visible frames as a batch of mosaics in sensor counts, and (image_id, name, problem) of every image.

    Descriptors meet lines, not pixels.  An image with a problem, or whose frame has missing, repeated
    or short lines, gives no pixels; lines without camera data are left aside.
    """
    d = descriptors(cameras)
    frame = lines.select(F.col("image_id").cast("long"), "line", "counts").join(d.where("problem is null").select("image_id", "left", "top", "w", "h"), "image_id").where("line between top and top + h - 1")
    whole = frame.groupBy("image_id").agg(F.count("*").alias("n"), F.countDistinct("line").alias("lines"), F.min(F.size("counts") - F.col("left")).alias("least"))
    told = d.join(whole, "image_id", "left")
    broken = F.when(F.coalesce("lines", F.lit(0)) < F.col("h"), F.lit("lines are missing")).when(F.col("n") > F.col("h"), F.lit("lines are repeated")).when(F.col("least") < F.col("w"), F.lit("lines are short"))
    told = told.withColumn("problem", F.coalesce("problem", broken))
    sound = told.where("problem is null").select(*DESCRIPTOR)
    cells = frame.join(sound.select("image_id"), "image_id", "left_semi").select("image_id", (F.col("line") - F.col("top")).cast("int").alias("y"), "w", "h", F.posexplode(F.expr("slice(counts, left + 1, w)")).alias("x", "c0"))
    px = cells.select("image_id", F.col("x").cast("int").alias("x"), "y", "w", "h", F.col("c0").cast("double").alias("c0"), *[F.lit(None).cast("double").alias(c) for c in CHANNELS[1:]])
    return Batch(px, sound), told.select("image_id", "name", "problem")
