"""The registered queries of the raster operators, over rasters made from the tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.functions.neighbours import integral
from pixelquilt.functions.white_balance import as_shot_table
from pixelquilt.operators import display, edges, statistics
from pixelquilt.operators.demosaic import demosaic
from pixelquilt.operators.second import compare_plans
from pixelquilt.operators.threshold import threshold
from pixelquilt.plans import branches, registry, sources
from pixelquilt.plans.batch import Batch, from_raster
from pixelquilt.plans.raster import KEYS, Raster
from pixelquilt.plans.scratch import folder
from pixelquilt.sources import pictures, rasters, sensors
from pixelquilt.sources.catalog import Catalog
from pixelquilt.streaming import controls


def events(spark: SparkSession, sf_dir: str) -> Raster:
    """One RGBA8 image, 100 pixels wide, a pixel for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    h = (e.agg(F.max("event_id")).first()[0] or 0) // 100 + 1
    at = lambda s: F.expr(s).cast("int")
    byte = lambda s: F.expr(s).cast("double")
    px = e.select(F.lit(0).cast("long").alias("image_id"), at("event_id % 100").alias("x"), at("event_id div 100").alias("y"), F.lit(100).alias("w"), F.lit(int(h)).alias("h"), byte("floor(value) % 256").alias("c0"), byte("user_id % 256").alias("c1"), byte("event_id * 7 % 256").alias("c2"), F.lit(255.0).alias("c3"))
    return Raster(px, "RGBA8")


def vectors(spark: SparkSession, sf_dir: str) -> Raster:
    """An R32F image of 8 x 8 for each embedding."""
    return rasters.from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding", 8)


def mosaics(spark: SparkSession, sf_dir: str) -> Raster:
    """The same as sensor counts of an RGGB mosaic."""
    r = vectors(spark, sf_dir)
    px = r.pixels.withColumn("c0", (F.col("c0") + 0.6) * 1000)
    return Raster(px, "R32F", cfa="RGGB", black=100.0, white=1100.0, cam_mul=(2.0, 1.0, 1.5), rgb_cam=(0.9, 0.1, 0.0, 0.05, 0.9, 0.05, 0.0, 0.2, 0.8))


def shown(r: Raster) -> DataFrame:
    return r.pixels.select("image_id", "x", "y", *[F.round(c, 6).alias(c) for c in r.channels])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


#: name: (source, operator, parameters).
CHAINS: dict[str, tuple[Callable, str, dict]] = {
    "grayscale": (events, "grayscale", {}),
    "brightness": (events, "brightness", {"brightness": 0.1, "gain": 1.2}),
    "basic_adjust": (events, "basic_adjust", {"exposure": 0.5, "contrast": 0.2, "highlights": -0.4, "shadows": 0.3, "whites": 0.1, "blacks": -0.2, "vibrance": 0.3, "saturation": -0.2, "tint": 0.1}),
    "threshold": (events, "threshold", {"level": 100}),
    "threshold_otsu": (events, "threshold_otsu", {}),
    "threshold_triangle": (events, "threshold_triangle", {}),
    "threshold_isodata": (vectors, "threshold_isodata", {"invert": True}),
    "threshold_niblack": (events, "threshold_niblack", {"window": 7}),
    "threshold_sauvola": (events, "threshold_sauvola", {"window": 7}),
    "threshold_bernsen": (events, "threshold_bernsen", {"window": 5}),
    "threshold_adaptive_mean": (events, "threshold_adaptive_mean", {"window": 9}),
    "threshold_adaptive_gaussian": (vectors, "threshold_adaptive_gaussian", {"window": 7, "sigma": 2.0, "c": 0}),
    "box_blur": (events, "box_blur", {"radius": 3}),
    "gaussian_blur": (vectors, "gaussian_blur", {"sigma": 1.0}),
    "median_blur": (events, "median_blur", {"radius": 2}),
    "bilateral": (events, "bilateral", {"sigma_space": 1.0, "sigma_range": 0.2}),
    "guided_filter": (vectors, "guided_filter", {"radius": 2}),
    "anisotropic_diffusion": (vectors, "anisotropic_diffusion", {"iterations": 3}),
    "kuwahara": (events, "kuwahara", {"radius": 2}),
    "kuwahara_float": (vectors, "kuwahara", {"radius": 2}),
    "kuwahara_generalized": (vectors, "kuwahara_generalized", {"radius": 2}),
    "symmetric_nearest": (events, "symmetric_nearest", {"radius": 2}),
    "nonlocal_means": (vectors, "nonlocal_means", {"patch": 1, "search": 2, "strength": 0.3}),
    "canny": (vectors, "canny", {"sigma": 1.0, "low": 0.2, "high": 0.6}),
    "hysteresis": (vectors, "hysteresis", {"low": 0.1, "high": 0.2}),
    "demosaic_passthrough": (mosaics, "demosaic_passthrough", {}),
    "demosaic_bilinear": (mosaics, "demosaic_bilinear", {}),
    "demosaic_malvar": (mosaics, "demosaic_malvar", {}),
}


def _chain(source: Callable, name: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shown(registry.get(name)(source(spark, sf_dir), **params))


def sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three results beside each other, in one pass."""
    return rounded(edges.gradients(events(spark, sf_dir)).select("image_id", "x", "y", "gx", "gy", "mag"))


def non_max_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(registry.get("non_max_suppression")(*registry.get("sobel")(vectors(spark, sf_dir))))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.binned(vectors(spark, sf_dir)))


def histogram_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.finish(statistics.binned(events(spark, sf_dir)), 0.9))


def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.image_stats(vectors(spark, sf_dir)))


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture against its brightened self."""
    r = events(spark, sf_dir)
    return rounded(statistics.compare(r, registry.get("brightness")(r, brightness=0.1), 20.0))


def diff_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir)
    return shown(statistics.diff_image(r, registry.get("brightness")(r, brightness=0.02), 16.0))


def display_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(display.display(vectors(spark, sf_dir)))


def thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.thumbnail(events(spark, sf_dir), 32)


def thumbnail_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.thumbnail(vectors(spark, sf_dir), 4)


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(display.region(events(spark, sf_dir), 3, 5))


def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thresholded vectors as PNG files, and decoded again."""
    mask = display.display(threshold(vectors(spark, sf_dir), level=0))
    return shown(Raster(rasters.decoded(rasters.png_bytes(mask)), "RGBA8"))


def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of values and of their squares from the first pixel on, by tiles of 64."""
    px = events(spark, sf_dir).pixels.select(*KEYS, F.col("c0").alias("total"), (F.col("c0") * F.col("c0")).alias("squares"))
    return integral(px, ["total", "squares"], 64).select("image_id", "x", "y", "total", "squares")


def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vectors' images, stretched so that some go beyond white."""
    r = vectors(spark, sf_dir)
    return display.info(Raster(r.pixels.withColumn("c0", F.col("c0") * 4), "R32F"))


#: Chains with equal beginnings: c says b's parameters in other words, d is a but for its last step.
BRANCHES = {
    "a": [("box_blur", {"radius": 2}), ("threshold", {"level": 100}), "grayscale"],
    "b": [("box_blur", {"radius": 2}), ("threshold", {"level": 120, "invert": True})],
    "c": [("box_blur", {"radius": 2.7}), ("threshold", {"invert": 1, "level": 120.4})],
    "d": [("box_blur", {"radius": 2}), ("threshold", {"level": 100})],
    "e": [("threshold", {"level": 120, "invert": True})],
}


def shared_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chain's bright pixels, the first chain that is equal to it, and how many chains share its first step."""
    prints = {n: branches.fingerprints(c) for n, c in BRANCHES.items()}
    out = None
    for name, r in branches.run_all(events(spark, sf_dir), BRANCHES).items():
        same = min(n for n, own in prints.items() if own == prints[name])
        users = sum(own[0] == prints[name][0] for own in prints.values())
        one = r.pixels.agg(F.count("*").alias("pixels"), F.sum(F.expr("cast(c0 > 0 as long)")).alias("bright")).select(F.lit(name).alias("chain"), F.lit(same).alias("same_as"), F.lit(users).alias("users"), "pixels", "bright")
        out = one if out is None else out.union(one)
    return out


def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content): each vector's image, in bytes, as a file: PNG in colour, of 16 bits, with a palette of
    sixteen and interlaced, BMP, a file that ends early, and one of no known format."""

    def write(number: int, values: np.ndarray) -> bytes:
        px = np.clip(np.floor((values[..., 0] + 0.6) * 200), 0, 255).astype(np.uint8)
        colour = np.stack([px, 255 - px, px // 2, px | 1], axis=2)
        palette = np.stack([np.arange(16) * c for c in (1, 3, 5, 16)], axis=1).astype(np.uint8)
        every, kind = (4, 3, 2, 1, 0), number % 8
        if kind == 1:
            return pictures.encode_png(px.astype(np.uint16) * 256 + 77, depth=16, kinds=every)
        if kind == 2:
            return pictures.encode_png(px // 16, palette, 4, kinds=every)
        if kind == 3:
            return pictures.encode_png(colour, laced=True, kinds=every)
        if kind == 4:
            return pictures.encode_bmp(colour)
        whole = pictures.encode_png(colour, kinds=every)
        return whole[:60] if kind == 5 else b"GIF89a" + whole if kind == 6 else whole

    return rasters.encoded(vectors(spark, sf_dir).pixels, write)


def pictures_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(Raster(rasters.decoded(picture_files(spark, sf_dir)), "RGBA8"))


def picture_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file is, and why some give no picture."""
    return rasters.examined(picture_files(spark, sf_dir)).where("status is not null").select("image_id", "kind", "w", "h", "status", "problem")


def latest_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as control changes: a user's last value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return controls.latest(e.select("user_id", "value", "event_id"), "user_id", "value", "event_id")


def readouts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sensor lines, camera data): each embedding as an 8 x 8 readout of one of many cameras, some of them broken."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    counts = e.select("vec_id", F.expr("transform(embedding, v -> (cast(v as double) + 0.6) * 1000)").alias("counts"))
    one = lambda i: f"cast(embedding[{i}] as double)"
    cameras = e.selectExpr(
        "vec_id as image_id", "concat('frame-', vec_id) as name",
        "case when vec_id % 50 = 7 then null when vec_id % 50 = 11 then array(0, 0, 1, 2) when vec_id % 50 = 13 then array_repeat(1, 36) else element_at(array(array(0, 1, 3, 2), array(2, 1, 3, 0), array(1, 0, 2, 3), array(1, 2, 0, 3)), cast(pmod(vec_id, 4) + 1 as int)) end as colours",
        "cast(if(vec_id % 50 = 17, 5, vec_id % 3) as int) as left", "cast(vec_id div 3 % 2 as int) as top", "cast(if(vec_id % 50 = 19, 0, 8 - vec_id % 3 - vec_id % 2) as int) as width", "cast(8 - vec_id div 3 % 2 as int) as height",
        "80.0d + label as black", "array(vec_id % 5, 1, 2, vec_id % 7, 99) as cblack", "if(vec_id % 50 = 23, 10, 1100) as maximum",
        f"array(1.2d + abs({one(1)}) * 6, 1.0d + vec_id % 2, 1.1d + abs({one(2)}) * 6, 0.0d) as cam_mul", "if(vec_id % 6 = 0, array(0.0d, 0.0d, 0.0d, 0.0d), array(2.2d, 1.0d, 1.4d + label / 20, 0.0d)) as pre_mul",
        "if(vec_id % 8 = 0, array_repeat(0.0d, 9), array(0.9d, 0.1d, 0.0d, 0.05d, 0.9d, 0.05d, 0.0d, 0.2d, 0.8d)) as rgb_cam",
    )
    return sensors.sensor_lines(counts, "vec_id", "counts", 8), cameras


def sensor_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the frames' descriptors say, and why some give no mosaic."""
    lines, cameras = readouts(spark, sf_dir)
    _, told = sensors.load(lines, cameras)
    part = lambda c, *at: [F.element_at(c, i).alias(f"{c}_{i}") for i in at]
    d = sensors.descriptors(cameras).select("image_id", "w", "h", "cfa", "black", "white", *part("cam_mul", 1, 3), *part("pre_mul", 1, 3), *part("rgb_cam", 1, 2, 9), "has_daylight_wb")
    return rounded(d.join(told.select("image_id", "problem"), "image_id"))


def sensor_demosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of many cameras in colour, in one plan."""
    frames, _ = sensors.load(*readouts(spark, sf_dir))
    return rounded(demosaic(frames).pixels.select("image_id", "x", "y", "c0", "c1", "c2", "c3"))


def as_shot_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cameras = readouts(spark, sf_dir)
    return as_shot_table(sensors.descriptors(cameras)).select("image_id", F.round("kelvin", 1).alias("kelvin"), F.round("tint", 5).alias("tint"))


def mixed(spark: SparkSession, sf_dir: str) -> Batch:
    """Sensor frames, and every fourth vector as a picture in bytes besides, its number negative."""
    frames, _ = sensors.load(*readouts(spark, sf_dir))
    v = vectors(spark, sf_dir).pixels.where("image_id % 4 = 0")
    byte = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("c0") + 0.6) / 1.2)) * 255).cast("double")
    px = v.select((-F.col("image_id") - 1).alias("image_id"), "x", "y", "w", "h", *[byte.alias(c) for c in ("c0", "c1", "c2")], F.lit(255.0).alias("c3"))
    return frames.union(from_raster(Raster(px, "RGBA8"), "picture"))


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images of a mixed batch, only the mosaics demosaiced."""
    out = sources.image(mixed(spark, sf_dir), method="demosaic_bilinear")
    told = out.descriptors.select("image_id", "name", "fmt", "linear")
    return rounded(out.pixels.select("image_id", "x", "y", "c0", "c1", "c2", "c3").join(told, "image_id"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points a vector's image, some of them outside it."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return e.selectExpr("vec_id as image_id", "label", "explode(array(0, 1)) as k").selectExpr("image_id * 2 + k as point_id", "image_id", "cast(label + k * 3 - 2 as int) as x", "cast(image_id % 14 - 3 as int) as y")


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.window_stats(vectors(spark, sf_dir), places(spark, sf_dir), 3))


def window_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.window_histogram(vectors(spark, sf_dir), places(spark, sf_dir), 2)


def plans_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three filters by windows and by tiles: how many pixels differ, of how many, in all images."""
    r, out = vectors(spark, sf_dir), None
    for step in (("box_blur", {"radius": 2}), ("gaussian_blur", {"sigma": 1.0}), ("kuwahara", {"radius": 2})):
        name, told, _ = compare_plans(r, step)
        whole = told.agg(F.lit(name).alias("operator"), F.count("*").alias("images"), F.sum("pixels").alias("pixels"), F.sum("diff_pixels").alias("diff_pixels"), (F.max("max_diff") < 1e-9).alias("close"))
        out = whole if out is None else out.union(whole)
    return out


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of images under 97 names into a new catalog: who is there at last, in which version."""
    catalog = Catalog(spark, folder(spark, "catalog"))
    label = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label")
    batch = from_raster(vectors(spark, sf_dir))
    told = batch.descriptors.withColumn("name", F.expr("concat('slot-', image_id * 7 % 97)")).withColumn("at", F.col("image_id")).join(label, "image_id")
    for odd in (0, 1):
        d = told.where(F.col("label") % 2 == odd)
        catalog.install(Batch(batch.pixels.join(d.select("image_id"), "image_id", "left_semi"), d), order="at")
    got = catalog.batch()
    sums = got.pixels.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum("c0").alias("total"))
    return rounded(got.descriptors.select("image_id", "name", "version").join(sums, "image_id").select("name", "version", "pixels", "total"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as control changes, numbered out of order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", "ts", F.expr("event_id * 7919 % 100003").alias("seq"), "value")


def debounced_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's changes that have settled for two hours."""
    return rounded(controls.debounce(changes(spark, sf_dir), "user_id", gap="2 hours"))


def fresh_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that are newer than all of their user before them."""
    return rounded(controls.drop_stale(changes(spark, sf_dir), "user_id"))


def image_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled bins of all four histograms of one large picture, a subsample of it from 262,144 pixels on."""
    h = statistics.image_histograms(wide(spark, sf_dir))
    each = h.select("image_id", F.explode(F.expr("map('red', red, 'green', green, 'blue', blue, 'luma', luma)")).alias("channel", "counts"))
    return each.select("image_id", "channel", F.posexplode("counts").alias("bin", "n")).where("n > 0")


def wide(spark: SparkSession, sf_dir: str) -> Raster:
    """The events' picture with each pixel as a block of 8 x 8."""
    r = events(spark, sf_dir)
    px = r.pixels.withColumns({"bx": F.explode(F.sequence(F.lit(0), F.lit(7)))}).withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(7))))
    at = lambda s: F.expr(f"cast({s} as int)")
    return Raster(px.select("image_id", at("x * 8 + bx").alias("x"), at("y * 8 + by").alias("y"), at("w * 8").alias("w"), at("h * 8").alias("h"), *[((F.col(c) + F.col("bx") * k + F.col("by")) % 256).alias(c) for c, k in (("c0", 1), ("c1", 2), ("c2", 3))], "c3"), "RGBA8")


def image_stats_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.image_stats(wide(spark, sf_dir)))


def thumbnail_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a picture of two columns, which are less than a block."""
    r = events(spark, sf_dir)
    return display.thumbnail(Raster(r.pixels.where("x < 2").withColumn("w", F.lit(2)), "RGBA8"), 32)


def compare_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against themselves, every second one cut by a row."""
    r = vectors(spark, sf_dir)
    cut = r.pixels.withColumn("h", F.expr("if(image_id % 2 = 0, h, h - 1)")).where("y < h").withColumn("c0", F.col("c0") * 0.5)
    return rounded(statistics.compare(r, Raster(cut, "R32F"), 0.01))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [sobel, non_max_suppression, histogram, histogram_finish, image_stats, compare, diff_image, display_normalise, thumbnail, thumbnail_float, region, png_round_trip, integral_image, shared_branches, image_info, pictures_decoded, picture_status, latest_control, sensor_descriptors, sensor_demosaic, as_shot_balance, resolved_sources, window_stats, window_histogram, plans_compared, catalog_upsert, debounced_controls, fresh_results, image_histograms, image_stats_large, thumbnail_slim, compare_sizes]
    return {n: _chain(*c) for n, c in CHAINS.items()} | {f.__name__: f for f in own}
