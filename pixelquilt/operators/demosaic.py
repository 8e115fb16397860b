"""Demosaicing: colours of a sensor mosaic from the neighbours of each place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquilt.functions.neighbours import tap
from pixelquilt.functions.pixels import TILES, cfa_colour, clamp, half
from pixelquilt.plans.batch import Batch
from pixelquilt.plans.raster import KEYS, Raster
from pixelquilt.plans.registry import Param, operator


def _build(r: Raster, alpha: float, beta: float, gamma: float) -> Raster:
    """Bilinear colours plus the centre's Laplacian with these weights."""
    if r.cfa not in TILES or r.fmt != "R32F":
        cols = r.colours if len(r.colours) == 3 else ["c0"] * 3
        return r.with_pixels(r.pixels.select(*KEYS, *[half(F.col(c) / r.scale).alias(f"c{i}") for i, c in enumerate(cols)], half(F.col("c3") / r.scale if len(r.channels) == 4 else F.lit(1.0)).alias("c3")), "RGBA16F")
    px = r.pixels.withColumn("s", clamp((F.col("c0") - r.black) / max(r.white - r.black, 1e-6), 0, 4))
    own, across = cfa_colour(r.cfa, F.col("x"), F.col("y")), cfa_colour(r.cfa, F.col("x") - 1, F.col("y"))
    return r.with_pixels(_colours(px, own, across, list(r.cam_mul), list(r.rgb_cam), alpha, beta, gamma), "RGBA16F")


def _colours(px: DataFrame, own: Column, across: Column, gain: list, m: list, alpha: float, beta: float, gamma: float) -> DataFrame:
    """c0..c3 of levelled counts ``s``; own, across: colour of a place and of its left neighbour."""
    wide = bool(alpha or beta or gamma)
    px = px.withColumn("hs", tap("s", "x", -1) + tap("s", "x", 1))
    px = px.withColumn("h2", tap("s", "x", -2) + tap("s", "x", 2)) if wide else px
    px = px.withColumns({"vs": tap("s", "y", -1) + tap("s", "y", 1), "xs": tap("hs", "y", -1) + tap("hs", "y", 1)} | ({"v2": tap("s", "y", -2) + tap("s", "y", 2)} if wide else {}))
    h, v, x, s = F.col("hs"), F.col("vs"), F.col("xs"), F.col("s")
    lap_h, lap_v = (2 * s - F.col("h2"), 2 * s - F.col("v2")) if wide else (F.lit(0.0), F.lit(0.0))
    level = 0.5 * h + gamma * (5 * lap_h - lap_v)
    upright = 0.5 * v + gamma * (5 * lap_v - lap_h)
    edges, corners = 0.25 * (h + v) + alpha * (lap_h + lap_v), 0.25 * x + beta * (lap_h + lap_v)
    raw = []
    for i in range(3):
        if i == 1:
            raw.append(F.when(own == 1, s).otherwise(edges))
        else:
            raw.append(F.when(own == i, s).when(own == 1, F.when(across == i, level).otherwise(upright)).otherwise(corners))
    px = px.withColumns({f"r{i}": v * gain[i] for i, v in enumerate(raw)})
    out = [half(F.greatest(F.lit(0.0), sum((F.col(f"r{j}") * m[3 * i + j] for j in (1, 2)), F.col("r0") * m[3 * i]))).alias(f"c{i}") for i in range(3)]
    return px.select(*KEYS, *out, F.lit(1.0).alias("c3"))


#: Laplacian weights of the methods by name, for batches.
METHODS = {"demosaic_bilinear": (0.0, 0.0, 0.0), "demosaic_malvar": (0.125, 0.1875, 0.0625)}


def demosaic(batch: Batch, method: str = "demosaic_malvar") -> Batch:
    """The mosaics of a mixed batch in colour, each by its own levels, pattern, gains and matrix.

    A descriptor meets its image's pixels row by row, so the join and the windows along rows share
    one shuffle.  X-Trans mosaics come out grey, in their counts; images that are no mosaics are
    left aside.
    """
    if method not in METHODS:
        raise ValueError(f"unknown default demosaic '{method}'")
    d = batch.descriptors.where("cfa <> 'None'")
    tile = F.create_map(*[F.lit(x) for name, t in TILES.items() for x in (name, ",".join(map(str, t)))])
    rows = d.where("h > 0").select("image_id", F.explode(F.expr("sequence(0, h - 1)")).alias("y"), "black", (F.greatest(F.col("white") - F.col("black"), F.lit(1e-6))).alias("span"), F.split(F.try_element_at(tile, F.col("cfa")), ",").cast("array<int>").alias("tile"), "cam_mul", "rgb_cam")
    px = batch.pixels.select(*KEYS, "c0").join(rows, ["image_id", "y"])
    bayer = px.where("tile is not null").withColumn("s", clamp((F.col("c0") - F.col("black")) / F.col("span"), 0, 4))
    at = lambda dx: F.element_at("tile", (F.pmod(F.col("y"), F.lit(2)) * 2 + F.pmod(F.col("x") + dx, F.lit(2)) + 1).cast("int"))
    done = _colours(bayer, at(0), at(-1), [F.element_at("cam_mul", i) for i in (1, 2, 3)], [F.element_at("rgb_cam", i) for i in range(1, 10)], *METHODS[method])
    grey = px.where("tile is null").select(*KEYS, *[half(F.col("c0")).alias(c) for c in ("c0", "c1", "c2")], F.lit(1.0).alias("c3"))
    return Batch(done.unionByName(grey), d.withColumns({"fmt": F.lit("RGBA16F"), "cfa": F.lit("None"), "linear": F.lit(True)}))


@operator("demosaic_bilinear", "demosaic")
def bilinear(r: Raster) -> Raster:
    return _build(r, 0.0, 0.0, 0.0)


@operator("demosaic_malvar", "demosaic", Param("alpha", 0.125, 0, 1, 0.01, help="Laplacian in green"), Param("beta", 0.1875, 0, 1, 0.01, help="Laplacian in the opposite colour"), Param("gamma", 0.0625, 0, 0.5, 0.005, help="Laplacian at green sites"))
def malvar(r: Raster, alpha: float, beta: float, gamma: float) -> Raster:
    return _build(r, alpha, beta, gamma)
