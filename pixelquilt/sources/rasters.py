"""Rasters from tables, from picture files, and to PNG files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.plans.raster import Raster
from pixelquilt.plans.scratch import materialize
from pixelquilt.sources import pictures
from pixelquilt.sources.pictures import SIGNATURE, encode_png  # noqa: F401

#: Extensions of sensor files, which need a vendor's decoder and are told apart only.
RAW = "3fr arw cr2 cr3 crw dcr dng erf iiq kdc mef mos mrw nef nrw orf pef raf raw rw2 rwl sr2 srf srw x3f".split()


def from_arrays(df: DataFrame, key: str, values: str, width: int) -> Raster:
    """One R32F image a row, its values row by row."""
    px = df.select(F.col(key).cast("long").alias("image_id"), F.size(values).alias("n"), F.posexplode(values).alias("i", "v"))
    at = lambda e: F.expr(e).cast("int")
    return Raster(px.select("image_id", at(f"i % {width}").alias("x"), at(f"i div {width}").alias("y"), F.lit(width).alias("w"), at(f"n div {width}").alias("h"), F.col("v").cast("double").alias("c0")), "R32F")


def is_raw(path):
    """Whether a path's extension, after its last slash, is that of a sensor file."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1)).isin(RAW)


def decode_png(data: bytes) -> np.ndarray | None:
    """(rows, columns, 4) bytes of a PNG; null for what is none, or damaged."""
    try:
        return pictures.decode_png(data) if data[:8] == SIGNATURE else None
    except pictures.Unreadable:
        return None


def read_png(spark: SparkSession, path: str) -> Raster:
    """Every PNG under a path as one RGBA8 batch; image_id is a hash of the file's path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select(F.xxhash64("path").alias("image_id"), "content")
    return Raster(decoded(files), "RGBA8")


PIXELS = "image_id long, x int, y int, w int, h int, c0 double, c1 double, c2 double, c3 double"


def examined(files: DataFrame) -> DataFrame:
    """(image_id, content) as pixels, and for each file a row more, without a place, that tells its kind,
    status (ok, damaged or unsupported) and problem; a null content is an empty file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                kind, px, status, problem = None, np.zeros((0, 0, 4), np.uint8), "ok", None
                try:
                    kind, px = pictures.decode(content.as_py() or b"")
                except pictures.Unreadable as e:
                    status, problem = e.status, e.problem
                h, w = px.shape[:2]
                told = [[number], [None], [None], [w], [h], *[[None]] * 4, [kind], [status], [problem]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(told, types)], names)
                for top in range(0, h, max(1, 1_000_000 // max(1, w))):  # some rows at a time
                    part = px[top : top + max(1, 1_000_000 // w)]
                    y, x = np.divmod(np.arange(part.shape[0] * w), w)
                    n = len(x)
                    cols = [np.full(n, number, np.int64) if number is not None else pa.nulls(n, pa.int64()), x.astype(np.int32), (y + top).astype(np.int32), np.full(n, w, np.int32), np.full(n, h, np.int32)]
                    cols += [part[..., c].ravel().astype(float) for c in range(4)] + [pa.nulls(n, pa.string())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names)

    names = [c.split()[0] for c in PIXELS.split(", ")] + ["kind", "status", "problem"]
    types = [pa.int64(), *[pa.int32()] * 4, *[pa.float64()] * 4, *[pa.string()] * 3]
    return files.select("image_id", "content").mapInArrow(work, PIXELS + ", kind string, status string, problem string")


def decoded(files: DataFrame) -> DataFrame:
    """(image_id, content) as pixels; what is no readable picture gives no pixels."""
    return examined(files).where("status is null").drop("kind", "status", "problem")


def load(spark: SparkSession, path: str) -> tuple[Raster, DataFrame]:
    """Every file under a path: the pictures as one RGBA8 batch, and (image_id, path, kind, w, h, status,
    problem) of all files.  Sensor files have status ``sensor`` and aren't opened: their readouts go
    through ``sources.sensors``.  Spark lists no files without bytes.  Files are decoded once, into a scratch table that both results read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.xxhash64("path").alias("image_id"), "path", "content")
    sensor = files.where(is_raw("path")).select("image_id", "path", F.lit(None).cast("string").alias("kind"), F.lit(0).alias("w"), F.lit(0).alias("h"), F.lit("sensor").alias("status"), F.lit("a sensor's readout, not a picture").alias("problem"))
    rows = materialize(examined(files.where(~is_raw("path"))), "pictures")
    names = files.select("image_id", "path")
    told = rows.where("status is not null").join(names, "image_id").select(sensor.columns)
    return Raster(rows.where("status is null").drop("kind", "status", "problem"), "RGBA8"), told.union(sensor)


def encoded(r: DataFrame, fn) -> DataFrame:
    """(image_id, content): fn(image_id, (rows, columns, channels) values) of each image's pixels; those of
    an unfinished last row are left out."""
    channels = [c for c in ("c0", "c1", "c2", "c3") if c in r.columns]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        number, w, h = (int(pdf[c].iloc[0]) for c in ("image_id", "w", "h"))
        px = np.zeros((h, w, len(channels)))
        px[pdf["y"], pdf["x"]] = pdf[channels].to_numpy()
        return pd.DataFrame({"image_id": [number], "content": [fn(number, px)]})

    return r.where("x < w and y < h").groupBy("image_id").applyInPandas(work, "image_id long, content binary")


def png_bytes(r: Raster) -> DataFrame:
    """(image_id, content): each RGBA8 image as a PNG file."""
    if r.fmt != "RGBA8":
        raise ValueError("only RGBA8 can be written as PNG")
    return encoded(r.pixels, lambda _, px: pictures.encode_png(px.astype(np.uint8)))
