"""Summed-area tables and windows by tiles, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.functions import neighbours
from pixelquilt.plans import registry
from pixelquilt.plans.raster import Raster


def image(spark, w, h, value, number=1):
    px = spark.range(w * h).selectExpr(f"cast({number} as long) as image_id", f"cast(id % {w} as int) as x", f"cast(id div {w} as int) as y", f"{w} as w", f"{h} as h")
    return px.withColumn("c0", F.expr(f"cast({value} as double)"))


def table(df, w, h, *columns):
    pdf, out = df.toPandas(), np.full((len(columns), h, w), np.nan)
    for i, c in enumerate(columns):
        out[i, pdf["y"], pdf["x"]] = pdf[c]
    return out


@pytest.mark.parametrize("w,h,tile", [(1, 1, 4), (7, 9, 4), (8, 8, 4), (3, 17, 5), (30, 2, 7), (5, 5, 64)])
def test_integral(spark, w, h, tile):
    df = image(spark, w, h, "x * 7919 + y * 104729 % 1000").withColumn("d", F.col("c0") * 2 - 5)
    got = table(neighbours.integral(df, ["c0", "d"], tile), w, h, "c0", "d")
    want = table(df, w, h, "c0", "d").cumsum(1).cumsum(2)
    assert (got == want).all()


def test_integral_keeps_images_apart(spark):
    df = image(spark, 6, 5, "1").union(image(spark, 3, 9, "2", 2))
    last = neighbours.integral(df, ["c0"], 4).where("x = w - 1 and y = h - 1").select("image_id", "c0").collect()
    assert dict(last) == {1: 30.0, 2: 54.0}
    assert neighbours.integral(df.where("x < 0"), ["c0"], 4).count() == 0


@pytest.mark.parametrize("w,h,k", [(1, 1, 1), (5, 4, 3), (300, 17, 7), (9, 530, 100)])
def test_moments_and_extremes(spark, w, h, k):
    df = image(spark, w, h, "(x * 37 + y * 101) % 251 / 250")
    a = table(df, w, h, "c0")[0]
    want = np.zeros((4, h, w))
    for y in range(h):
        for x in range(w):
            part = a[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1]
            want[:, y, x] = part.mean(), part.std(), part.min(), part.max()
    got = table(neighbours.moments(df, "c0", k), w, h, "c0", "mean", "sd")
    assert (got[0] == a).all() and np.allclose(got[1:], want[:2], atol=1e-12, rtol=0) if min(w, h) > 1 else np.allclose(got[1:], want[:2])
    assert (table(neighbours.extremes(df, "c0", k), w, h, "lo", "hi") == want[2:]).all()


def test_flat_images_have_no_deviation(spark):
    df = image(spark, 20, 20, "0.1")
    assert {(r["mean"], r["sd"]) for r in neighbours.moments(df, "c0", 3).collect()} == {(0.1, 0.0)}
    got = registry.get("threshold_niblack")(Raster(df, "R32F"), window=5).pixels
    assert [r["c0"] for r in got.select("c0").distinct().collect()] == [0.0]


def test_tall_images_are_many_groups(spark):
    df = image(spark, 3, 20_000, "y % 97")
    rows = neighbours.moments(df, "c0", 100)
    got = table(rows, 3, 20_000, "mean")[0]
    whole = np.concatenate([[0], np.cumsum(np.arange(20_000) % 97)])
    at = np.arange(20_000)
    low, high = np.maximum(0, at - 100), np.minimum(20_000, at + 101)
    assert np.allclose(got[:, 1], (whole[high] - whole[low]) / (high - low))
    groups = df.select(F.floor(F.col("y") / neighbours.TILE)).distinct().count()
    assert groups == 79
