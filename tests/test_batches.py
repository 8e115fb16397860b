"""Mixed batches: sensor readouts with a descriptor each, sources by name, as-shot balance, statistics of windows at points."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.functions.white_balance import as_shot, as_shot_table, kelvin_gains
from pixelquilt.operators import statistics
from pixelquilt.operators.demosaic import demosaic
from pixelquilt.plans import registry, sources
from pixelquilt.plans.batch import Batch, from_raster
from pixelquilt.plans.raster import Raster
from pixelquilt.sources import sensors

CAMERA = "image_id long, name string, colours array<int>, left int, top int, width int, height int, black double, cblack array<double>, maximum double, cam_mul array<double>, pre_mul array<double>, rgb_cam array<double>"
BAYER = {"RGGB": [0, 1, 3, 2], "BGGR": [2, 1, 1, 0], "GRBG": [1, 0, 2, 3], "GBRG": [3, 2, 0, 1]}


def camera(i, colours="RGGB", left=0, top=0, w=12, h=10, black=10.0, cblack=None, maximum=110.0, cam=(2.0, 1.0, 1.5), pre=None, matrix=None, name=None):
    return (i, name, BAYER.get(colours, colours) if isinstance(colours, str) else colours, left, top, w, h, black, cblack, maximum, list(cam) if cam else None, pre, matrix)


def readout(i, w, h, seed):
    rnd = random.Random(seed)
    return [(i, y, [float(rnd.randint(0, 120)) for _ in range(w)]) for y in range(h)]


def loaded(spark, cameras, lines):
    return sensors.load(spark.createDataFrame(lines, "image_id long, line int, counts array<double>").repartition(3), spark.createDataFrame(cameras, CAMERA))


def test_a_batch_of_cameras_is_what_each_alone_is(spark):
    """Against one raster for each camera, cut out by hand, its pattern shifted by hand."""
    cases = [(1, "RGGB", 0, 0), (2, "BGGR", 1, 0), (3, "GRBG", 0, 3), (4, "GBRG", 3, 1), (5, "RGGB", 2, 2)]
    shifted = {1: "RGGB", 2: "GBRG", 3: "BGGR", 4: "GRBG", 5: "RGGB"}
    matrix = [0.9, 0.1, 0.0, 0.05, 0.9, 0.05, 0.0, 0.2, 0.8]
    cameras = [camera(i, c, x, y, black=8.0, cblack=[float(i), 0.0, 4.0, float(i), 50.0], maximum=100.0 + i, cam=(1.0 + i, 2.0, 3.0, 0.0), matrix=matrix if i % 2 else [0.0] * 9) for i, c, x, y in cases]
    lines = [r for i, *_ in cases for r in readout(i, 16, 14, i)]
    batch, told = loaded(spark, cameras, lines)
    assert {r["image_id"]: r["cfa"] for r in batch.descriptors.collect()} == shifted
    assert told.where("problem is not null").count() == 0
    for method in ("demosaic_malvar", "demosaic_bilinear"):
        got = {(r["image_id"], r["x"], r["y"]): (r["c0"], r["c1"], r["c2"], r["c3"]) for r in demosaic(batch, method).pixels.collect()}
        assert len(got) == len(cases) * 120
        for i, _, left, top in cases:
            cells = [(i, x, y, 12, 10, counts[x + left]) for n, line, counts in lines if n == i and top <= line < top + 10 for y in [line - top] for x in range(12)]
            px = spark.createDataFrame(cells, "image_id long, x int, y int, w int, h int, c0 double")
            one = Raster(px, "R32F", cfa=shifted[i], black=8.0 + (2 * i + 4) / 4, white=100.0 + i, cam_mul=((1.0 + i) / 2, 1.0, 1.5), **({"rgb_cam": tuple(matrix)} if i % 2 else {}))
            alone = registry.get("demosaic_bilinear").build(one, **{}) if method == "demosaic_bilinear" else registry.get(method).build(one, alpha=0.125, beta=0.1875, gamma=0.0625)
            for r in alone.pixels.collect():
                assert got[i, r["x"], r["y"]] == pytest.approx((r["c0"], r["c1"], r["c2"], r["c3"]), abs=1e-12)


def test_what_gives_no_mosaic_is_told(spark):
    cameras = [camera(1, None), camera(2, []), camera(3, [0, 0, 1, 2]), camera(4, w=0), camera(5, h=11), camera(6), camera(7, w=13), camera(8, [1] * 36), camera(9, cblack=None, maximum=5.0, cam=None, name="dark")]
    lines = [r for i in range(1, 10) for r in readout(i, 12, 10, i)]
    lines += readout(6, 12, 10, 6)[:1] + readout(77, 12, 10, 7)  # a repeated line; a readout without camera
    batch, told = loaded(spark, cameras, lines)
    assert {r["image_id"]: r["problem"] for r in told.collect()} == {1: "no mosaic", 2: "no mosaic", 3: "unknown colour pattern", 4: "no visible frame", 5: "lines are missing", 6: "lines are repeated", 7: "lines are short", 8: None, 9: None}
    d = {r["image_id"]: r for r in batch.descriptors.collect()}
    assert sorted(d) == [8, 9] and d[8]["cfa"] == "XTrans"
    assert (d[9]["white"], d[9]["cam_mul"], d[9]["rgb_cam"], d[9]["has_daylight_wb"], d[9]["name"]) == (11.0, [1.0] * 3, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], False, "dark")
    grey = demosaic(batch).pixels.where("image_id = 8").collect()
    assert len(grey) == 120 and all(r["c0"] == r["c1"] == r["c2"] for r in grey)
    none, told = loaded(spark, cameras[:0], lines[:0])
    assert none.pixels.count() == 0 and told.count() == 0


def test_readouts_in_one_array_become_lines(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, []), (3, None)], "k int, v array<int>")
    assert sorted((r["image_id"], r["line"], r["counts"]) for r in sensors.sensor_lines(df, "k", "v", 2).collect()) == [(1, 0, [1.0, 2]), (1, 1, [3.0, 4]), (1, 2, [5.0])]


def mixed(spark):
    frames, _ = loaded(spark, [camera(1, name="raw"), camera(2, "BGGR", name="other")], readout(1, 12, 10, 1) + readout(2, 12, 10, 2))
    px = spark.range(30).selectExpr("10L as image_id", "cast(id % 6 as int) as x", "cast(id div 6 as int) as y", "6 as w", "5 as h", "cast(id as double) as c0", "1d as c1", "2d as c2", "255d as c3")
    return frames.union(from_raster(Raster(px, "RGBA8"), "picture"))


def test_sources_by_name(spark):
    batch = mixed(spark)
    every = sources.image(batch)
    assert {(r["name"], r["fmt"], r["cfa"], r["linear"]) for r in every.descriptors.collect()} == {("raw", "RGBA16F", "None", True), ("other", "RGBA16F", "None", True), ("picture-10", "RGBA8", "None", False)}
    assert every.pixels.groupBy("image_id").count().count() == 3 and every.pixels.where("c3 is null").count() == 0
    same = {tuple(r) for r in sources.image(batch, "picture-10").pixels.select("x", "y", "c0", "c1", "c2", "c3").collect()}
    assert same == {(i % 6, i // 6, float(i), 1.0, 2.0, 255.0) for i in range(30)}
    assert {r["name"] for r in sources.mosaic(batch).descriptors.collect()} == {"raw", "other"}
    assert sources.mosaic(batch, "raw").pixels.count() == 120
    with pytest.raises(ValueError, match="no image named 'nope'"):
        sources.image(batch, "raw", "nope")
    with pytest.raises(ValueError, match="'picture-10' is no sensor image"):
        sources.mosaic(batch, "picture-10")
    with pytest.raises(ValueError, match="unknown default demosaic"):
        sources.image(batch, method="box_blur")
    assert every.raster("RGBA16F").pixels.count() == 240 and every.raster("RGBA8").fmt == "RGBA8"


def test_a_descriptor_meets_its_pixels_in_one_shuffle(spark):
    """Pixels move by (image, row), for the join and the windows along rows together, and by (image, column)."""
    px = spark.range(100).selectExpr("id div 50 as image_id", "cast(id % 10 as int) as x", "cast(id % 50 div 10 as int) as y", "10 as w", "5 as h", "cast(id as double) as c0", *[f"cast(null as double) as c{i}" for i in (1, 2, 3)])
    d = from_raster(Raster(px.select("image_id", "x", "y", "w", "h", "c0"), "R32F", cfa="RGGB")).descriptors
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = demosaic(Batch(px, d)).pixels.where("c3 = 1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    bayer = plan.split("Union")[1] if "Union" in plan else plan
    assert bayer.count("hashpartitioning(image_id") <= 8 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_as_shot_balance_of_a_table(spark):
    """Gains made from a known light are read back as that light."""
    lights = [(2500.0, 0.1), (4000.0, -0.2), (6504.0, 0.0), (9000.0, 0.3)]
    day = kelvin_gains(6504.0, 0.0)
    rows = []
    for i, (k, t) in enumerate(lights):
        g = kelvin_gains(k, t)
        rows.append((i, [2.2 * g[0] / day[0], 1.0, 1.4 * g[2] / day[2]], [2.2, 1.0, 1.4], True))
    rows += [(90, [2.0, 1.0, 1.5], [1.0, 1.0, 1.0], False), (91, [2.0, 1.0, 1.5], [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "image_id long, cam_mul array<double>, pre_mul array<double>, has_daylight_wb boolean").repartition(2)
    got = {r["image_id"]: (r["kelvin"], r["tint"]) for r in as_shot_table(df).collect()}
    for i, (k, t) in enumerate(lights):
        assert got[i][0] == pytest.approx(k, rel=0.01) and got[i][1] == pytest.approx(t, abs=0.02)
        r = Raster(spark.range(1).toDF("image_id"), cam_mul=tuple(rows[i][1]), pre_mul=(2.2, 1.0, 1.4), has_daylight_wb=True)
        assert as_shot(r) == pytest.approx(got[i])
    assert got[90] == got[91] == (0.0, 0.0)
    assert as_shot_table(df.limit(0)).collect() == []


@pytest.mark.parametrize("fmt, channel", [("R32F", -1), ("RGBA8", -1), ("RGBA8", 2)])
def test_windows_around_points_against_clamped_places(spark, monkeypatch, fmt, channel):
    monkeypatch.setattr(statistics, "SQUARE", 4)
    rnd, sizes = random.Random(4), {1: (13, 9), 2: (1, 5), 3: (6, 1), 4: (1, 1)}
    grids = {i: np.array([[[rnd.randrange(256) for _ in range(4)] for _ in range(w)] for _ in range(h)], dtype=float) for i, (w, h) in sizes.items()}
    n = 1 if fmt == "R32F" else 4
    cells = [(i, x, y, w, h, *grids[i][y, x][:n].tolist()) for i, (w, h) in sizes.items() for y in range(h) for x in range(w)]
    r = Raster(spark.createDataFrame(cells, "image_id long, x int, y int, w int, h int, " + ", ".join(f"c{i} double" for i in range(n))).repartition(4), fmt)
    points = [(k, rnd.choice([1, 1, 1, 2, 3, 4]), rnd.randint(-9, 20), rnd.randint(-9, 15)) for k in range(60)] + [(100 + k, 1, 5, 5) for k in range(20)] + [(500, 99, 0, 0)]
    p = spark.createDataFrame(points + points[:2], "point_id long, image_id long, x int, y int")
    value = lambda c: c[0] if fmt == "R32F" else c[channel] if channel >= 0 else 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
    for radius in (0, 1, 6):
        got = {x["point_id"]: x for x in statistics.window_stats(r, p, radius, channel).collect()}
        hist = statistics.window_histogram(r, p, radius, channel).groupBy("point_id").agg(F.sum("n").alias("n"), F.count("*").alias("bins")).collect()
        assert {x["point_id"]: x["n"] for x in hist} == {k: (2 * radius + 1) ** 2 for k, i, *_ in points if i != 99}
        for k, i, cx, cy in points[:-1]:
            w, h = sizes[i]
            seen = np.array([value(grids[i][min(max(y, 0), h - 1), min(max(x, 0), w - 1)]) for y in range(cy - radius, cy + radius + 1) for x in range(cx - radius, cx + radius + 1)])
            x = got[k]
            assert (x["n"], x["least"], x["most"]) == (len(seen), pytest.approx(seen.min()), pytest.approx(seen.max()))
            assert x["mean"] == pytest.approx(seen.mean()) and x["sd"] == pytest.approx(seen.std(), abs=1e-5)
        assert (got[500]["n"], got[500]["mean"]) == (0, 0.0)
    assert {tuple(x)[2:] for x in statistics.window_stats(r, p, -1).collect()} == {(0, 0.0, 0.0, 0.0, 0.0)}
