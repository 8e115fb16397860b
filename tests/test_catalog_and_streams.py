"""The catalog of images, streams of changes, second plans, and statistics of large and unequal images."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.operators import display, statistics
from pixelquilt.operators.second import compare_plans
from pixelquilt.plans import registry
from pixelquilt.plans.batch import Batch, from_raster
from pixelquilt.plans.raster import Raster
from pixelquilt.sources.catalog import Catalog, image_name
from pixelquilt.streaming import controls


def batch(spark, *images):
    """images: (name, value); each a 2 x 2 picture of one value, numbered from 0."""
    px = spark.createDataFrame([(i, x, y, 2, 2, float(v)) for i, (_, v) in enumerate(images) for x in (0, 1) for y in (0, 1)], "image_id long, x int, y int, w int, h int, c0 double")
    b = from_raster(Raster(px, "R32F"))
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(images)], "image_id long, own string")
    return Batch(b.pixels, b.descriptors.join(names, "image_id").withColumn("name", F.col("own")).drop("own"))


def held(catalog, snapshot=None):
    b = catalog.batch(snapshot)
    rows = b.pixels.join(b.descriptors.select("image_id", "name", "version"), "image_id").groupBy("name", "version").agg(F.count("*").alias("n"), F.max("c0").alias("v"), F.min("c0").alias("u")).collect()
    assert all(r["n"] == 4 and r["u"] == r["v"] for r in rows)
    return {r["name"]: (r["version"], r["v"]) for r in rows}


def test_loads_of_a_name_replace_it_and_count_up(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    assert c.snapshot() == 0 and held(c) == {} and c.descriptors().count() == 0
    assert c.install(batch(spark, ("a", 1), ("b", 2))) == 1
    assert held(c) == {"a": (0, 1.0), "b": (0, 2.0)}
    # two loads of a and three of a new name in one batch: the last of each stays
    assert c.install(batch(spark, ("a", 3), ("c", 4), ("a", 5), ("c", 6), ("c", 7), (None, 8))) == 2
    assert held(c) == {"a": (2, 5.0), "b": (0, 2.0), "c": (2, 7.0)}
    b = batch(spark, ("b", 9), ("b", 10))
    c.install(Batch(b.pixels, b.descriptors.withColumn("at", -F.col("image_id"))), order="at")
    assert held(c) == {"a": (2, 5.0), "b": (2, 9.0), "c": (2, 7.0)}
    assert held(c, 1) == {"a": (0, 1.0), "b": (0, 2.0)}  # older snapshots stay
    c.install(batch(spark))
    assert c.snapshot() == 4 and held(c)["c"] == (2, 7.0)


def test_a_load_into_a_slot_takes_its_name_where_it_is_known(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    c.install(batch(spark, ("a", 1)))
    b = batch(spark, ("x", 2), ("y", 3))
    c.install(Batch(b.pixels, b.descriptors.withColumn("into", F.expr("if(name = 'x', 'a', 'nowhere')"))), slot="into")
    assert held(c) == {"a": (1, 2.0), "y": (0, 3.0)}


def test_a_failed_load_changes_nothing_and_a_load_beside_another_starts_again(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    c.install(batch(spark, ("a", 1)))
    b = batch(spark, ("a", 2))
    with pytest.raises(Exception, match="broken pixel"):
        c.install(Batch(b.pixels.withColumn("c0", F.when(F.col("x") == 1, F.raise_error(F.lit("broken pixel"))).otherwise(F.col("c0"))), b.descriptors))
    assert c.snapshot() == 1 and held(c) == {"a": (0, 1.0)}
    other, commit = Catalog(spark, f"file://{tmp_path}/catalog"), c._commit

    def late(n, folder):
        c._commit = commit
        other.install(batch(spark, ("a", 5), ("z", 6)))  # gets in between
        return commit(n, folder)

    c._commit = late
    assert c.install(batch(spark, ("a", 7))) == 3
    assert held(c) == {"a": (2, 7.0), "z": (0, 6.0)} and held(c, 2) == {"a": (1, 5.0), "z": (0, 6.0)}


def test_names_of_files(spark):
    df = spark.createDataFrame([("a/b/cat.one.png",), ("C:\\x\\dog.jpg",), ("plain",), ("",)], "p string")
    assert [r[0] for r in df.select(image_name("p")).collect()] == ["cat.one", "dog", "plain", ""]


# --- streams ----------------------------------------------------------------------------------

CHANGE = "label string, value double, seq long, ts timestamp"
T0 = datetime(2024, 1, 1)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def bursts(rows, gap):
    """Plain: (label, began, fired, seq, value, changes)."""
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted((r for r in rows if r[0] == k and r[3] is not None), key=lambda r: r[3])
        group = []
        for r in [*own, None]:
            if group and (r is None or r[3] - group[-1][3] > gap):
                seq, value = max((g[2], g[1]) for g in group)
                out.append((k, group[0][3], group[-1][3] + gap, seq, value, len(group)))
                group = []
            if r:
                group.append(r)
    return sorted(out)


def test_bursts_of_a_batch_and_of_a_stream(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.choice("abc"), float(rnd.randrange(9)), i, at(rnd.randrange(4000))) for i in range(150)] + [("d", 1.0, 1, at(0)), ("d", 2.0, 2, at(100)), ("d", 3.0, 2, at(199))]
    df = spark.createDataFrame(rows + [(None, 1.0, 1, at(5)), ("a", 1.0, 1, None)], CHANGE)
    want = bursts(rows, timedelta(milliseconds=100))
    assert sorted(tuple(r) for r in controls.debounce(df).collect()) == want
    where = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    q = controls.debounce(spark.readStream.schema(CHANGE).parquet(where).withWatermark("ts", "1 second")).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    some = [r for r in rows if r[3] < at(2000)], [r for r in rows if r[3] >= at(2000)], [("end", 0.0, 0, at(60_000))]  # the last one closes all bursts
    for part in some:
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(where)
        q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("bursts").collect())
    assert [r for r in got if r[0] != "end"] == want


def fresh(rows):
    out, shown = [], {}
    for r in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[3], r[2])):
        if r[2] > shown.get(r[0], -(1 << 62)):
            shown[r[0]] = r[2]
            out.append(r)
    return sorted(out)


def test_stale_results_are_dropped_in_a_batch_and_across_micro_batches(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), float(i), rnd.randrange(60), at(i // 2)) for i in range(80)] + [("c", 1.0, 5, at(1)), ("c", 2.0, 5, at(2))]
    bad = [(None, 1.0, 1, at(1)), ("a", 1.0, None, at(0))]
    assert sorted(tuple(r) for r in controls.drop_stale(spark.createDataFrame(rows + bad, CHANGE)).collect()) == fresh(rows)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in"))
        q = controls.drop_stale(stream).writeStream.format("memory").queryName("fresh").outputMode("append").start()
        for i in range(0, len(rows), 30):  # a micro-batch each, in order
            spark.createDataFrame(rows[i : i + 30] + bad, CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
        q.stop()
        got = sorted(tuple(r) for r in spark.table("fresh").select("label", "value", "seq", "ts").collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert got == fresh(rows)


# --- second plans, statistics -----------------------------------------------------------------


def picture(spark, w, h, fmt="RGBA8", images=1, wave="(x * 7 + y * 13 + image_id * 5) % 256"):
    px = spark.range(images * w * h).selectExpr(f"id div {w * h} as image_id", f"cast(id % {w} as int) as x", f"cast(id div {w} % {h} as int) as y", f"{w} as w", f"{h} as h")
    scale = 1.0 if fmt == "RGBA8" else 255.0
    n = 1 if fmt == "R32F" else 4
    return Raster(px.select("*", *[(F.expr(wave).cast("double") / scale).alias(f"c{i}") for i in range(n)]), fmt)


@pytest.mark.parametrize("fmt", ["RGBA8", "R32F"])
@pytest.mark.parametrize("step", [("box_blur", {"radius": 4}), ("gaussian_blur", {"sigma": 1.5}), ("kuwahara", {"radius": 3})])
def test_both_plans_agree(spark, fmt, step):
    name, told, seen = compare_plans(picture(spark, 40, 23, fmt, 2), "grayscale", step)
    rows = told.collect()
    assert name == step[0] and len(rows) == 2 and all(r["diff_pixels"] == 0 and r["pixels"] == 920 and r["max_diff"] <= (1 if fmt == "RGBA8" else 1e-9) for r in rows)
    assert seen.pixels.count() == 1840


def test_what_cannot_be_compared_is_an_error(spark):
    r = picture(spark, 4, 4)
    for steps, at_, said in (((), -1, "no steps"), (("grayscale",), -1, "no step of this chain"), (("box_blur",), 3, "out of range"), (("grayscale", "box_blur"), 0, "has no second plan")):
        with pytest.raises(ValueError, match=said):
            compare_plans(r, *steps, at=at_)
    with pytest.raises(ValueError, match="has a second plan already"):
        registry.second_plan("box_blur")(lambda r: r)


def test_unequal_sizes_compare_as_nothing(spark):
    a, b = picture(spark, 10, 10), picture(spark, 20, 20)
    assert [tuple(r) for r in statistics.compare(a, b, 0).collect()] == [(0, 0.0, 0.0, 0.0, 0, 0)]
    assert statistics.diff_image(a, b).pixels.count() == 0


@pytest.mark.parametrize("w, h", [(300, 3), (3, 300), (1, 1), (64, 64)])
def test_thumbnails_of_slim_pictures(spark, w, h):
    r = picture(spark, w, h)
    step = max(1, -(-max(w, h) // 64))
    grid = np.fromfunction(lambda y, x: (x * 7 + y * 13) % 256, (h, w))
    got = {(t["x"], t["y"]): t["c0"] for t in display.thumbnail(r, 64).collect()}
    assert got == {(x, y): int(grid[y * step : (y + 1) * step, x * step : (x + 1) * step].sum()) // grid[y * step : (y + 1) * step, x * step : (x + 1) * step].size for x in range(max(1, w // step)) for y in range(max(1, h // step))}


def test_kuwahara_of_low_contrast_floats_follows_its_definition(spark):
    rnd = np.random.default_rng(3)
    grid = np.full((9, 9), 0.5)
    grid[:, 5:] += rnd.normal(0, 0.0008, (9, 4))
    px = spark.createDataFrame([(0, x, y, 9, 9, float(grid[y, x])) for y in range(9) for x in range(9)], "image_id long, x int, y int, w int, h int, c0 double")
    got = {(r["x"], r["y"]): r["c0"] for r in registry.get("kuwahara")(Raster(px, "R32F"), radius=2).pixels.collect()}
    pad = np.pad(grid, 2, mode="edge")
    for y in range(9):
        for x in range(9):
            squares = [pad[y + j : y + j + 3, x + i : x + i + 3] for j in (0, 2) for i in (0, 2)]
            least = min(s.var() for s in squares)
            near = [s.mean() for s in squares if s.var() <= least + 1e-11]
            assert min(abs(got[x, y] - m) for m in near) < 1e-12


def test_histograms_of_all_channels(spark):
    r = picture(spark, 30, 20, images=2, wave="(x * 7 + y) % 256")
    r = r.with_pixels(r.pixels.withColumn("c1", F.lit(9.0)))
    for x in statistics.image_histograms(r).collect():
        red = np.bincount([(i * 7 + j) % 256 for i in range(30) for j in range(20)], minlength=256)
        assert x["red"] == x["blue"] == red.tolist() and x["green"] == np.bincount([9] * 600, minlength=256).tolist() and sum(x["luma"]) == 600
    one = statistics.image_histograms(picture(spark, 30, 20, "R32F")).collect()[0]
    assert one["red"] is None and sum(one["luma"]) == 600 and (one["lo"], one["hi"]) == (0.0, 255 / 255)
