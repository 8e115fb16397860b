import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelquilt.functions.pixels import half
from pixelquilt.functions.white_balance import as_shot, kelvin_gains
from pixelquilt.operators import display, statistics
from pixelquilt.plans import registry
from pixelquilt.plans.raster import Raster
from pixelquilt.sources import exif, rasters


def image(spark, w, h, c0, *more, fmt="RGBA8", images=1, **meta):
    px = spark.range(images * w * h).selectExpr(f"id div {w * h} as image_id", f"cast(id % {w} as int) as x", f"cast(id div {w} % {h} as int) as y", f"{w} as w", f"{h} as h")
    exprs = [c0, *more] if fmt == "R32F" or more else [c0, c0, c0, "255"]
    return Raster(px.select("*", *[F.expr(e).cast("double").alias(f"c{i}") for i, e in enumerate(exprs)]), fmt, **meta)


def grid(r, c="c0", image_id=0):
    rows = r.pixels.where(F.col("image_id") == image_id).select("x", "y", c).collect()
    out = np.zeros((max(x.y for x in rows) + 1, max(x.x for x in rows) + 1))
    for x in rows:
        out[x.y, x.x] = x[c]
    return out


BIMODAL = "if(x < 32, 60, 200)"
EDGE = "if(x < 16, 40, 210)"


def test_every_filter_parameter_says_what_it_does():
    for name in registry.names():
        assert all(p.help or p.kind == "bool" for p in registry.get(name).params), name


def test_the_registry_has_all_operators_and_refuses_unknown_names():
    assert len(registry.names()) == 29
    assert registry.names("edge") == ["canny", "sobel"]
    with pytest.raises(KeyError, match="unknown operator 'nope'"):
        registry.get("nope")


def test_snapping_comes_before_clamping_and_only_for_given_values(spark):
    p = registry.Param("alpha", 0.125, 0, 1, 0.01)
    assert p.value(0.125) == pytest.approx(0.13)
    assert p.value(7) == 1
    assert registry.Param("n", 3, 1, 64, 1, "int").value(2.9) == 2
    with pytest.raises(TypeError, match="takes a number"):
        p.value("x")
    r = image(spark, 4, 4, "x")
    with pytest.raises(TypeError, match="has no parameter 'radios'"):
        registry.get("box_blur")(r, radios=2)
    with pytest.raises(TypeError, match="takes 3 image"):
        registry.get("non_max_suppression")(r)


def test_half_floats_truncate_flush_and_saturate(spark):
    values = [0.1, 1 / 16384, 1e-6, 1e30, -2.5, 0.0, 0.333]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(half(F.col("v"))).collect()]
    assert abs(got[0] - 0.1) < 1e-3 and got[0] <= 0.1
    assert got[1] == 1 / 16384 and got[2] == 0 and got[3] == 65504 and got[4] == -2.5 and got[5] == 0
    assert got[6] <= 0.333


def test_histogram_thresholds_of_two_levels(spark):
    r = image(spark, 64, 64, BIMODAL)
    hist = statistics.binned(r)
    row = statistics.finish(hist).first()
    assert row["mean"] == 130 and row["count"] == 4096 and row["peak"] == 60
    assert 61 < statistics.otsu(hist).first()["t"] < 199
    assert statistics.isodata(hist).first()["t"] == pytest.approx(130, abs=1)
    for name in ("threshold_otsu", "threshold_isodata"):
        m = grid(registry.get(name)(r))
        assert m[:, :32].sum() == 0 and m[:, 32:].all()
        assert (grid(registry.get(name)(r, invert=True)) == 1 - m).all()


@pytest.mark.parametrize("name", registry.names("filter"))
def test_a_flat_picture_stays_flat(spark, name):
    given = {"iterations": 2} if name == "anisotropic_diffusion" else {}
    out = registry.get(name)(image(spark, 20, 12, "128"), **given)
    assert np.abs(grid(out) - 128).max() <= 1 and (grid(out, "c3") == 255).all()


@pytest.mark.parametrize("name", ["median_blur", "kuwahara", "symmetric_nearest", "bilateral", "guided_filter", "anisotropic_diffusion"])
def test_edge_preserving_filters_keep_the_edge(spark, name):
    m = grid(registry.get(name)(image(spark, 32, 16, EDGE)))
    assert m[8, 12] < 60 and m[8, 20] > 190


def test_tiles_give_what_one_tile_gives(spark, monkeypatch):
    from pixelquilt.functions import neighbours
    from pixelquilt.operators import filters

    r = image(spark, 40, 24, "(x * 7 + y * 13) % 256", images=2)
    whole = {n: grid(registry.get(n)(r, **p), image_id=1) for n, p in (("median_blur", {"radius": 2}), ("anisotropic_diffusion", {"iterations": 4}))}
    monkeypatch.setattr(filters, "tiled", lambda df, c, k, fn: neighbours.tiled(df, c, k, fn, tile=8))
    for n, p in (("median_blur", {"radius": 2}), ("anisotropic_diffusion", {"iterations": 4})):
        assert (grid(registry.get(n)(r, **p), image_id=1) == whole[n]).all()


def test_small_tiles_are_computed_together_and_come_out_alike(spark, monkeypatch):
    from pixelquilt.functions import neighbours

    sizes = "case when image_id % 3 = 0 then 5 when image_id % 3 = 1 then 8 else 11 end"
    px = spark.range(30).selectExpr("nullif(id, 29) as image_id", "explode(sequence(0, 10)) as x").selectExpr("*", "explode(sequence(0, 6)) as y")
    px = px.selectExpr("image_id", "x", "y", f"coalesce({sizes}, 11) as w", "7 as h", "coalesce(image_id, 29) * 1000.0D + x * 10 + y as c0").where("x < w")
    for tile, at_once in ((256, 1 << 16), (4, 300), (4, 1)):
        monkeypatch.setattr(neighbours, "AT_ONCE", at_once)
        calls = spark.sparkContext.accumulator(0)

        def left(a, pad):
            calls.add(1)
            return a[..., 1:-1, :-2]

        got = neighbours.tiled(px, ["c0"], 1, left, tile=tile).collect()
        assert len(got) == px.count()
        assert all(r.c0 == (29 if r.image_id is None else r.image_id) * 1000 + max(0, r.x - 1) * 10 + r.y for r in got)
        calls_by = {(256, 1 << 16): lambda n: n < 30, (4, 300): lambda n: n < 150, (4, 1): lambda n: n >= 140}
        assert calls_by[tile, at_once](calls.value), calls.value


def test_isodata_steps_look_sums_up(spark):
    from pixelquilt.operators import statistics

    rows, rnd = [], np.random.default_rng(4)
    for i in range(40):
        bins = rnd.choice(256, rnd.integers(1, 60), replace=False)
        rows += [(i, int(b), int(rnd.integers(1, 9)), 0.0, 255.0) for b in bins]
    hist = spark.createDataFrame(rows, "image_id long, bin int, n long, lo double, hi double")
    assert "try_element_at" not in statistics._arrays(hist)._jdf.queryExecution().toString()
    dense = {r.image_id: r.h for r in statistics._arrays(hist).collect()}
    for r in statistics.isodata(hist).collect():
        h = np.zeros(256)
        for i, b, n, _, _ in rows:
            h[b] += n if i == r.image_id else 0
        assert dense[r.image_id] == h.tolist()
        t, at = 128, np.arange(256)
        for _ in range(128):
            low, high = h[: t + 1].sum(), h[t + 1 :].sum()
            if low and high:
                t = int(((h * at)[: t + 1].sum() / low + (h * at)[t + 1 :].sum() / high) * 0.5 + 0.5)
        assert r.t == t


def test_box_blur_repeats_the_edge_value(spark):
    r = image(spark, 5, 1, "x * 10", fmt="R32F")
    assert grid(registry.get("box_blur")(r, radius=1))[0] == pytest.approx([10 / 3, 10, 20, 30, 110 / 3])


def test_sobel_and_canny_find_a_step(spark):
    gx, gy, mag = registry.get("sobel")(image(spark, 32, 32, EDGE))
    assert grid(gx)[10, 16] > 0 and grid(gy)[10, 16] == 0 and grid(mag)[10, 2] == 0
    e = grid(registry.get("canny")(image(spark, 32, 32, EDGE)))
    assert e[:, 14:18].any(axis=1).all() and not e[:, :10].any()


def test_hysteresis_keeps_weak_pixels_that_touch_strong_ones(spark):
    r = image(spark, 8, 3, "case when y = 1 and x < 5 then 0.2 when y = 1 and x = 7 then 0.2 else 0 end + if(y = 1 and x = 0, 1, 0)", fmt="R32F")
    assert grid(registry.get("hysteresis")(r))[1].tolist() == [1, 1, 1, 1, 1, 0, 0, 0]


SCENE = {0: "0.2 + 0.6 * x / 63", 1: "0.3 + 0.4 * y / 63", 2: "0.5 + 0.3 * (x + y) / 126"}


@pytest.mark.parametrize("cfa", ["RGGB", "BGGR", "GRBG", "GBRG"])
@pytest.mark.parametrize("name", ["demosaic_bilinear", "demosaic_malvar"])
def test_demosaicing_restores_a_smooth_scene(spark, cfa, name):
    from pixelquilt.functions.pixels import TILES

    t = TILES[cfa]
    at = "case (y % 2) * 2 + x % 2 " + " ".join(f"when {i} then {SCENE[c]}" for i, c in enumerate(t)) + " end"
    out = registry.get(name)(image(spark, 64, 64, at, fmt="R32F", cfa=cfa))
    assert out.cfa == "None" and out.linear and out.fmt == "RGBA16F"
    x, y = np.meshgrid(np.arange(64), np.arange(64))
    truth = [0.2 + 0.6 * x / 63, 0.3 + 0.4 * y / 63, 0.5 + 0.3 * (x + y) / 126]
    for c in range(3):
        assert np.abs(grid(out, f"c{c}") - truth[c])[3:-3, 3:-3].max() < 0.01


def test_white_balance_and_levels_are_applied(spark):
    r = image(spark, 16, 16, "if((y % 2) * 2 + x % 2 in (1, 2), 0.5, 0.25)", fmt="R32F", cfa="RGGB", cam_mul=(2.0, 1.0, 2.0))
    out = registry.get("demosaic_bilinear")(r)
    assert all(abs(grid(out, f"c{c}")[8, 8] - 0.5) < 1e-3 for c in range(3))
    dark = registry.get("demosaic_bilinear")(image(spark, 8, 8, "0.25", fmt="R32F", cfa="RGGB", black=0.25, white=0.75))
    assert grid(dark).max() == 0


def test_as_shot_white_balance_is_found_again():
    day, shot = kelvin_gains(6504, 0), kelvin_gains(4300, 0.1)
    r = Raster(None, cam_mul=(shot[0] / day[0], 1.0, shot[2] / day[2]), has_daylight_wb=True)
    kelvin, tint = as_shot(r)
    assert kelvin == pytest.approx(4300, rel=0.02) and tint == pytest.approx(0.1, abs=0.02)
    assert as_shot(Raster(None)) == (0.0, 0.0)


def test_basic_adjust_moves_what_it_names(spark):
    r = image(spark, 8, 8, "if(y < 4, 230, 25)")
    same = registry.get("basic_adjust")(r)
    assert np.abs(grid(same) - grid(r)).max() <= 1
    assert grid(registry.get("basic_adjust")(r, exposure=1))[6, 0] > 30
    assert grid(registry.get("basic_adjust")(r, highlights=-1))[0, 0] < 225
    assert grid(registry.get("basic_adjust")(r, shadows=1))[6, 0] > 30


def test_stats_of_a_clipped_ramp(spark):
    r = image(spark, 800, 600, "case when y < 60 then 0 when y >= 540 then 255 else floor(x * 255 / 799) end")
    row = statistics.image_stats(r).first()
    assert row["count"] == 800 * 600
    steps = spark.createDataFrame([(800, 600), (100, 100), (1024, 1024), (1025, 1025), (5000, 3), (3504, 2336)], "w int, h int")
    want = []
    for w, h in ((800, 600), (100, 100), (1024, 1024), (1025, 1025), (5000, 3), (3504, 2336)):
        s = 1
        while (w // (s + 1)) * (h // (s + 1)) > statistics.SAMPLE:
            s += 1
        want.append(s)
    assert [r[0] for r in steps.select(statistics.sample_step(F.col("w"), F.col("h"))).collect()] == want
    assert row["clip_low"] == pytest.approx(0.1, abs=0.01) and row["clip_high"] == pytest.approx(0.1, abs=0.01)


def test_compare_and_its_picture(spark):
    a, b = image(spark, 10, 10, "100"), image(spark, 10, 10, "if(x = 0 and y = 0, 130, 100)")
    row = statistics.compare(a, b, 1.0).first()
    assert row["max_diff"] == 30 and row["diff_pixels"] == 1 and row["pixels"] == 100
    d = grid(statistics.diff_image(a, b))
    assert d[0, 0] == 255 and d.sum() == 255
    with pytest.raises(ValueError, match="formats differ"):
        statistics.compare(a, image(spark, 10, 10, "1", fmt="R32F"), 1.0)


def test_thumbnail_region_and_display(spark):
    r = image(spark, 65, 20, "x")
    assert {(x.x, x.y) for x in display.thumbnail(r, 32).collect()} == {(x, y) for x in range(21) for y in range(6)}
    assert display.region(r, 0, 0).pixels.count() == 225 and display.region(r, 64, 19).pixels.agg(F.min("x")).first()[0] == 50
    flat = display.display(image(spark, 3, 3, "7", fmt="R32F"))
    assert grid(flat).max() == 0 and flat.fmt == "RGBA8"


def test_png_files_come_back_and_others_are_passed_over(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 256, (9, 7, 4), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(rasters.encode_png(px))
    (tmp_path / "b.png").write_bytes(b"no picture")
    r = rasters.read_png(spark, f"file://{tmp_path}")
    rows = r.pixels.collect()
    assert len(rows) == 63 and all([x.c0, x.c1, x.c2, x.c3] == px[x.y, x.x].tolist() for x in rows)


@pytest.mark.parametrize("kind", range(5))
def test_png_line_filters(kind):
    lines, w = [[10, 20, 30, 40, 50, 60], [11, 22, 33, 44, 55, 66]], 2
    enc, above = b"", [0] * 6
    for line in lines:
        out = []
        for i, v in enumerate(line):
            a, b, c = (line[i - 3] if i >= 3 else 0), above[i], (above[i - 3] if i >= 3 else 0)
            p = a + b - c
            out.append((v - [0, a, b, (a + b) // 2, min((a, b, c), key=lambda q: abs(p - q))][kind]) % 256)
        enc += bytes([kind, *out])
        above = line
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = rasters.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, 2, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(enc)) + part(b"IEND", b"")
    assert rasters.decode_png(data)[..., :3].reshape(2, 6).tolist() == lines


def _jpeg():
    def entry(tag, kind, n, value):
        return struct.pack("<HHI", tag, kind, n) + (value if isinstance(value, bytes) else struct.pack("<I", value)).ljust(4, b"\0")

    make, lens = b"TestCam\0", b"TestLens 50mm\0"
    base = 8 + 2 + 2 * 12 + 4
    sub = base + len(make)
    heap = sub + 2 + 5 * 12 + 4
    ifd0 = struct.pack("<H", 2) + entry(0x010F, 2, len(make), base) + entry(0x8769, 4, 1, sub) + b"\0" * 4
    vals = struct.pack("<IIIIII", 1, 250, 28, 10, 50, 1) + lens
    ifd1 = struct.pack("<H", 5) + entry(0x829A, 5, 1, heap) + entry(0x829D, 5, 1, heap + 8) + entry(0x8827, 3, 1, struct.pack("<H", 800)) + entry(0x920A, 5, 1, heap + 16) + entry(0xA434, 2, len(lens), heap + 24) + b"\0" * 4
    body = b"Exif\0\0" + b"II*\0" + struct.pack("<I", 8) + ifd0 + make + ifd1 + vals
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def test_camera_data_and_damaged_files(spark):
    files = spark.createDataFrame([("a", bytearray(_jpeg())), ("b", bytearray(b"\xff\xd8\xff\xe1\x00\x40Exif\0\0II*\0")), ("c", None)], "path string, content binary")
    got = {x.path: x for x in exif.read(files).collect()}
    assert (got["a"].make, got["a"].shutter, got["a"].aperture, got["a"].iso, got["a"].focal, got["a"].lens) == ("TestCam", "1/250 s", "f/2.8", "ISO 800", "50 mm", "TestLens 50mm")
    assert got["b"].make is None and got["c"].make is None


def test_gauss_weights_add_up():
    from pixelquilt.operators.threshold import gauss

    assert math.isclose(sum(gauss(2.0, 6)), 1)


def test_latest_control_from_a_stream(spark, tmp_path):
    from pixelquilt.streaming import controls

    spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 3), ("a", 2.0, 2), ("b", 5.0, 1)], "label string, value double, seq long").write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema("label string, value double, seq long").parquet(str(tmp_path / "in"))
    q = controls.latest(changes).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(x.label, x.value) for x in spark.table("latest").collect()} == {("a", 3.0), ("b", 5.0)}


def test_damaged_pictures_give_no_pixels(spark):
    good = rasters.encode_png(np.full((2, 3, 4), 7, np.uint8))
    files = [(1, good), (2, good[:50]), (3, b"\x89PNG\r\n\x1a\n"), (4, b""), (5, None), (6, good[:41] + b"\xff\xff\xff" + good[44:]), (7, good[:20])]
    px = rasters.decoded(spark.createDataFrame(files, "image_id long, content binary")).groupBy("image_id").count().collect()
    assert {r["image_id"]: r["count"] for r in px} == {1: 6}
    names = spark.createDataFrame([("a.X3F",), ("b.fff",), ("c.nef/d.png",), ("e.CR3",)], "p string")
    assert [r[0] for r in names.select(rasters.is_raw(F.col("p"))).collect()] == [True, False, False, True]


def test_a_large_image_is_many_tasks_and_long_contours_few_rounds(spark):
    r = image(spark, 300, 200, "(x * 7 + y * 13) % 256")
    blurred = registry.get("box_blur")(r, radius=2).pixels
    plan = blurred._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(image_id") >= 2 and "repartition" not in plan.lower()
    spiral = np.zeros((21, 21))
    for k in range(0, 10, 2):
        spiral[k, k:21 - k] = spiral[k:21 - k, 20 - k] = spiral[20 - k, k:21 - k] = 0.5
        spiral[k + 2:21 - k, k] = 0.5
    spiral[0, 0] = 1.0
    px = spark.createDataFrame([(1, x, y, 21, 21, float(spiral[y, x])) for y in range(21) for x in range(21)], "image_id long, x int, y int, w int, h int, c0 double")
    got = grid(registry.get("hysteresis")(Raster(px, "R32F"), low=0.4, high=0.9), image_id=1)
    todo, reach = [(0, 0)], {(0, 0)}
    while todo:
        y, x = todo.pop()
        for j in range(max(0, y - 1), min(21, y + 2)):
            for i in range(max(0, x - 1), min(21, x + 2)):
                if spiral[j, i] >= 0.4 and (j, i) not in reach:
                    reach.add((j, i))
                    todo.append((j, i))
    assert {tuple(map(int, p)) for p in np.argwhere(got == 1)} == reach and len(reach) > 60


def test_thumbnails_of_floats(spark):
    px = image(spark, 4, 4, "x * 100 + 50").pixels.select("image_id", "x", "y", "w", "h", "c0")
    got = display.thumbnail(Raster(px, "R32F", black=50.0, white=350.0), 2).orderBy("y", "x").collect()
    assert [(r.c0, r.c3) for r in got] == [(42, 255), (212, 255)] * 2
