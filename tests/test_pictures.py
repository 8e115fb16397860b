"""Picture files against a plain decoder, and the table of what could not be read."""

import struct
import zlib

import numpy as np
import pytest

from pixelquilt.sources import pictures, rasters


def plain_unfilter(raw, h, length, step):
    """Line by line and byte by byte, from the format's definition."""
    out = []
    for y in range(h):
        kind, line = raw[y * (length + 1)], list(raw[y * (length + 1) + 1 : (y + 1) * (length + 1)])
        for i in range(length):
            a = line[i - step] if i >= step else 0
            b = out[-1][i] if out else 0
            c = out[-1][i - step] if out and i >= step else 0
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line[i] = (line[i] + (0, a, b, (a + b) // 2, near)[kind]) % 256
        out.append(line)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 4), (5, 9, 3), (1, 12, 2), (12, 1, 8), (16, 16, 6)])
def test_filters(shape):
    h, w, step = shape
    rng = np.random.default_rng(h * 100 + w)
    raw = rng.integers(0, 256, (h, 1 + w * step), dtype=np.uint8)
    raw[:, 0] = rng.integers(0, 5, h)
    want = plain_unfilter(raw.tobytes(), h, w * step, step)
    assert (pictures._unfilter(raw[:, 1:], raw[:, 0], step) == want).all()
    assert (pictures._filter(want, raw[:, 0], step) == raw[:, 1:]).all()


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (3, 2), (8, 8), (13, 5), (2, 17)])
def test_png_kinds(laced, size):
    rng, kinds = np.random.default_rng(sum(size)), (4, 3, 0, 1, 2)
    colour = rng.integers(0, 256, (*size, 4), dtype=np.uint8)
    assert (pictures.decode_png(pictures.encode_png(colour, laced=laced, kinds=kinds)) == colour).all()
    for depth in (1, 2, 4, 8, 16):
        grey = rng.integers(0, 2**depth, size)
        got = pictures.decode_png(pictures.encode_png(grey, depth=depth, laced=laced, kinds=kinds))
        shown = grey >> 8 if depth == 16 else grey * 255 // (2**depth - 1)
        assert (got[..., :3] == shown[..., None]).all() and (got[..., 3] == 255).all()
        if depth < 16:
            palette = rng.integers(0, 256, (2**depth, 4), dtype=np.uint8)
            got = pictures.decode_png(pictures.encode_png(grey, palette, depth, laced, kinds))
            assert (got == palette[grey]).all()


def png(w, h, depth, colour, raw, more=b""):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    return pictures.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + more + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_png_transparent_colour_and_grey_alpha():
    clear = struct.pack(">I", 6) + b"tRNS" + struct.pack(">HHH", 1, 2, 3) + b"\0\0\0\0"
    got = pictures.decode_png(png(2, 1, 8, 2, bytes([0, 1, 2, 3, 1, 2, 4]), clear))
    assert got.tolist() == [[[1, 2, 3, 0], [1, 2, 4, 255]]]
    got = pictures.decode_png(png(2, 1, 16, 4, bytes([0, 9, 1, 8, 2, 7, 3, 6, 4])))
    assert got.tolist() == [[[9, 9, 9, 8], [7, 7, 7, 6]]]
    got = pictures.decode_png(png(1, 1, 16, 2, bytes([0, 5, 1, 6, 2, 7, 3])))
    assert got.tolist() == [[[5, 6, 7, 255]]]


def bmp(w, h, bits, rows, packing=0, more=b"", size=40):
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, packing, 0, 0, 0, 0, 0) if size == 40 else struct.pack("<IHHHH", 12, w, h, 1, bits)
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + len(head) + len(more)) + head + more + rows


def test_bmp_kinds():
    rng = np.random.default_rng(5)
    px = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (pictures.decode_bmp(pictures.encode_bmp(px))[..., :3] == px).all()
    two = bytes([1, 2, 3, 0, 4, 5, 6, 0])
    assert pictures.decode_bmp(bmp(3, 2, 1, b"\xa0\0\0\0\x40\0\0\0", more=two)).tolist() == [[[3, 2, 1, 255], [6, 5, 4, 255], [3, 2, 1, 255]], [[6, 5, 4, 255], [3, 2, 1, 255], [6, 5, 4, 255]]]
    assert pictures.decode_bmp(bmp(2, 1, 4, b"\x10\0\0\0", more=bytes([1, 2, 3, 4, 5, 6]), size=12)).tolist() == [[[6, 5, 4, 255], [3, 2, 1, 255]]]
    assert pictures.decode_bmp(bmp(2, -1, 16, struct.pack("<HH", 0x7C03, 28 << 5))).tolist() == [[[255, 0, 24, 255], [0, 231, 0, 255]]]
    assert pictures.decode_bmp(bmp(1, 1, 16, struct.pack("<HH", 63 << 5, 0), 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F))).tolist() == [[[0, 255, 0, 255]]]
    assert pictures.decode_bmp(bmp(2, 1, 32, bytes([1, 2, 3, 0, 4, 5, 6, 0]))).tolist() == [[[3, 2, 1, 255], [6, 5, 4, 255]]]
    assert pictures.decode_bmp(bmp(2, 1, 32, bytes([1, 2, 3, 0, 4, 5, 6, 9]))).tolist() == [[[3, 2, 1, 0], [6, 5, 4, 9]]]


def test_status_of_files(spark, tmp_path):
    good = pictures.encode_png(np.full((2, 3, 4), 7, np.uint8))
    (tmp_path / "deep").mkdir()
    files = {"a.png": good, "deep/b.bmp": pictures.encode_bmp(np.full((1, 2, 3), 9, np.uint8)), "cut.png": good[:45], "note.txt": b"hello", "c.CR2": b"sensor", "run.bmp": bmp(2, 2, 8, b"\0" * 8, 1, b"\0" * 1024), "colour.png": png(1, 1, 8, 3, b"\0\5", struct.pack(">I", 3) + b"PLTE\1\2\3\0\0\0\0"), "filter.png": png(1, 1, 8, 0, b"\7\5"), "head.png": png(0, 1, 8, 0, b"\0")}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    raster, told = rasters.load(spark, f"file://{tmp_path}")
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["kind"], r["w"], r["h"]) for r in told.collect()}
    assert got == {"a.png": ("ok", "png", 3, 2), "b.bmp": ("ok", "bmp", 2, 1), "cut.png": ("damaged", None, 0, 0), "note.txt": ("unsupported", None, 0, 0), "c.CR2": ("sensor", None, 0, 0), "run.bmp": ("unsupported", None, 0, 0), "colour.png": ("damaged", None, 0, 0), "filter.png": ("damaged", None, 0, 0), "head.png": ("damaged", None, 0, 0)}
    assert all((r["problem"] is None) == (r["status"] == "ok") for r in told.collect())
    empty = rasters.examined(spark.createDataFrame([(1, b""), (2, None)], "image_id long, content binary")).collect()
    assert [(r["status"], r["problem"]) for r in empty] == [("unsupported", "empty file")] * 2
    assert raster.pixels.count() == 8 and {(r["c0"], r["c3"]) for r in raster.pixels.collect()} == {(7.0, 7.0), (9.0, 255.0)}


def test_large_picture_is_dealt_out(spark):
    px = np.random.default_rng(1).integers(0, 256, (1100, 1000, 4), dtype=np.uint8)
    files = spark.createDataFrame([(1, pictures.encode_png(px, kinds=(4, 3, 1, 2))), (2, None)], "image_id long, content binary")
    sums = rasters.decoded(files).selectExpr("sum(c0 * (x + 1))", "sum(c3 * (y + 1))", "count(*)").first()
    assert sums[0] == (px[..., 0].astype(float) * np.arange(1, 1001)).sum() and sums[1] == (px[..., 3].astype(float) * np.arange(1, 1101)[:, None]).sum() and sums[2] == 1_100_000
