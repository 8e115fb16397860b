"""Camera data from JPEG files: an Arrow function over binary files, empty where there is none."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FIELDS = ("make", "model", "lens", "shutter", "aperture", "iso", "focal", "taken")
#: The tags of the format.
TAGS = {0x010F: "make", 0x0110: "model", 0x0132: "changed", 0x9003: "taken", 0x829A: "shutter", 0x829D: "aperture", 0x8827: "iso", 0x920A: "focal", 0xA434: "lens"}
_SIZES = {2: 1, 3: 2, 4: 4, 5: 8, 10: 8}
HEAD, ENTRIES = 128 << 10, 512


def _directory(tiff: bytes, order: str, at: int, out: dict) -> int:
    """Read one directory into ``out``; where the one of camera data begins, or 0."""
    more = 0
    if at + 2 > len(tiff):
        return 0
    for i in range(min(struct.unpack_from(order + "H", tiff, at)[0], ENTRIES)):
        e = at + 2 + 12 * i
        if e + 12 > len(tiff):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", tiff, e)
        if tag == 0x8769:
            more = struct.unpack_from(order + "I", tiff, e + 8)[0]
        if tag not in TAGS or kind not in _SIZES:
            continue
        size = _SIZES[kind] * n
        where = e + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, e + 8)[0]
        if where + size > len(tiff) or not n:
            continue
        if kind == 2:
            value = tiff[where : where + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (5, 10):
            a, b = struct.unpack_from(order + ("II" if kind == 5 else "ii"), tiff, where)
            value = a / b if b else None
        else:
            value = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, where)[0]
        if value not in (None, ""):
            out.setdefault(TAGS[tag], value)
    return more


def parse(data: bytes) -> dict[str, str] | None:
    """The fields as shown, or null: missing and damaged data are no error."""
    data = data[:HEAD]
    at, found = 2, {}
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order and len(tiff) >= 8 and struct.unpack_from(order + "H", tiff, 2)[0] == 42:
                more = _directory(tiff, order, struct.unpack_from(order + "I", tiff, 4)[0], found)
                if more:
                    _directory(tiff, order, more, found)
            break
        if kind == 0xDA:
            break
        at += 2 + size
    if not found:
        return None
    text = {k: str(found[k]) for k in ("make", "model", "lens") if k in found}
    if isinstance(s := found.get("shutter"), float) and s > 0:
        text["shutter"] = f"1/{1 / s:.0f} s" if s < 1 else f"{s:.1f} s"
    if isinstance(v := found.get("aperture"), float):
        text["aperture"] = f"f/{v:.1f}"
    if isinstance(v := found.get("focal"), float):
        text["focal"] = f"{v:.0f} mm"
    if "iso" in found:
        text["iso"] = f"ISO {found['iso']}"
    if taken := found.get("taken") or found.get("changed"):
        text["taken"] = str(taken)
    return {f: text.get(f, "") for f in FIELDS}


def read(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, fields...) of each file; all null where a file has no camera data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(batch.column(1)[i].as_py() or b"") or {} for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(f) for r in rows], pa.string()) for f in FIELDS]], [key, *FIELDS])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(work, f"{key} {kind}, " + ", ".join(f"{f} string" for f in FIELDS))
