"""Picture files to and from arrays of (rows, columns, 4) bytes: PNG of all kinds, and BMP without run lengths.

Samples of 16 bits keep their high byte, those of less than 8 are stretched to 0..255; check sums
of PNG chunks aren't looked at.  One picture is one value, so a task holds one of them decoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the PNG format: samples a pixel and depths by colour type; the seven passes' first column and row, and their steps.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Longest side of a picture, so that damaged headers ask for no memory.
SIDE = 1 << 24


class Unreadable(ValueError):
    """status: ``damaged`` (a known format that breaks its rules) or ``unsupported``."""

    def __init__(self, status: str, problem: str):
        super().__init__(problem)
        self.status, self.problem = status, problem


def _predicted(kinds: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each pixel is told relative to: by its line's kind from the pixels left, above, and above left."""
    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    nearest = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
    return np.choose(kinds, [np.zeros_like(a), a, b, (a + b) >> 1, nearest])


def _unfilter(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes from filtered ones.  A pixel needs its left and upper neighbours alone, so all
    pixels of one diagonal are done at once, whatever their lines' kinds."""
    if kinds.max(initial=0) > 4:
        raise Unreadable("damaged", "unknown line filter")
    if not kinds.any():
        return lines
    h, w = lines.shape[0], lines.shape[1] // step
    whole = np.zeros((h + 1, w + 1, step), np.int16)
    whole[1:, 1:] = lines.reshape(h, w, step)
    flat, kinds = whole.reshape(-1, step), kinds.astype(np.intp)[:, None]
    for d in range(h + w - 1):
        top, bottom = max(0, d - w + 1), min(h, d + 1)
        start = (top + 1) * (w + 1) + d - top + 1
        on = lambda back: flat[start - back : start - back + (bottom - top - 1) * w + 1 : w]  # noqa: E731, B023
        on(0)[:] = (on(0) + _predicted(kinds[top:bottom], on(1), on(w + 1), on(w + 2))) & 255
    return whole[1:, 1:].reshape(h, w * step).astype(np.uint8)


def _filter(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    h, w = lines.shape[0], lines.shape[1] // step
    whole = np.zeros((h + 1, w + 1, step), np.int16)
    whole[1:, 1:] = lines.reshape(h, w, step)
    told = _predicted(kinds.astype(np.intp)[:, None, None], whole[1:, :-1], whole[:-1, 1:], whole[:-1, :-1])
    return ((whole[1:, 1:] - told) & 255).reshape(h, w * step).astype(np.uint8)


def _unpacked(lines: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The first n samples of each line of bytes."""
    if depth == 8:
        return lines[:, :n]
    if depth == 16:
        return np.ascontiguousarray(lines).view(">u2").astype(np.uint16)[:, :n]
    bits = np.unpackbits(lines, axis=1)[:, : n * depth].reshape(len(lines), n, depth)
    return (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)


def _packed(samples: np.ndarray, depth: int) -> np.ndarray:
    if depth == 8:
        return samples.astype(np.uint8)
    if depth == 16:
        return samples.astype(">u2").view(np.uint8)
    bits = (samples.astype(np.uint8)[:, :, None] >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(bits.reshape(len(samples), -1), axis=1)


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks up to the last one, those of one kind put together."""
    at, parts = len(SIGNATURE), {}
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IEND":
            break
        parts.setdefault(kind, []).append(data[at + 8 : at + 8 + size])
        at += 12 + size
    return {k: b"".join(v) for k, v in parts.items()}


def _png_samples(body: bytes, w: int, h: int, n: int, depth: int, laced: bool) -> np.ndarray:
    """(rows, columns, n) samples; interlaced pictures are seven smaller ones, each filtered on its own."""
    passes = PASSES if laced else ((0, 0, 1, 1),)
    sizes = [(-(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in passes]
    lengths = [(pw * n * depth + 7) // 8 + 1 if pw > 0 and ph > 0 else 0 for pw, ph in sizes]
    total = sum(ph * length for (_, ph), length in zip(sizes, lengths) if length)
    try:
        stream = zlib.decompressobj()
        raw = np.frombuffer(stream.decompress(body, total), np.uint8)
        whole = len(raw) == total and (stream.decompress(stream.unconsumed_tail, 1) or stream.eof)
    except zlib.error as e:
        raise Unreadable("damaged", "compressed data are broken") from e
    if not whole:
        raise Unreadable("damaged", "picture ends early")
    out, at = np.zeros((h, w, n), np.uint16 if depth == 16 else np.uint8), 0
    for (x, y, dx, dy), (pw, ph), length in zip(passes, sizes, lengths):
        if not length:
            continue
        lines = raw[at : at + ph * length].reshape(ph, length)
        at += ph * length
        plain = _unfilter(lines[:, 1:], lines[:, 0], max(1, n * depth // 8))
        out[y::dy, x::dx] = _unpacked(plain, pw * n, depth).reshape(ph, pw, n)
    return out


def decode_png(data: bytes) -> np.ndarray:
    chunks = _chunks(data)
    head = chunks.get(b"IHDR", b"")
    if len(head) != 13:
        raise Unreadable("damaged", "no header")
    w, h, depth, colour, packing, filtering, laced = struct.unpack(">IIBBBBB", head)
    if not (0 < w <= SIDE and 0 < h <= SIDE) or depth not in DEPTHS.get(colour, ()) or packing or filtering or laced > 1:
        raise Unreadable("damaged", "header out of range")
    px = _png_samples(chunks.get(b"IDAT", b""), w, h, SAMPLES[colour], depth, bool(laced))
    clear = chunks.get(b"tRNS", b"")
    if colour == 3:
        table = chunks.get(b"PLTE", b"")[: 3 * 256]
        known = len(table) // 3
        if not known or int(px.max()) >= known:
            raise Unreadable("damaged", "colour beyond the palette")
        opaque = np.frombuffer(clear[:known], np.uint8)
        alpha = np.concatenate([opaque, np.full(known - len(opaque), 255, np.uint8)])
        return np.concatenate([np.frombuffer(table[: 3 * known], np.uint8).reshape(-1, 3), alpha[:, None]], axis=1)[px[..., 0]]
    shown = (px >> 8).astype(np.uint8) if depth == 16 else px * np.uint8(255 // (2**depth - 1))
    colours = shown[..., :1].repeat(3, axis=2) if px.shape[2] < 3 else shown[..., :3]
    if colour in (4, 6):
        alpha = shown[..., -1:]
    elif len(clear) == 2 * px.shape[2]:  # this one colour is transparent
        alpha = np.where((px == np.frombuffer(clear, ">u2")).all(2, keepdims=True), 0, 255).astype(np.uint8)
    else:
        alpha = np.full((h, w, 1), 255, np.uint8)
    return np.concatenate([colours, alpha], axis=2)


def encode_png(px: np.ndarray, palette: np.ndarray | None = None, depth: int = 8, laced: bool = False, kinds: tuple[int, ...] = (0,)) -> bytes:
    """A PNG of (rows, columns, 4) bytes, or of (rows, columns) grey values or, with a palette of (n, 4)
    bytes, colour numbers of some depth; the lines' filters are ``kinds`` in turn."""
    px = px if px.ndim == 3 else px[..., None]
    h, w, n = px.shape
    colour, body = 3 if palette is not None else 0 if n == 1 else 6, []
    for x, y, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        part = px[y::dy, x::dx]
        if part.size:
            lines = _packed(part.reshape(len(part), -1), depth)
            own = np.resize(np.array(kinds, np.uint8), len(lines))
            body.append(np.concatenate([own[:, None], _filter(lines, own, max(1, n * depth // 8))], axis=1).tobytes())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    told = b"" if palette is None else chunk(b"PLTE", palette[:, :3].astype(np.uint8).tobytes()) + chunk(b"tRNS", palette[:, 3].astype(np.uint8).tobytes())
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + told + chunk(b"IDAT", zlib.compress(b"".join(body))) + chunk(b"IEND", b"")


def _channel(v: np.ndarray, mask: int) -> np.ndarray:
    """A channel of packed pixels as bytes; narrow ones repeat their bits."""
    if not mask:
        return np.zeros(v.shape, np.uint8)
    bits = bin(mask).count("1")
    own = (v & np.uint32(mask)) >> np.uint32((mask & -mask).bit_length() - 1)
    if bits >= 8:
        return (own >> np.uint32(bits - 8)).astype(np.uint8)
    own = own << np.uint32(8 - bits)
    while bits < 8:
        own, bits = own | own >> np.uint32(bits), bits * 2
    return own.astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 26:
        raise Unreadable("damaged", "no header")
    offset, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size not in (12, 40, 56, 108, 124) or len(data) < 14 + size:
        raise Unreadable("unsupported" if size > 12 and len(data) >= 14 + size else "damaged", "unknown header")
    w, h, _, bits = struct.unpack_from("<HHHH" if size == 12 else "<iiHH", data, 18)
    packing = struct.unpack_from("<I", data, 30)[0] if size > 12 else 0
    if not (0 < w <= SIDE and 0 < abs(h) <= SIDE) or bits not in (1, 4, 8, 16, 24, 32):
        raise Unreadable("damaged", "header out of range")
    if packing not in (0, 3) or packing == 3 and bits not in (16, 32):
        raise Unreadable("unsupported", "run lengths or an embedded picture")
    length, n = (w * bits + 31) // 32 * 4, abs(h)
    if len(data) < offset + length * n:
        raise Unreadable("damaged", "picture ends early")
    lines = np.frombuffer(data, np.uint8, length * n, offset).reshape(n, length)
    lines = lines[::-1] if h > 0 else lines
    opaque = np.full((n, w, 1), 255, np.uint8)
    if bits <= 8:
        width = 3 if size == 12 else 4
        known = min(max(0, offset - 14 - size) // width, 256)
        px = _unpacked(lines, w, bits)
        if not known or int(px.max()) >= known:
            raise Unreadable("damaged", "colour beyond the palette")
        table = np.frombuffer(data, np.uint8, known * width, 14 + size).reshape(known, width)
        return np.concatenate([table[px][..., 2::-1], opaque], axis=2)
    if bits == 24:
        return np.concatenate([lines[:, : 3 * w].reshape(n, w, 3)[..., ::-1], opaque], axis=2)
    packed = np.ascontiguousarray(lines[:, : w * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
    masks = (0x7C00, 0x3E0, 0x1F, 0) if bits == 16 else (0xFF0000, 0xFF00, 0xFF, 0xFF000000)
    if packing == 3:
        if len(data) < 66:
            raise Unreadable("damaged", "no masks")
        masks = struct.unpack_from("<IIII" if size >= 56 and len(data) >= 70 else "<III", data, 54) + (0,)
    channels = [_channel(packed, m)[..., None] for m in masks[:4]]
    #: A fourth channel of zeros alone is one that isn't used.
    return np.concatenate(channels[:3] + [channels[3] if masks[3] and channels[3].any() else opaque], axis=2)


def encode_bmp(px: np.ndarray) -> bytes:
    """A BMP of 24 bits of (rows, columns, 3 or more) bytes."""
    h, w = px.shape[:2]
    lines = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    lines[:, : 3 * w] = px[::-1, :, 2::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + lines.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, lines.size, 0, 0, 0, 0) + lines.tobytes()


def decode(data: bytes) -> tuple[str, np.ndarray]:
    """(kind, pixels) of a file; ``Unreadable`` says why there are none."""
    if data[:8] == SIGNATURE:
        return "png", decode_png(data)
    if data[:2] == b"BM":
        return "bmp", decode_bmp(data)
    raise Unreadable("unsupported", "empty file" if not data else "unknown format")
