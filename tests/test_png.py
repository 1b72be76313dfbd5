"""PNG files of every kind, made here by the format's definition with each filter, against their pixels."""

import struct
import time
import zlib

import numpy as np
import pytest

from tagloom.functions import images, png


def filtered(raw, unit, kinds):
    """Rows of bytes behind the given filters, pixel by pixel as the format defines them."""
    out = bytearray()
    for y, row in enumerate(raw):
        out.append(kinds[y])
        for i, v in enumerate(row):
            a = int(row[i - unit]) if i >= unit else 0
            b = int(raw[y - 1][i]) if y else 0
            c = int(raw[y - 1][i - unit]) if y and i >= unit else 0
            near = min((abs(p - (a + b - c)), k, p) for k, p in enumerate((a, b, c)))[2]
            out.append((int(v) - (0, a, b, (a + b) // 2, near)[kinds[y]]) & 255)
    return bytes(out)


def packed(px, depth):
    """Rows of samples as rows of bytes."""
    h = len(px)
    if depth == 16:
        return px.astype(">u2").reshape(h, -1).view(np.uint8)
    if depth == 8:
        return px.astype(np.uint8).reshape(h, -1)
    bits = (px.reshape(h, -1)[..., None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)


def file(px, color, depth, lace=False, extra=(), rng=None, cut=0):
    h, w, n = px.shape
    body = b""
    for x, y, dx, dy in png.PASSES if lace else ((0, 0, 1, 1),):
        part = px[y::dy, x::dx]
        if part.size:
            raw = packed(part, depth)
            body += filtered(raw, max(1, n * depth // 8), rng.integers(0, 5, len(raw)).tolist())
    body = zlib.compress(body)
    body = body[: len(body) - cut]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, int(lace)))
    return png.MAGIC + head + b"".join(chunk(*e) for e in extra) + chunk(b"IDAT", body[:50]) + chunk(b"IDAT", body[50:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("lace", [False, True])
@pytest.mark.parametrize("color,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
@pytest.mark.parametrize("h,w", [(1, 1), (3, 11), (21, 13)])
def test_every_kind(color, depth, lace, h, w):
    rng = np.random.default_rng(depth + color)
    px = rng.integers(0, 1 << depth, (h, w, png.SAMPLES[color]))
    table = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
    got = png.decode(file(px, color, depth, lace, [(b"PLTE", table.tobytes())] if color == 3 else [], rng))
    eight = px >> 8 if depth == 16 else px * (255 // ((1 << depth) - 1)) if color != 3 else px
    rgb = table[px[..., 0]] if color == 3 else eight[..., :3] if color in (2, 6) else np.repeat(eight[..., :1], 3, -1)
    assert (got[..., :3] == rgb).all()
    assert (got[..., 3] == (eight[..., -1] if color in (4, 6) else 255)).all()
    assert images.dimensions(file(px, color, depth, lace, rng=rng)) == (w, h)


def test_transparency_and_truncation():
    rng = np.random.default_rng(5)
    px = rng.integers(0, 4, (9, 9, 1))
    assert ((png.decode(file(px, 0, 2, extra=[(b"tRNS", b"\0\2")], rng=rng))[..., 3] == 0) == (px[..., 0] == 2)).all()
    table = np.arange(12, dtype=np.uint8)
    got = png.decode(file(px, 3, 2, extra=[(b"PLTE", table.tobytes()), (b"tRNS", b"\x07\x08")], rng=rng))
    assert (got[..., 3] == np.array([7, 8, 255, 255])[px[..., 0]]).all()
    px = rng.integers(0, 256, (60, 40, 3))
    got = images.decode(file(px, 2, 8, rng=rng, cut=2000))
    assert (got[:30] == px[:30]).all() and got.shape == (60, 40, 3)
    assert images.decode(png.MAGIC + b"\0\0\0\5broke") is None


def test_a_megapixel_takes_seconds_at_most():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (1000, 1, 3001), np.uint8).reshape(1000, 3001)
    start = time.perf_counter()
    png.unfiltered(rng.integers(0, 5, 1000), rows[:, 1:].reshape(1000, 1000, 3))
    assert time.perf_counter() - start < 5


def test_dimensions_of_other_formats():
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xff\xc2\0\x0b\x08" + struct.pack(">HH", 7, 9) + b"\0" * 8
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (10).to_bytes(3, "little") + (20).to_bytes(3, "little")
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 3 | 4 << 14)
    lossy = b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 12, 13)
    assert [images.dimensions(d) for d in (b"GIF89a" + struct.pack("<HH", 3, 4), bmp, jpeg, webp, lossless, lossy, b"", None, b"\xff\xd8", b"text")] == [(3, 4), (5, 6), (9, 7), (11, 21), (4, 5), (12, 13), None, None, None, None]
