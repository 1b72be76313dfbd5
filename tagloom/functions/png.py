"""PNG files to arrays in NumPy: every depth, colour type, transparency and interlacing.

Filters that need the pixel to the left are undone along diagonals: all pixels of one diagonal only need the two diagonals
before it, so a picture takes as many NumPy steps as it has rows and columns together. Truncated files are read as far as
they go; the rest is black, as in other readers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
# Samples a pixel by colour type; column and row starts and steps of the seven interlaced passes.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """The chunks by kind; those of image data joined."""
    found: dict[bytes, list[bytes]] = {}
    at = len(MAGIC)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        found.setdefault(kind, []).append(data[at + 8 : at + 8 + size])
        at += size + 12
        if kind == b"IEND":
            break
    return {k: b"".join(v) if k == b"IDAT" else v[0] for k, v in found.items()}


def _inflated(body: bytes, size: int) -> np.ndarray:
    """The first ``size`` bytes that the stream holds, zeros where it ends or breaks off."""
    stream, out = zlib.decompressobj(), b""
    try:
        out = stream.decompress(body, size)
    except zlib.error:
        stream = zlib.decompressobj()
        parts = []
        try:
            for i in range(0, len(body), 1024):
                parts.append(stream.decompress(body[i : i + 1024], max(1, size - sum(map(len, parts)))))
        except zlib.error:
            pass
        out = b"".join(parts)
        if not out:
            raise
    got = np.zeros(size, np.uint8)
    got[: len(out)] = np.frombuffer(out, np.uint8)[:size]
    return got


def unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Rows x pixels x bytes with each row's filter undone."""
    h, w, n = lines.shape
    if not (kinds >= 3).any():
        out = np.empty_like(lines)
        above = np.zeros((w, n), np.uint8)
        for y in range(h):
            line = lines[y]
            out[y] = above = np.cumsum(line, 0, dtype=np.uint8) if kinds[y] == 1 else line + above if kinds[y] == 2 else line
        return out
    out = np.zeros((h, w, n), np.uint8)
    # last[y + 1] is row y's pixel on the diagonal before, last2 on the one before that; place 0 is the row above the first.
    last, last2 = (np.zeros((h + 1, n), np.uint8) for _ in range(2))
    sub, up, mean, paeth = (kinds == k for k in (1, 2, 3, 4))
    for d in range(h + w - 1):
        a, b = max(0, d - w + 1), min(h, d + 1)
        ys = np.arange(a, b)
        left, above, corner = last[a + 1 : b + 1], last[a:b], last2[a:b]
        wide = [z.astype(np.int16) for z in (left, above, corner)]
        guess = np.where(sub[a:b, None], left, 0).astype(np.uint8)
        guess = np.where(up[a:b, None], above, guess)
        if mean[a:b].any():
            guess = np.where(mean[a:b, None], ((wide[0] + wide[1]) >> 1).astype(np.uint8), guess)
        if paeth[a:b].any():
            by_left, by_up = np.abs(wide[1] - wide[2]), np.abs(wide[0] - wide[2])
            by_corner = np.abs(wide[0] + wide[1] - 2 * wide[2])
            best = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, above, corner))
            guess = np.where(paeth[a:b, None], best, guess)
        now = lines[ys, d - ys] + guess
        out[ys, d - ys] = now
        last, last2 = np.zeros_like(last), last
        last[a + 1 : b + 1] = now
    return out


def _samples(raw: np.ndarray, h: int, w: int, n: int, depth: int) -> tuple[np.ndarray, int]:
    """Rows x columns x samples of one pass, and how many bytes it took."""
    bits = w * n * depth
    row = (bits + 7) // 8
    rows = raw[: h * (row + 1)].reshape(h, row + 1)
    unit = max(1, n * depth // 8)
    flat = unfiltered(rows[:, 0], rows[:, 1:].reshape(h, row // unit, unit)).reshape(h, row)
    if depth == 16:
        return flat.view(">u2").reshape(h, w, n).astype(np.uint16), rows.size
    if depth == 8:
        return flat.reshape(h, w, n), rows.size
    parts = np.unpackbits(flat, axis=1)[:, :bits].reshape(h, w * n, depth)
    return (parts @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8).reshape(h, w, n), rows.size


def size(data: bytes) -> tuple[int, int]:
    """(width, height) by the header."""
    return struct.unpack_from(">II", data, 16)


def decode(data: bytes) -> np.ndarray:
    """Height x width x 4 of bytes: red, green, blue and opacity."""
    parts = _chunks(data)
    w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    n = SAMPLES[color]
    passes = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (PASSES if lace else ((0, 0, 1, 1),)) if w > x and h > y]
    raw = _inflated(parts[b"IDAT"], sum(ph * ((pw * n * depth + 7) // 8 + 1) for *_, pw, ph in passes))
    px = np.zeros((h, w, n), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x, y, dx, dy, pw, ph in passes:
        px[y::dy, x::dx], used = _samples(raw[at:], ph, pw, n, depth)
        at += used
    keyed, full = parts.get(b"tRNS"), np.full((h, w, 1), 255, np.uint8)
    if color == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[:, :3] = 0
        rgb = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[:256]
        table[: len(rgb), :3] = rgb
        if keyed is not None:
            table[: len(keyed), 3] = np.frombuffer(keyed, np.uint8)
        return table[px[..., 0]]
    if color in (0, 2) and keyed is not None:
        full[(px == np.frombuffer(keyed, ">u2")[:n]).all(-1)] = 0
    levels = (px >> 8).astype(np.uint8) if depth == 16 else px if depth == 8 else px * np.uint8(255 // ((1 << depth) - 1))
    rgb, alpha = (levels, full) if color in (0, 2) else (levels[..., :-1], levels[..., -1:])
    return np.concatenate([np.repeat(rgb, 3, -1) if rgb.shape[-1] == 1 else rgb, alpha], -1)
