"""Image arrays: decoding, grey levels, resampling, perceptual hashes and similarity, in NumPy.

Images come as uint8 arrays (height, width, 3) in RGB order. ``decode`` reads PNG from bytes itself (``png``); other
formats go through Pillow where it is installed, JPEG at a reduced scale where that suffices. Spark's
``image`` source decodes what the JVM can and gives BGR bytes (``from_row``). What can't be read is None.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tagloom.functions import png

MAX_SIDE = 4096


def decode(data: bytes, *, hard_pixels: int | None = None, max_side: int = MAX_SIDE) -> np.ndarray | None:
    """RGB of an image file: alpha over white, no side above ``max_side``; None if unreadable or above ``hard_pixels``."""
    try:
        got = _png(bytes(data), hard_pixels) if bytes(data[:8]) == png.MAGIC else _pillow(bytes(data), hard_pixels, max_side)
    except Exception:  # noqa: BLE001  whatever is wrong with a file, it is unreadable
        return None
    if got is None:
        return None
    h, w = got.shape[:2]
    if max(h, w) > max_side:
        k = max_side / max(h, w)
        got = np.rint(resize(got.astype(np.float64), max(1, round(h * k)), max(1, round(w * k)), "box")).clip(0, 255).astype(np.uint8)
    return got


def _pillow(data: bytes, hard_pixels: int | None, max_side: int) -> np.ndarray | None:
    from PIL import Image, ImageFile, ImageOps

    ImageFile.LOAD_TRUNCATED_IMAGES = True
    im = Image.open(io.BytesIO(data))
    if hard_pixels is not None and im.width * im.height > hard_pixels:
        return None
    if im.format == "JPEG":
        im.draft("RGB", (max_side, max_side))
    im = ImageOps.exif_transpose(im).convert("RGBA")
    return over_white(np.asarray(im))


def over_white(rgba: np.ndarray) -> np.ndarray:
    a = rgba[..., 3:].astype(np.float64) / 255
    return np.rint(rgba[..., :3] * a + 255 * (1 - a)).astype(np.uint8)


def _png(data: bytes, hard_pixels: int | None) -> np.ndarray | None:
    w, h = png.size(data)
    if hard_pixels is not None and w * h > hard_pixels:
        return None
    rgba = png.decode(data)
    return rgba[..., :3].copy() if (rgba[..., 3] == 255).all() else over_white(rgba)


def dimensions(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, GIF, BMP, JPEG or WebP file, without decoding; None for anything else."""
    d = bytes(data or b"")
    try:
        if d.startswith(png.MAGIC):
            return png.size(d)
        if d[:4] == b"GIF8":
            return struct.unpack_from("<HH", d, 6)
        if d[:2] == b"BM":
            w, h = struct.unpack_from("<ii", d, 18)
            return w, abs(h)
        if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
            return _webp(d)
        if d[:2] == b"\xff\xd8":
            return _jpeg(d)
    except (struct.error, IndexError):
        pass
    return None


def _webp(d: bytes) -> tuple[int, int] | None:
    if d[12:16] == b"VP8X":
        return int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1
    if d[12:16] == b"VP8L":
        (v,) = struct.unpack_from("<I", d, 21)
        return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1
    w, h = struct.unpack_from("<HH", d, 26)
    return w & 0x3FFF, h & 0x3FFF


def _jpeg(d: bytes) -> tuple[int, int] | None:
    """The frame header's size; segments before it are stepped over."""
    at = 2
    while at + 9 <= len(d):
        if d[at] != 0xFF:
            return None
        kind = d[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", d, at + 5)
            return w, h
        else:
            at += 2 + (0 if 0xD0 <= kind <= 0xD8 or kind == 1 else struct.unpack_from(">H", d, at + 2)[0])
    return None


def encode_png(rgb: np.ndarray) -> bytes:
    """An 8-bit PNG of a grey or RGB array."""
    a = np.ascontiguousarray(rgb, np.uint8)
    color = 0 if a.ndim == 2 else 2
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def from_row(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """RGB of a row of Spark's image source (BGR or BGRA or grey bytes); None for rows that it couldn't read."""
    if height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return None
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(px, 3, -1)
    rgb = px[..., 2::-1]
    return rgb.copy() if channels == 3 else over_white(np.concatenate([rgb, px[..., 3:]], -1))


def grey(rgb: np.ndarray) -> np.ndarray:
    """ITU-R 601 luma, rounded to whole levels."""
    return np.rint(rgb[..., :3].astype(np.float64) @ [0.299, 0.587, 0.114]) if rgb.ndim == 3 else rgb.astype(np.float64)


# Radii of the resampling kernels.
_RADIUS = {"box": 0.5, "linear": 1.0, "lanczos": 3.0}


def _kernel(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "box":
        return ((x > -0.5) & (x <= 0.5)).astype(np.float64)
    if kind == "linear":
        return np.maximum(0, 1 - np.abs(x))
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _weights(n: int, m: int, kind: str) -> np.ndarray:
    """The matrix that resamples n levels to m, the kernel widened when shrinking."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / scale
    w = _kernel(x, kind) * (np.abs(x) <= _RADIUS[kind])
    empty = w.sum(1) == 0
    w[empty, np.clip(centre[empty].astype(int), 0, n - 1)] = 1
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, height: int, width: int, kind: str = "lanczos") -> np.ndarray:
    """Separable resampling of a grey or colour array."""
    a = a.astype(np.float64)
    out = np.tensordot(_weights(a.shape[0], height, kind), a, (1, 0))
    out = np.moveaxis(np.tensordot(_weights(a.shape[1], width, kind), np.moveaxis(out, 1, 0), (1, 0)), 0, 1)
    return out


def _signed(bits: np.ndarray) -> int:
    """64 bits, first most significant, as a signed integer."""
    v = int("".join("1" if b else "0" for b in bits.reshape(-1)), 2)
    return v - (1 << 64) if v >= 1 << 63 else v


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    c = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


_DCT32 = _dct(32)


def phash(rgb: np.ndarray) -> int:
    """64 low frequencies of a 32 x 32 cosine transform against the mean of the 63 beside the first."""
    low = (_DCT32 @ np.rint(resize(grey(rgb), 32, 32)).clip(0, 255) @ _DCT32.T)[:8, :8]
    return _signed(low > low.reshape(-1)[1:].mean())


def dhash(rgb: np.ndarray) -> int:
    """Whether each of 8 x 9 levels is below its right neighbour."""
    g = np.rint(resize(grey(rgb), 8, 9)).clip(0, 255)
    return _signed(g[:, 1:] > g[:, :-1])


def tile_hash(rgb: np.ndarray, grid: int = 8, tile: int = 8) -> bytes:
    """A bit for each level above its tile's mean: tiles by row and column, then levels, first bit least significant."""
    n = grid * tile
    g = np.rint(resize(grey(rgb), n, n, "linear")).reshape(grid, tile, grid, tile).transpose(0, 2, 1, 3)
    return np.packbits((g > g.mean((2, 3), keepdims=True)).reshape(-1), bitorder="little").tobytes()


def tile_distance(a: bytes, b: bytes) -> int:
    return int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())


def small_grey(rgb: np.ndarray, side: int = 128) -> np.ndarray:
    return np.rint(resize(grey(rgb), side, side, "linear")).clip(0, 255)


def mean_error(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of two arrays of levels, as a share of 255."""
    return float(np.abs(a - b).mean() / 255)


def fitted(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Scaled to cover height x width and cut in the middle."""
    h, w = rgb.shape[:2]
    k = max(height / h, width / w)
    nh, nw = max(height, round(h * k)), max(width, round(w * k))
    big = resize(grey(rgb), nh, nw)
    y, x = (nh - height) // 2, (nw - width) // 2
    return big[y : y + height, x : x + width]


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two images, the larger fitted to the smaller, over uniform windows."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    x, y = fitted(a, h, w), fitted(b, h, w)
    k = min(window, h, w)
    k -= 1 - k % 2

    def mean(z: np.ndarray) -> np.ndarray:
        s = np.pad(z, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2

    mx, my = mean(x), mean(y)
    n = k**2 / max(1, k**2 - 1)
    vx, vy, cov = n * (mean(x * x) - mx * mx), n * (mean(y * y) - my * my), n * (mean(x * y) - mx * my)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def orb_ratio(a: np.ndarray, b: np.ndarray) -> float | None:
    """Matches both ways by the fewer ORB key points, 0 if a picture has none; None where OpenCV isn't installed."""
    try:
        import cv2
    except ImportError:
        return None
    orb = cv2.ORB_create()
    (_, x), (_, y) = (orb.detectAndCompute(grey(z).astype(np.uint8), None) for z in (a, b))
    if x is None or y is None:
        return 0.0
    found = cv2.BFMatcher(cv2.NORM_HAMMING, crossCheck=True).match(x, y)
    return len(found) / max(1, min(len(x), len(y)))


def refine(a: np.ndarray | None, b: np.ndarray | None, *, least_ssim: float = 0.9, least_orb: float = 0.15) -> tuple[float | None, float | None, bool, str] | None:
    """(ssim, orb, duplicate, reason) of two pictures; None if one is unreadable."""
    if a is None or b is None:
        return None
    s, o = ssim(a, b), orb_ratio(a, b)
    if s >= least_ssim:
        return s, o, True, f"ssim {s:.3f} >= {least_ssim}"
    if o is not None and o >= least_orb:
        return s, o, True, f"orb {o:.3f} >= {least_orb}"
    return s, o, False, "below both thresholds"


def padded_square(data: object, side: int) -> np.ndarray | None:
    """A model's input: on a white square, resized, levels 0 to 255 as floats in BGR order."""
    rgb = decode(data) if isinstance(data, bytes | bytearray) else data
    if rgb is None:
        return None
    h, w = rgb.shape[:2]
    n = max(h, w)
    square = np.full((n, n, 3), 255.0)
    y, x = (n - h) // 2, (n - w) // 2
    square[y : y + h, x : x + w] = rgb
    return resize(square, side, side, "box" if n > side else "linear")[..., ::-1].astype(np.float32)


def centre_crop(rgb: np.ndarray, side: int, mean: tuple[float, ...] = (0.5, 0.5, 0.5), std: tuple[float, ...] = (0.5, 0.5, 0.5)) -> np.ndarray:
    """A model's input: short side resized, cut in the middle, normalised, channels first."""
    h, w = rgb.shape[:2]
    k = side / min(h, w)
    big = resize(rgb, max(side, round(h * k)), max(side, round(w * k)), "linear")
    y, x = (big.shape[0] - side) // 2, (big.shape[1] - side) // 2
    return ((big[y : y + side, x : x + side] / 255 - mean) / std).transpose(2, 0, 1).astype(np.float32)


# ---------------------------------------------------------------- over DataFrames


def signatures(contents: DataFrame) -> DataFrame:
    """file_id, phash_u64, dhash_u64 of readable images (file_id, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, phash(a), dhash(a)) for i, d in zip(f["file_id"], f["content"], strict=True) if d is not None and (a := decode(d)) is not None]
            yield pd.DataFrame(rows, columns=["file_id", "phash_u64", "dhash_u64"]).astype("int64")

    return contents.select("file_id", "content").mapInPandas(run, "file_id bigint, phash_u64 bigint, dhash_u64 bigint")


def missing_signatures(contents: DataFrame, stored: DataFrame, *, force: bool = False) -> DataFrame:
    """Signatures of the images that have none stored yet, or of all with ``force``."""
    return signatures(contents if force else contents.join(stored.select("file_id"), "file_id", "left_anti"))


def thumbnail_key(path: str, size: int, mtime: float, side: int, mode: str = "RGB", kind: str = "png") -> str:
    """The name under which a picture's thumbnail is cached; another size, time or form gives another."""
    return hashlib.sha1(f"{path}|{size}|{mtime:.6f}|{side}x{side}|{mode}|{kind}".encode()).hexdigest()


def thumbnail_key_column(side: int, mode: str = "RGB", kind: str = "png"):
    """``thumbnail_key`` of the columns path, size and mtime."""
    from pyspark.sql import functions as F

    return F.sha1(F.format_string(f"%s|%d|%.6f|{side}x{side}|{mode}|{kind}", "path", "size", "mtime"))


def thumbnails(contents: DataFrame, side: int = 256) -> DataFrame:
    """file_id and a PNG no side of which exceeds ``side``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, d in zip(f["file_id"], f["content"], strict=True):
                a = decode(d, max_side=side) if d is not None else None
                if a is not None:
                    out.append((i, encode_png(a)))
            yield pd.DataFrame(out, columns=["file_id", "png"])

    return contents.select("file_id", "content").mapInPandas(run, "file_id bigint, png binary")


def refine_clusters(members: DataFrame, contents: DataFrame, *, how: str = "tile", limit: float = 8, grid: int = 8, tile: int = 8) -> DataFrame:
    """Members of clusters that are close to their keeper by tile hashes (bits) or pixels (mean error); groups below 2 go.

    A digest of every image is made once and written; members meet their keeper's digest by a join and clusters are counted
    before they meet their members, so no group is gathered.
    """
    from pyspark.sql import functions as F

    from tagloom.operators.components import materialised

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, d in zip(f["id"], f["content"], strict=True):
                a = decode(d) if d is not None else None
                if a is not None:
                    out.append((i, tile_hash(a, grid, tile) if how == "tile" else small_grey(a).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "digest"])

    digests = members.select("id").join(contents.select(F.col("file_id").alias("id"), "content"), "id").mapInPandas(run, "id bigint, digest binary")
    rows = materialised(members.join(digests, "id"), "digests")
    keeper = rows.filter("is_keeper = 1").select("cluster", F.col("digest").alias("of"))

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        """Of all rows of a batch at once: digests have one length."""
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (a, b))
        if how == "tile":
            return pd.Series(np.bitwise_count(x ^ y).sum(1).astype(float))
        return pd.Series(np.abs(x.astype(np.int16) - y).mean(1) / 255)

    near = rows.join(keeper, "cluster").withColumn("distance", distance("digest", "of")).filter(F.col("distance") <= limit).drop("digest", "of")
    near = materialised(near, "near")
    several = near.groupBy("cluster").count().filter("count > 1").select("cluster")
    return near.join(several, "cluster", "left_semi")


def refined_pairs(pairs: DataFrame, contents: DataFrame, *, least_ssim: float = 0.9, least_orb: float = 0.15) -> DataFrame:
    """a, b, ssim, orb, is_duplicate, reason of pairs (a, b); nulls where an image is unreadable."""
    from pyspark.sql import functions as F

    rows = pairs.select("a", "b").join(contents.select(F.col("file_id").alias("a"), F.col("content").alias("x")), "a", "left").join(contents.select(F.col("file_id").alias("b"), F.col("content").alias("y")), "b", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b, x, y in zip(f["a"], f["b"], f["x"], f["y"], strict=True):
                got = refine(*(decode(z) if z is not None else None for z in (x, y)), least_ssim=least_ssim, least_orb=least_orb)
                out.append((a, b, *(got or (None, None, None, None))))
            yield pd.DataFrame(out, columns=["a", "b", "ssim", "orb", "is_duplicate", "reason"])

    return rows.mapInPandas(run, "a bigint, b bigint, ssim double, orb double, is_duplicate boolean, reason string")
