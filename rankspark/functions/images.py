"""Column functions on image paths, URIs and sizes."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of images.
EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]
FACTOR, MIN_PIXELS, MAX_PIXELS, MAX_RATIO = 28, 4 * 28 * 28, 16384 * 28 * 28, 200


def normalise_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def has_image_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(EXTENSIONS)


def is_svg(path: Column) -> Column:
    return F.lower(path).endswith(".svg")


def uri_kind(uri: Column) -> Column:
    """http, file, data or path."""
    return F.when(uri.startswith("http://") | uri.startswith("https://"), "http").when(uri.startswith("file://"), "file").when(uri.startswith("data:image"), "data").otherwise("path")


def uri_payload(uri: Column) -> Column:
    """What is left to open: a file's path, a data URI's base64 text, or the URI itself."""
    data = F.when(uri.contains("base64,"), F.substring_index(uri, "base64,", -1))
    return F.when(uri.startswith("file://"), F.substr(uri, F.lit(8))).when(uri.startswith("data:image"), data).otherwise(uri)


def data_uri_bytes(uri: Column) -> Column:
    return F.unbase64(F.substring_index(uri, "base64,", -1))


def round_by_factor(x: Column, factor: int) -> Column:
    """The nearest multiple; halves go to even multiples."""
    return (F.bround(x / F.lit(float(factor)), 0) * factor).cast("long")


def ceil_by_factor(x: Column, factor: int) -> Column:
    return (F.ceil(x / F.lit(float(factor))) * factor).cast("long")


def floor_by_factor(x: Column, factor: int) -> Column:
    return (F.floor(x / F.lit(float(factor))) * factor).cast("long")


def smart_resize(height: Column, width: Column, factor: int = FACTOR, min_pixels: int = MIN_PIXELS, max_pixels: int = MAX_PIXELS) -> Column:
    """struct<height, width>: multiples of factor with an area inside the bounds, the sides' ratio MAX_RATIO at most."""
    h, w = height.cast("double"), width.cast("double")
    h1, w1 = F.greatest(F.lit(factor).cast("long"), round_by_factor(h, factor)), F.greatest(F.lit(factor).cast("long"), round_by_factor(w, factor))
    shrink, grow = F.sqrt(h * w / F.lit(float(max_pixels))), F.sqrt(F.lit(float(min_pixels)) / (h * w))
    large, small = h1 * w1 > max_pixels, h1 * w1 < min_pixels
    h2 = F.when(large, floor_by_factor(h / shrink, factor)).when(small, ceil_by_factor(h * grow, factor)).otherwise(h1)
    w2 = F.when(large, floor_by_factor(w / shrink, factor)).when(small, ceil_by_factor(w * grow, factor)).otherwise(w1)
    wide = F.greatest(h2, w2).cast("double") / F.least(h2, w2) > MAX_RATIO
    out_h = F.when(wide & (h2 > w2), w2 * MAX_RATIO).otherwise(h2)
    out_w = F.when(wide & (h2 <= w2), h2 * MAX_RATIO).otherwise(w2)
    return F.struct(out_h.cast("long").alias("height"), out_w.cast("long").alias("width"))


def blank_image(width: int = 224, height: int = 224) -> bytes:
    """A white PNG, in place of an image that is missing or can't be read."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = (b"\0" + b"\xff" * (3 * width)) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")
