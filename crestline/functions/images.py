"""Image columns (Spark's image struct) in Arrow batches: each function maps images to images, numbers or bytes.

Keep images between the scan and the first projection that drops them; set
spark.sql.execution.arrow.maxRecordsPerBatch low (8 to 64) for large frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions import kernels as K
from crestline.schemas import IMAGE

_QUALITY = "sharpness double, brightness double, contrast double, focus double"


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The array of an image struct; alpha is dropped."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., 0] if channels == 1 else a[..., :3]


def record(a: np.ndarray, origin: str | None = None) -> tuple:
    """The image struct's fields of an array."""
    channels = 1 if a.ndim == 2 else 3
    return origin, a.shape[0], a.shape[1], channels, 0 if channels == 1 else 16, np.ascontiguousarray(a).tobytes()


def _rows(images: pd.DataFrame):
    for o, h, w, c, d in zip(images.origin, images.height, images.width, images.nChannels, images.data, strict=True):
        yield o, None if d is None or pd.isna(h) or int(h) * int(w) == 0 else pixels(int(h), int(w), int(c), d)


def _image_map(kernel: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        out = [(None,) * 6 if a is None else record(kernel(a), o) for o, a in _rows(images)]
        return pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "mode", "data"]).astype({c: "Int32" for c in ("height", "width", "nChannels", "mode")})

    return run


def preprocess(image: Column) -> Column:
    """Upright, lightness equalised, denoised, sharpened; null for an image that could not be read."""
    return _image_map(K.preprocess)(image)


def upright(image: Column) -> Column:
    return _image_map(K.upright)(image)


def gray(image: Column) -> Column:
    return _image_map(K.gray)(image)


def blurred(image: Column) -> Column:
    return _image_map(lambda a: K.gaussian(K.gray(a)))(image)


def edges(image: Column, low: float = 50.0, high: float = 150.0) -> Column:
    return _image_map(lambda a: (K.canny(K.gray(a), low, high) * 255).astype(np.uint8))(image)


def apply_band(image: Column, band: Column) -> Column:
    """The image as its sharpness band asks: median blur, sharpened, or as it is."""
    act = {"median_7": lambda a: K.median(a, 7), "median_5": lambda a: K.median(a, 5), "sharpen_15": lambda a: K.filter2d(a, K.SHARPEN_15), "sharpen_9": lambda a: K.filter2d(a, K.SHARPEN_9)}
    out = image
    for name, kernel in act.items():
        out = F.when(band == name, _image_map(kernel)(F.when(band == name, image))).otherwise(out)
    return out


def sharpness(image: Column) -> Column:
    """Variance of the Laplacian over all channels."""

    @F.pandas_udf("double")
    def run(images: pd.DataFrame) -> pd.Series:
        return pd.Series([None if a is None else float(K.laplacian(a).var()) for _, a in _rows(images)], dtype="float64")

    return run(image)


def quality_parts(image: Column) -> Column:
    """struct<sharpness, brightness, contrast, focus> of the gray image."""

    @F.pandas_udf(_QUALITY)
    def run(images: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 4 if a is None else K.quality(a) for _, a in _rows(images)], columns=["sharpness", "brightness", "contrast", "focus"], dtype="float64")

    return run(image)


def difference(one: Column, other: Column) -> Column:
    """Mean absolute difference of two images; null if either is missing or the sizes differ."""

    @F.pandas_udf("double")
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        pairs = zip(_rows(a), _rows(b), strict=True)
        return pd.Series([None if x is None or y is None or x.shape != y.shape else float(np.abs(x.astype(int) - y).mean()) for (_, x), (_, y) in pairs], dtype="float64")

    return run(one, other)


def crop(image: Column, box: Column) -> Column:
    """The part of an image in a box struct<x1, y1, x2, y2> (ends exclusive)."""

    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (o, a), x1, y1, x2, y2 in zip(_rows(images), boxes.x1, boxes.y1, boxes.x2, boxes.y2, strict=True):
            out.append((None,) * 6 if a is None or pd.isna(x1) else record(a[int(y1) : int(y2), int(x1) : int(x2)], o))
        return pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "mode", "data"]).astype({c: "Int32" for c in ("height", "width", "nChannels", "mode")})

    return run(image, box)


def region_colour(image: Column, box: Column, rows: int = 100) -> Column:
    """struct<l, a, b>: mean Lab colour of the strip of so many rows under a box; null for no box or an empty strip."""

    @F.pandas_udf("l double, a double, b double")
    def run(images: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, a), x1, x2, y2 in zip(_rows(images), boxes.x1, boxes.x2, boxes.y2, strict=True):
            part = None if a is None or a.ndim == 2 or pd.isna(x1) else a[int(y2) : int(y2) + rows, int(x1) : int(x2)]
            out.append((None,) * 3 if part is None or not part.size else tuple(K.to_lab(part).reshape(-1, 3).mean(0)))
        return pd.DataFrame(out, columns=["l", "a", "b"], dtype="float64")

    return run(image, box)


def png(a: np.ndarray) -> bytes:
    """An image as a PNG file."""
    rgb = a if a.ndim == 2 else a[..., ::-1]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    lines = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), np.ascontiguousarray(rgb).reshape(a.shape[0], -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def as_png(image: Column) -> Column:
    @F.pandas_udf("binary")
    def run(images: pd.DataFrame) -> pd.Series:
        return pd.Series([None if a is None else png(a) for _, a in _rows(images)], dtype=object)

    return run(image)


def exif_orientation(content: bytes | None) -> int | None:
    """The orientation tag of a JPEG file; None where there is none."""
    at = 2
    if not content or content[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            tiff = content[at + 10 : at + 2 + size]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                first = struct.unpack_from(order + "I", tiff, 4)[0]
                for i in range(struct.unpack_from(order + "H", tiff, first)[0]):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, first + 2 + 12 * i)
                    if tag == 0x0112:
                        return value
            except struct.error:
                return None
        at += 2 + size
    return None


def orient(image: Column, orientation: Column) -> Column:
    """Images turned by their EXIF orientation."""

    @F.pandas_udf(IMAGE)
    def run(images: pd.DataFrame, turns: pd.Series) -> pd.DataFrame:
        out = [(None,) * 6 if a is None else record(K.oriented(a, None if pd.isna(t) else int(t)), o) for (o, a), t in zip(_rows(images), turns, strict=True)]
        return pd.DataFrame(out, columns=["origin", "height", "width", "nChannels", "mode", "data"]).astype({c: "Int32" for c in ("height", "width", "nChannels", "mode")})

    return run(image, orientation)
