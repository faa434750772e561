"""Detectors as table functions: images in, rows of keypoints, lines or ellipses out, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crestline.functions import geometry as G
from crestline.functions import kernels as K
from crestline.functions.images import pixels
from crestline.schemas import ELLIPSES, KEYPOINTS, LINES

#: The size that a corner's patch has.
PATCH = 7


def _table(images: DataFrame, schema: str, rows: Callable[[np.ndarray], Iterator[tuple]]) -> DataFrame:
    """Rows (after image_id) that a detector gives for each image; images that could not be read give none."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i and i["data"] and i["height"] and i["width"]:
                    out += [(key, *r) for r in rows(K.gray(pixels(i["height"], i["width"], i["nChannels"], i["data"])))]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)

    empty = images.sparkSession.createDataFrame([], schema)
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[t]) for n, t in empty.dtypes])
    return images.select("image_id", "image").mapInArrow(run, schema)


def corners(images: DataFrame, threshold: int = 15, least_circularity: float = 0.4, detector: str = "fast") -> DataFrame:
    """Corners whose thresholded patch is round enough; one whose roundness fails to compute is kept."""

    def rows(g: np.ndarray):
        h, w = g.shape
        half, n = PATCH // 2, 0
        for x, y in K.fast(g, threshold).tolist():
            if x < half or y < half or x >= w - half or y >= h - half:
                continue
            try:
                c, failed = K.circularity(g, x, y, PATCH), False
            except (ValueError, ArithmeticError):
                c, failed = None, True
            if failed or (c is not None and c >= least_circularity):
                yield detector, n, float(x), float(y), float(PATCH), c, failed
                n += 1

    return _table(images, KEYPOINTS, rows)


def lines(images: DataFrame, low: float = 50.0, high: float = 150.0, threshold: int = 100, least: float = 20.0, gap: float = 10.0) -> DataFrame:
    """Line segments of the edges."""
    return _table(images, LINES, lambda g: ((i, *s) for i, s in enumerate(K.hough_segments(K.canny(g, low, high), threshold, least, gap))))


def ellipses(images: DataFrame, low: float = 100.0, high: float = 200.0, **limits) -> DataFrame:
    """Ellipses fitted to the outer contours of the blurred image's edges that pass the candidate limits."""

    def rows(g: np.ndarray):
        n = 0
        for c in K.contours(K.canny(K.gaussian(g), low, high)):
            if (e := K.fit_ellipse(c)) is not None:
                yield n, *e, float(np.pi * e[2] * e[3]), len(c)
                n += 1

    found = _table(images, ELLIPSES, rows)
    return found.where(G.candidate(found.points, found.w, found.h, **limits))
