"""Frame measures on array<double> pixels, row-major, without leaving the JVM.

Neighbours outside a frame mirror without repeating the edge (..., 2, 1, 0, 1, 2, ...).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.functions.rasters import stencil


@dataclass(frozen=True)
class Caps:
    """Values at which each part of the quality counts in full, and the parts' weights."""

    sharpness: float = 500.0
    brightness: float = 128.0
    contrast: float = 50.0
    focus: float = 1000.0
    weights: tuple[float, float, float, float] = (0.4, 0.2, 0.2, 0.2)


def laplacian(v: Column, width: int, height: int) -> Column:
    return stencil(v, width, height, [(0, -1, 1.0), (-1, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0), (0, 0, -4.0)])


def sobel(v: Column, width: int, height: int) -> tuple[Column, Column]:
    across = [(s, d, float(s * (2 if d == 0 else 1))) for s in (-1, 1) for d in (-1, 0, 1)]
    return stencil(v, width, height, across), stencil(v, width, height, [(d, s, w) for s, d, w in across])


def mean(v: Column) -> Column:
    """Mean of an array, which is evaluated once; null for an empty one."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("total"))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["total"] + x).alias("total"))
    return F.aggregate(v, start, step, lambda a: F.when(a["n"] > 0, a["total"] / a["n"]))


def variance(v: Column) -> Column:
    """Population variance by running means and squares, so that the array is evaluated once; null for an empty one."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a: Column, x: Column) -> Column:
        m = a["m"] + (x - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), m.alias("m"), (a["s"] + (x - a["m"]) * (x - m)).alias("s"))

    return F.aggregate(v, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def focus(v: Column, width: int, height: int) -> Column:
    """Mean squared gradient."""
    gx, gy = sobel(v, width, height)
    return mean(F.zip_with(gx, gy, lambda a, b: a * a + b * b))


def capped(value: Column, cap: float) -> Column:
    """min(value / cap, 1) where a NaN stays NaN."""
    ratio = value / F.lit(cap)
    return F.when(F.isnan(ratio), ratio).otherwise(F.least(ratio, F.lit(1.0)))


def score(sharpness: Column, brightness: Column, contrast: Column, focused: Column, caps: Caps = Caps()) -> Column:
    parts = zip(caps.weights, (sharpness, brightness, contrast, focused), (caps.sharpness, caps.brightness, caps.contrast, caps.focus), strict=True)
    total = F.lit(0.0)
    for w, value, cap in parts:
        total = total + F.lit(w) * capped(value, cap)
    return total


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two frames of one size."""
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sharpness_band(variance_: Column) -> Column:
    """What a still image needs before detection, by the variance of its Laplacian (bounds are exclusive)."""
    return F.when(variance_ > 1000, "median_7").when(variance_ > 500, "median_5").when(variance_ < 50, "sharpen_15").when(variance_ < 100, "sharpen_9").otherwise("none")


def region_means(planes: list[Column], width: int, height: int, x1: int, x2: int, y2: int, rows: int = 100) -> list[Column]:
    """region_mean() of each channel."""
    return [region_mean(p, width, height, x1, x2, y2, rows) for p in planes]


def region_mean(v: Column, width: int, height: int, x1: int, x2: int, y2: int, rows: int = 100) -> Column:
    """Mean of the region under a box: rows y2 to y2 + rows, columns x1 to x2, clamped to the frame; null if that is empty."""
    last = min(y2 + rows, height)
    if y2 >= height or x1 >= min(x2, width):
        return F.lit(None).cast("double")
    cells = F.concat(*[F.slice(v, y * width + x1 + 1, min(x2, width) - x1) for y in range(y2, last)])
    return mean(cells)
