"""Ellipses, boxes, circularity and line segments as column expressions.

An ellipse has columns cx, cy, w, h (full axis lengths) and angle in degrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    """Cut to a whole number, towards 0."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def inside(x: Column, y: Column, cx: Column, cy: Column, w: Column, h: Column, angle: Column, width: Column, height: Column) -> Column:
    """Whether the point, cut to whole pixels, lies in the image and in the rotated ellipse."""
    px, py = whole(x), whole(y)
    t = F.radians(angle)
    dx, dy = px - cx, py - cy
    half = lambda c: F.when(c != 0, c / 2)  # noqa: E731 - no point lies in an ellipse without an axis
    along, across = (dx * F.cos(t) + dy * F.sin(t)) / half(w), (dy * F.cos(t) - dx * F.sin(t)) / half(h)
    return (px >= 0) & (px < width) & (py >= 0) & (py < height) & (along * along + across * across <= 1)


def finite(*cs: Column) -> Column:
    ok = F.lit(True)
    for c in cs:
        ok = ok & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def valid(w: Column, h: Column) -> Column:
    return finite(w, h) & (w > 0) & (h > 0)


def listed_area(w: Column, h: Column) -> Column:
    """pi * w * h over the full axes, as candidate filters measure (four times the true area)."""
    return F.pi() * w * h


def true_area(w: Column, h: Column) -> Column:
    return F.pi() * w * h / 4


def pixel_area(cx: Column, cy: Column, w: Column, h: Column, angle: Column, width: Column, height: Column) -> Column:
    """Whole pixels of the image that lie in the ellipse: spans of its rows, summed up without making a row or a pixel of them.

    A row's span is between the roots of the ellipse's equation; its ends are then moved by the test that inside() makes, so
    that both agree on every pixel. Null for an invalid ellipse.
    """
    t = F.radians(angle)
    cos, sin, a, b = F.cos(t), F.sin(t), F.when(w > 0, w / 2), F.when(h > 0, h / 2)
    ry = F.sqrt(F.pow(a * sin, F.lit(2)) + F.pow(b * cos, F.lit(2)))
    top, bottom = F.greatest(F.ceil(cy - ry - 1), F.lit(0)), F.least(F.floor(cy + ry + 1), (height - 1).cast("double"))
    # p x^2 + 2 q x + r <= 1 about the centre
    p = F.pow(cos / a, F.lit(2)) + F.pow(sin / b, F.lit(2))

    def held(x: Column, y: Column) -> Column:
        return inside(x, y, cx, cy, w, h, angle, width, height).cast("int")

    def span(y: Column) -> Column:
        y = y.cast("double")
        dy = y - cy
        q = dy * cos * sin * (1 / (a * a) - 1 / (b * b))
        r = F.pow(dy * sin / a, F.lit(2)) + F.pow(dy * cos / b, F.lit(2)) - 1
        root = F.sqrt(F.greatest(q * q - p * r, F.lit(0.0)))
        first, last = F.ceil(cx + (-q - root) / p).cast("double"), F.floor(cx + (-q + root) / p).cast("double")
        ends = [first + k for k in (-1, 0, 1)] + [last + k for k in (0, 1)]
        near = sum((held(x, y) for x in ends[1:]), held(ends[0], y))
        few = F.aggregate(F.sequence(first.cast("long") - 1, last.cast("long") + 1), F.lit(0), lambda n, x: n + held(x.cast("double"), y))
        return F.when(last - first >= 3, near + _between(first + 2, last - 1, width)).otherwise(F.when(last - first >= -2, few).otherwise(0)).cast("long")

    rows = F.when(top <= bottom, F.sequence(top.cast("long"), bottom.cast("long")))
    return F.when(valid(w, h) & finite(cx, cy), F.aggregate(F.coalesce(rows, F.array().cast("array<long>")), F.lit(0).cast("long"), lambda n, y: n + span(y)))


def _between(first: Column, last: Column, width: Column) -> Column:
    """Whole numbers from first to last that are columns of the image."""
    return F.greatest(F.least(last, (width - 1).cast("double")) - F.greatest(first, F.lit(0.0)) + 1, F.lit(0.0))


def candidate(points: Column, w: Column, h: Column, least_area: Column | float = 50_000.0, most_aspect: float = 10.0, least_axis: Column | float = 10.0, least_points: Column | int = 5) -> Column:
    """Whether an ellipse fitted to so many points is worth scoring."""
    long, short = F.greatest(w, h), F.least(w, h)
    return (points >= least_points) & (listed_area(w, h) >= least_area) & (w > 0) & (h > 0) & (long / F.when(short > 0, short) <= most_aspect) & (short >= least_axis)


def crop_box(cx: Column, cy: Column, w: Column, h: Column, angle: Column, width: Column, height: Column, padding: int = 100) -> Column:
    """The padded box of the ellipse, open to the image's bottom; the whole image for an invalid ellipse."""
    t = F.radians(angle)
    rx = F.sqrt(F.pow(w / 2 * F.cos(t), 2) + F.pow(h / 2 * F.sin(t), 2))
    ry = F.sqrt(F.pow(w / 2 * F.sin(t), 2) + F.pow(h / 2 * F.cos(t), 2))
    # the pixels that the ellipse covers, within the image
    left, right = F.greatest(F.ceil(cx - rx), F.lit(0)), F.least(F.floor(cx + rx), width - 1)
    top, bottom = F.greatest(F.ceil(cy - ry), F.lit(0)), F.least(F.floor(cy + ry), height - 1)
    good = finite(cx, cy, w, h) & (w > 0) & (h > 0) & (left <= right) & (top <= bottom)
    box = lambda a, b, c, d: F.struct(a.cast("int").alias("x1"), b.cast("int").alias("y1"), c.cast("int").alias("x2"), d.cast("int").alias("y2"))
    return F.when(good, box(F.greatest(left - padding, F.lit(0)), F.greatest(top - padding, F.lit(0)), F.least(right + padding, width), height)).otherwise(box(F.lit(0), F.lit(0), width, height))


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi area / perimeter squared; null without area or perimeter."""
    return F.when((area > 0) & (perimeter > 0), 4 * F.pi() * area / (perimeter * perimeter))


def in_bounds(x: Column, y: Column, size: Column, width: Column, height: Column) -> Column:
    """Whether a keypoint's patch can be cut out of the image."""
    px, py, half = whole(x), whole(y), F.floor(size.cast("int") / 2)
    return (px >= half) & (py >= half) & (px < width - half) & (py < height - half)


def fit_scale(w: Column, h: Column, cell_w: int = 400, cell_h: int = 300) -> Column:
    """Scale at which an image fits its grid cell with a margin; null for one without width or height."""
    return F.when((w > 0) & (h > 0), F.least(F.lit(cell_w * 0.9) / w, F.lit(cell_h * 0.8) / h))


def pieces(x1: Column, y1: Column, x2: Column, y2: Column, longest: float = 50.0) -> Column:
    """A line as an array of segments of at most `longest`, ends cut to whole pixels."""
    n = F.greatest(F.ceil(F.hypot((x2 - x1).cast("double"), (y2 - y1).cast("double")) / longest), F.lit(1)).cast("int")

    def piece(i: Column) -> Column:
        at = lambda a, b, k: whole(a + (k / n) * (b - a)).cast("int")
        return F.struct(at(x1, x2, i).alias("x1"), at(y1, y2, i).alias("y1"), at(x1, x2, i + 1).alias("x2"), at(y1, y2, i + 1).alias("y2"))

    return F.transform(F.sequence(F.lit(0), n - 1), piece)
