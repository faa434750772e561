"""Pixel operations on arrays (row-major, width and height known) as column expressions, without leaving the JVM.

Where a pixel's neighbours lie is worked out from its index, so that a plan does not grow with the
frame; width and height may be columns. Borders mirror without repeating the edge ("mirror") or repeat it ("edge").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sharpening kernels of frames and of blurred and very blurred stills, and the ring of sixteen pixels around a corner.
SHARPEN_FRAME = ((-1, -1, -1), (-1, 9, -1), (-1, -1, -1))
SHARPEN_9 = ((0, -2, 0), (-2, 9, -2), (0, -2, 0))
SHARPEN_15 = ((0, -3, 0), (-3, 15, -3), (0, -3, 0))
RING = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))
# Linear BGR to X, Y, Z by rows, and the white point.
XYZ = ((0.180423, 0.357580, 0.412453), (0.072169, 0.715160, 0.212671), (0.950227, 0.119193, 0.019334))
WHITE = (0.950456, 1.0, 1.088754)


Size = Column | int


def _col(n: Size) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def _column(i: Column, width: Size) -> Column:
    return i % width


def _row(i: Column, width: Size) -> Column:
    return ((i - i % width) / width).cast("int")


def _pixels(width: Size, height: Size) -> Column:
    """The indexes of all pixels; none for a frame without any."""
    n = (_col(width) * height).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _inside(k: Column, n: Size, border: str) -> Column:
    """The place in 0..n-1 that stands for k."""
    last = _col(n) - 1
    if border == "edge":
        return F.least(F.greatest(k, F.lit(0)), last)
    return last - F.abs(last - F.pmod(k, F.greatest(2 * last, F.lit(1))))


def neighbour(i: Column, width: Size, height: Size, dx: int, dy: int, border: str = "mirror") -> Column:
    """The index of the pixel at (dx, dy) from pixel i."""
    x = _inside(_column(i, width) + dx, width, border) if dx else _column(i, width)
    y = _inside(_row(i, width) + dy, height, border) if dy else _row(i, width)
    return (y * width + x).cast("int")


def stencil(v: Column, width: Size, height: Size, taps: list[tuple[int, int, float]], border: str = "mirror") -> Column:
    """Per pixel the weighted sum of its neighbours (dx, dy, weight)."""

    def total(i: Column) -> Column:
        out = None
        for dx, dy, w in taps:
            cell = F.get(v, neighbour(i, width, height, dx, dy, border)) * F.lit(w)
            out = cell if out is None else out + cell
        return out

    return F.transform(_pixels(width, height), total)


def saturate(v: Column) -> Column:
    """Rounded (halves to even) and cut to 0..255."""
    return F.transform(v, lambda x: F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(255.0)).cast("int"))


def filter2d(v: Column, width: Size, height: Size, kernel) -> Column:
    """Correlation with an odd square kernel, saturated."""
    n = len(kernel) // 2
    taps = [(dx - n, dy - n, float(k)) for dy, row in enumerate(kernel) for dx, k in enumerate(row) if k]
    return saturate(stencil(v, width, height, taps))


def gaussian(v: Column, width: Size, height: Size) -> Column:
    """The 5 x 5 blur."""
    k = (1, 4, 6, 4, 1)
    return filter2d(v, width, height, [[a * b / 256 for b in k] for a in k])


def median(v: Column, width: Size, height: Size, size: int) -> Column:
    """The median of each pixel's square of an odd size; the edge is repeated."""
    n = size // 2
    near = lambda i: F.array(*[F.get(v, neighbour(i, width, height, dx, dy, "edge")) for dy in range(-n, n + 1) for dx in range(-n, n + 1)])
    return F.transform(_pixels(width, height), lambda i: F.get(F.array_sort(near(i)), size * size // 2))


def turned(v: Column, width: Size, height: Size, quarters: int = 1) -> Column:
    """Turned counter-clockwise by so many quarters; odd ones exchange width and height."""
    w, h = _col(width), _col(height)
    source = {
        1: lambda i: _column(i, height) * w + (w - 1 - _row(i, height)),
        2: lambda i: w * h - 1 - i,
        3: lambda i: (h - 1 - _column(i, height)) * w + _row(i, height),
    }.get(quarters % 4)
    return v if source is None else F.transform(_pixels(width, height), lambda i: F.get(v, source(i).cast("int")))


def upright(v: Column, width: Size, height: Size) -> Column:
    """A landscape frame turned a quarter counter-clockwise, others as they are."""
    return F.when(_col(width) > height, turned(v, width, height)).otherwise(v)


def oriented(v: Column, width: Size, height: Size, exif: Column) -> Column:
    """Turned as an EXIF orientation says; mirrored and unknown ones stay as they are."""
    return F.when(exif == 3, turned(v, width, height, 2)).when(exif == 6, turned(v, width, height, 3)).when(exif == 8, turned(v, width, height, 1)).otherwise(v)


def channels(v: Column, n: int = 3) -> list[Column]:
    """Interleaved channels apart."""
    of = lambda c: F.filter(v, lambda _, i: i % n == c)
    return [of(c) for c in range(n)]


def merged(*planes: Column) -> Column:
    """Channels interleaved again, in the order given."""
    return F.flatten(F.transform(planes[0], lambda _, i: F.array(*[F.get(p, i) for p in planes])))


def gray(blue: Column, green: Column, red: Column) -> Column:
    """The gray value of a pixel, not rounded."""
    return 0.114 * blue + 0.587 * green + 0.299 * red


def lab(blue: Column, green: Column, red: Column) -> tuple[Column, Column, Column]:
    """8-bit L*a*b* of a pixel, not rounded: L scaled to 255, a and b shifted by 128."""
    linear = lambda c: F.when(c / 255 > 0.04045, F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255 / 12.92)
    parts = [linear(c) for c in (blue, green, red)]
    t = [(parts[0] * a + parts[1] * b + parts[2] * c) / w for (a, b, c), w in zip(XYZ, WHITE, strict=True)]
    f = [F.when(x > 0.008856, F.cbrt(x)).otherwise(7.787 * x + 16 / 116) for x in t]
    light = F.when(t[1] > 0.008856, 116 * f[1] - 16).otherwise(903.3 * t[1])
    return light * 255 / 100, 500 * (f[0] - f[1]) + 128, 200 * (f[1] - f[2]) + 128


def corner_scores(v: Column, width: Size, height: Size) -> Column:
    """For each pixel that has a whole ring around it, row by row: the most by which nine ring pixels in a row are all brighter or all darker."""
    w, h = _col(width), _col(height)

    def score(k: Column) -> Column:
        middle = (_row(k, w - 6) + 3) * w + _column(k, w - 6) + 3
        away = F.array(*[F.get(v, (middle + dy * w + dx).cast("int")) - F.get(v, middle.cast("int")) for dx, dy in [*RING, *RING[:8]]])
        # the ring's differences are worked out once, then read from both sides
        runs = lambda a, sign: F.array_max(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: F.array_min(F.transform(F.slice(a, j, F.lit(9)), lambda x: sign * x))))
        return F.aggregate(F.array(away), F.lit(None).cast("int"), lambda _, a: F.greatest(runs(a, F.lit(1)), runs(a, F.lit(-1))))

    inner = F.when((w > 6) & (h > 6), F.sequence(F.lit(0), ((w - 6) * (h - 6)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, score)


def patch(v: Column, width: Size, height: Size, x: Column, y: Column, size: int) -> Column:
    """The square around a point that a corner is judged by, cut at the frame's border; empty where nothing of it is left."""
    half = size // 2
    left, right = F.greatest(x - half, F.lit(0)), F.least(x + half, F.lit(width))
    top, bottom = F.greatest(y - half, F.lit(0)), F.least(y + half, F.lit(height))
    rows = F.transform(F.sequence(top, bottom - 1), lambda r: F.slice(v, (r * width + left + 1).cast("int"), (right - left).cast("int")))
    return F.when((right > left) & (bottom > top), F.flatten(rows)).otherwise(F.array().cast("array<int>"))


def resized(v: Column, width: Size, height: Size, new_width: Size, new_height: Size) -> Column:
    """Scaled bilinearly with pixel centres aligned, saturated."""

    def source(k: Column, n: Size, m: Size) -> tuple[Column, Column, Column]:
        """The pixel before, the one after, and how far it is between them."""
        p = F.least(F.greatest((k + 0.5) * n / m - 0.5, F.lit(0.0)), _col(n) - 1.0)
        low = F.floor(p).cast("int")
        return low, F.least(low + 1, _col(n) - 1), p - low

    def cell(i: Column) -> Column:
        x0, x1, fx = source(_column(i, new_width), width, new_width)
        y0, y1, fy = source(_row(i, new_width), height, new_height)
        at = lambda x, y: F.get(v, (y * width + x).cast("int"))
        return (at(x0, y0) * (1 - fx) + at(x1, y0) * fx) * (1 - fy) + (at(x0, y1) * (1 - fx) + at(x1, y1) * fx) * fy

    return saturate(F.transform(_pixels(new_width, new_height), cell))


def gradient_maxima(v: Column, width: Size, height: Size) -> Column:
    """For each pixel |gx| + |gy| where that is a maximum along the gradient's direction (to the nearest eighth turn), else 0; outside a frame it is 0."""
    across = [(s, d, float(s * (2 if d == 0 else 1))) for s in (-1, 1) for d in (-1, 0, 1)]
    gx, gy = stencil(v, width, height, across), stencil(v, width, height, [(d, s, w) for s, d, w in across])
    both = F.zip_with(gx, gy, lambda a, b: F.struct((F.abs(a) + F.abs(b)).alias("size"), F.pmod(F.round(F.atan2(b, a) / (F.pi() / 4)).cast("int"), F.lit(4)).alias("turn")))
    way_x, way_y = (F.array(*map(F.lit, c)) for c in ((1, 1, 0, -1), (0, 1, 1, 1)))

    def thin(all_: Column) -> Column:
        def near(p: Column, i: Column, sign: int) -> Column:
            x, y = _column(i, width) + sign * F.get(way_x, p["turn"]), _row(i, width) + sign * F.get(way_y, p["turn"])
            inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
            return F.coalesce(F.get(all_, F.when(inside, (y * width + x).cast("int")))["size"], F.lit(0.0))

        return F.transform(all_, lambda p, i: F.when((p["size"] > near(p, i, -1)) & (p["size"] >= near(p, i, 1)), p["size"]).otherwise(0.0))

    return F.aggregate(F.array(both), F.array().cast("array<double>"), lambda _, b: thin(b))
