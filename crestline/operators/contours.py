"""Outlines of masks and ellipses through them, as relations.

A mask is a table of its set pixels (image, x, y). Where a set pixel meets one that is not set is a side; the
side that follows it around the region is known from the pixel's eight neighbours, so that tracing is
the ranking of linked lists: windows of sides double in every round (an equi-join), until each side knows
the least side of its outline and how far it is from there. Rounds grow with the logarithm of the longest outline.

Regions are connected over corners, holes over sides. Points of an outline are its pixels, from the topmost
(of these the leftmost) on, first downwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.session import durable

#: Neighbours of a pixel by bit, clockwise from the one above.
AROUND = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))
#: Sides: above, right, below, left; a pixel's number holds its row, then its column, and the side (two bits).
ROW, COLUMN = 1 << 32, 1 << 2


def sides(mask: DataFrame, image: str) -> DataFrame:
    """image, side, next (numbers of a side and of the one that follows, clockwise around set pixels) of all sides where set pixels end.

    Repeated pixels count once. Every pixel meets its neighbours in an aggregation by place, summed up before it is dealt.
    """
    near = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.lit(256).alias("bit")), *[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(1 << k).alias("bit")) for k, (dx, dy) in enumerate(AROUND)])
    told = mask.select(image, "x", "y", F.explode(near).alias("n")).select(image, (F.col("x") + F.col("n.dx")).cast("long").alias("x"), (F.col("y") + F.col("n.dy")).cast("long").alias("y"), "n.bit")
    met = told.groupBy(image, "x", "y").agg(F.bit_or("bit").alias("near")).where(F.col("near") >= 256)
    is_set = lambda k: F.col("near").bitwiseAND(1 << (k % 8)) != 0

    def number(x: Column, y: Column, side: int) -> Column:
        return y * F.lit(ROW) + x * F.lit(COLUMN) + F.lit(side)

    found = []
    for d in range(4):
        (ax, ay), (cx, cy) = AROUND[(2 * d + 2) % 8], AROUND[(2 * d + 1) % 8]  # along the side, and across its end
        after = F.when(is_set(2 * d + 1), number(F.col("x") + cx, F.col("y") + cy, (d + 3) % 4)).when(is_set(2 * d + 2), number(F.col("x") + ax, F.col("y") + ay, d)).otherwise(number(F.col("x"), F.col("y"), (d + 1) % 4))
        found.append(F.when(~is_set(2 * d), F.struct(number(F.col("x"), F.col("y"), d).alias("side"), after.alias("next"))))
    return met.select(image, F.explode(F.array_compact(F.array(*found))).alias("s")).select(image, "s.side", "s.next")


def ranked(links: DataFrame, image: str) -> tuple[DataFrame, int]:
    """image, side, outline, place of links (image, side, next) that form cycles: the least side of its cycle and the steps from there; and the rounds it took."""
    held = durable(links.select(image, "side", "next", F.col("side").alias("least"), F.lit(0).cast("long").alias("ahead")))
    rounds, reach = 0, 1
    while True:
        other = held.select(image, F.col("side").alias("next"), F.col("next").alias("to"), F.col("least").alias("other"), (F.col("ahead") + reach).alias("further"))
        joined = held.join(other, [image, "next"])
        less = F.col("other") < F.col("least")
        held = durable(joined.select(image, "side", F.col("to").alias("next"), F.when(less, F.col("other")).otherwise(F.col("least")).alias("least"), F.when(less, F.col("further")).otherwise(F.col("ahead")).alias("ahead"), less.alias("less")))
        rounds, reach = rounds + 1, 2 * reach
        if held.where("less").isEmpty():  # windows that follow each other around a cycle have one least side: that of the whole
            break
    sizes = held.groupBy(image, "least").agg(F.count("*").alias("n"))
    place = F.pmod(F.col("n") - F.col("ahead"), F.col("n"))
    return held.join(sizes, [image, "least"]).select(image, "side", F.col("least").alias("outline"), place.alias("place")), rounds


def _x(side: Column) -> Column:
    return F.shiftright(F.pmod(side, F.lit(ROW)), 2).cast("int")


def _y(side: Column) -> Column:
    return F.floor(side / ROW).cast("int")


def outer(placed: DataFrame, image: str) -> DataFrame:
    """image, outline of the outlines that no other region surrounds.

    An outline around a region has a side above as its least, one around a hole has not. What lies next to
    the left of a region's first pixel is nothing, the outline of a hole that the region lies in, or that of
    a region in the same hole, which is asked in turn: those chains are shortened by half in every round.
    """
    right = placed.where(F.col("side") % 4 == 1).select(image, _y(F.col("side")).alias("y"), _x(F.col("side")).alias("x"), F.col("outline").alias("to"), F.lit(None).cast("long").alias("own"))
    first = placed.where((F.col("side") == F.col("outline")) & (F.col("side") % 4 == 0)).select(image, _y(F.col("side")).alias("y"), _x(F.col("side")).alias("x"), F.lit(None).cast("long").alias("to"), F.col("outline").alias("own"))
    w = Window.partitionBy(image, "y").orderBy("x", F.col("own").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    # a right side at the same x is that of the pixel itself and comes after it
    links = durable(right.unionByName(first).withColumn("left", F.last("to", ignorenulls=True).over(w)).where("own IS NOT NULL").select(image, F.col("own").alias("outline"), "left"))
    while True:
        other = links.select(image, F.col("outline").alias("left"), F.col("left").alias("further"))
        region = (F.col("left") % 4 == 0) & F.col("left").isNotNull()
        if links.where(region).isEmpty():
            return links.where("left IS NULL").select(image, "outline")
        links = durable(links.join(other, [image, "left"], "left").select(image, "outline", F.when(region, F.col("further")).otherwise(F.col("left")).alias("left")))


def trace(mask: DataFrame, image: str, external: bool = True, simple: bool = True) -> DataFrame:
    """image, contour, k, x, y: the points of outlines in order, numbered from 0; contours are numbered from 0 by their first point, row by row.

    `external` leaves outlines around regions that nothing surrounds, else all are given, those of holes too.
    `simple` leaves the points at which the direction changes. A mask without pixels has no outline.
    """
    placed = durable(ranked(sides(mask, image), image)[0])
    kept = placed.join(outer(placed, image), [image, "outline"], "left_semi") if external else placed
    w = Window.partitionBy(image, "outline").orderBy(F.desc("turned"))
    whole = Window.partitionBy(image, "outline").orderBy(F.desc("turned")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = lambda c, step, edge: F.coalesce((F.lag if step < 0 else F.lead)(c).over(w), edge(c).over(whole))
    # the first side stays in front, the others come the other way round: first downwards
    turned = kept.select(image, "outline", _x(F.col("side")).alias("x"), _y(F.col("side")).alias("y"), F.when(F.col("place") == 0, F.lit((1 << 62) * 1)).otherwise(F.col("place")).alias("turned"))
    new = (F.col("x") != around("x", -1, F.last)) | (F.col("y") != around("y", -1, F.last)) | (F.row_number().over(w) == 1)
    points = turned.withColumn("new", new).where("new")
    # the first pixel's other sides may come last: they are the same point
    points = points.withColumn("again", (F.lead("x").over(w).isNull()) & (F.row_number().over(w) > 1) & (F.col("x") == F.first("x").over(whole)) & (F.col("y") == F.first("y").over(whole))).where("NOT again")
    if simple:
        step = lambda c: around(c, 1, F.first) - F.col(c)
        before = lambda c: F.col(c) - around(c, -1, F.last)
        points = points.select("*", *[step(c).alias(f"to_{c}") for c in "xy"], *[before(c).alias(f"from_{c}") for c in "xy"], F.count("*").over(Window.partitionBy(image, "outline")).alias("n"))
        points = points.where("n = 1 OR to_x != from_x OR to_y != from_y")
    numbered = points.select(image, "outline", (F.row_number().over(w) - 1).cast("int").alias("k"), "x", "y")
    names = kept.select(image, "outline").distinct().withColumn("contour", (F.row_number().over(Window.partitionBy(image).orderBy("outline")) - 1).cast("int"))
    return numbered.join(names, [image, "outline"]).select(image, "contour", "k", "x", "y")


# --- ellipses ------------------------------------------------------------------------------

#: Powers of x and y whose sums the fit needs.
POWERS = [(i, j) for i in range(5) for j in range(5 - i)]
#: Points that an ellipse needs; a pivot below this share of its row's first is none.
LEAST, FLAT = 5, 1e-9


def _solved(m: list[list[Column]], b: list[Column], df: DataFrame, name: str) -> DataFrame:
    """Columns name0.. of the solution of a symmetric positive system, by elimination in steps of columns; null where it has none."""
    n = len(b)
    at = lambda i, j: f"{name}_m{min(i, j)}{max(i, j)}"
    df = df.select("*", *[m[i][j].alias(at(i, j)) for i in range(n) for j in range(i, n)], *[b[i].alias(f"{name}_b{i}") for i in range(n)], *[m[i][i].alias(f"{name}_d{i}") for i in range(n)])
    for k in range(n):
        pivot = F.when(F.col(at(k, k)) > FLAT * F.col(f"{name}_d{k}"), F.col(at(k, k)))
        df = df.withColumn(f"{name}_p{k}", pivot)
        changed = {at(i, j): F.col(at(i, j)) - F.col(at(k, i)) / F.col(f"{name}_p{k}") * F.col(at(k, j)) for i in range(k + 1, n) for j in range(i, n)}
        changed |= {f"{name}_b{i}": F.col(f"{name}_b{i}") - F.col(at(k, i)) / F.col(f"{name}_p{k}") * F.col(f"{name}_b{k}") for i in range(k + 1, n)}
        df = df.withColumns(changed) if changed else df
    for k in reversed(range(n)):
        rest = F.col(f"{name}_b{k}")
        for j in range(k + 1, n):
            rest = rest - F.col(at(k, j)) * F.col(f"{name}{j}")
        df = df.withColumn(f"{name}{k}", rest / F.col(f"{name}_p{k}"))
    return df.drop(*[c for c in df.columns if c.startswith(f"{name}_")])


def fit_ellipses(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_points, cx, cy, w, h, angle of the ellipse through each contour's points (x, y) by least squares; null where there is none.

    A conic is fitted to find the centre, then one about that centre for the axes: full lengths, w <= h, the
    angle of w in degrees, 0..180. Fewer than LEAST points, points of a line, and curves that do not close have none.
    Points are only summed up: powers about the contour's mean, in units of its spread, so that a row a contour is
    all that is dealt and solved.
    """
    own = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    means = own.groupBy(*keys).agg(F.count("*").alias("n_points"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("unit"))
    centred = own.join(means, keys).select(*keys, "n_points", "mx", "my", "unit", F.try_divide(F.col("x") - F.col("mx"), F.col("unit")).alias("u"), F.try_divide(F.col("y") - F.col("my"), F.col("unit")).alias("v"))
    power = lambda c, k: F.lit(1.0) if k == 0 else F.col(c) if k == 1 else F.col(c) * power(c, k - 1)
    sums = centred.groupBy(*keys, "n_points", "mx", "my", "unit").agg(*[F.sum(power("u", i) * power("v", j)).alias(f"s{i}{j}") for i, j in POWERS])
    s = lambda i, j: F.col(f"s{i}{j}")
    terms = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1)]
    df = _solved([[s(a[0] + b[0], a[1] + b[1]) for b in terms] for a in terms], [s(*a) for a in terms], sums, "q")
    # where the first conic's slope is none
    four = 4 * F.col("q0") * F.col("q2") - F.col("q1") * F.col("q1")
    closed = F.when(four > 0, four)
    df = df.select("*", ((F.col("q1") * F.col("q4") - 2 * F.col("q2") * F.col("q3")) / closed).alias("u0"), ((F.col("q1") * F.col("q3") - 2 * F.col("q0") * F.col("q4")) / closed).alias("v0"))

    def about(i: int, j: int) -> Column:
        """The sum of (u - u0)^i (v - v0)^j, from those about the mean."""
        total = F.lit(0.0)
        for a in range(i + 1):
            for b in range(j + 1):
                total = total + _choose(i, a) * _choose(j, b) * s(a, b) * F.pow(-F.col("u0"), F.lit(i - a)) * F.pow(-F.col("v0"), F.lit(j - b))
        return total

    terms = terms[:3]
    df = _solved([[about(a[0] + b[0], a[1] + b[1]) for b in terms] for a in terms], [about(*a) for a in terms], df, "r")
    mean, half = (F.col("r0") + F.col("r2")) / 2, F.hypot((F.col("r0") - F.col("r2")) / 2, F.col("r1") / 2)
    fits = (F.col("n_points") >= LEAST) & (mean - half > 0)
    axis = lambda value: F.when(fits, 2 * F.col("unit") / F.sqrt(value))
    turn = F.pmod(F.degrees(F.atan2(F.col("r1"), F.col("r0") - F.col("r2"))) / 2 + 360, F.lit(180.0))
    found = df.select(*keys, "n_points", F.when(fits, F.col("mx") + F.col("unit") * F.col("u0")).alias("cx"), F.when(fits, F.col("my") + F.col("unit") * F.col("v0")).alias("cy"), axis(mean + half).alias("w"), axis(mean - half).alias("h"), F.when(fits, turn).alias("angle"))
    # a filter on the result ends here: taken through the steps it would hold each of them many times over
    return found.select(F.inline(F.array(F.struct(*found.columns))))


def _choose(n: int, k: int) -> int:
    return 1 if k in (0, n) else _choose(n - 1, k - 1) + _choose(n - 1, k)
