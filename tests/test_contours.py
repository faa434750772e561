"""Outlines against walking around regions one step at a time; ellipses against known ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import contours as C

AROUND = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]


def outside(mask):
    """Pixels outside that nothing surrounds, by flooding from the border."""
    h, w = mask.shape
    seen, todo = np.zeros((h + 2, w + 2), bool), [(0, 0)]
    padded = np.pad(mask, 1)
    while todo:
        y, x = todo.pop()
        if 0 <= y < h + 2 and 0 <= x < w + 2 and not seen[y, x] and not padded[y, x]:
            seen[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return seen[1:-1, 1:-1], padded, seen


def walk(mask):
    """External outlines by walking around the first pixel of each region, counter-clockwise, with chains cut at equal directions."""
    h, w = mask.shape
    _, padded, free = outside(mask)
    label = np.zeros((h, w), int)
    found = []
    for y, x in np.argwhere(mask):
        if label[y, x]:
            continue
        todo = [(y, x)]
        while todo:  # the region
            a, b = todo.pop()
            if 0 <= a < h and 0 <= b < w and mask[a, b] and not label[a, b]:
                label[a, b] = len(found) + 1
                todo += [(a + dy, b + dx) for dx, dy in AROUND]
        found.append((y, x))
    out = []
    for y, x in found:
        if not free[y + 1, x]:  # what is left of its first pixel is surrounded
            continue
        at = lambda p: 0 <= p[1] < h and 0 <= p[0] < w and mask[p[1], p[0]]
        points, here, back = [], (x, y), 7  # came from the left
        start = None
        while True:
            for k in range(1, 9):  # counter-clockwise from where it came from
                d = (back - k) % 8
                p = (here[0] + AROUND[d][0], here[1] + AROUND[d][1])
                if at(p):
                    break
            else:
                points = [here]
                break
            if (here, d) == start:
                break
            start = start or (here, d)
            points.append(here)
            here, back = p, (d + 4) % 8
        n = len(points)
        step = lambda i: (points[(i + 1) % n][0] - points[i][0], points[(i + 1) % n][1] - points[i][1])  # noqa: B023, E731
        out.append([p for i, p in enumerate(points) if n == 1 or step(i) != step((i - 1) % n)])
    return out


def masks():
    rng = np.random.default_rng(11)
    out = [rng.random((12, 17)) < p for p in (0.2, 0.4, 0.5, 0.6, 0.8, 0.95)]
    y, x = np.mgrid[:40, :40]
    ring = lambda r, t: abs(np.hypot(y - 20, x - 20) - r) < t
    out += [ring(15, 2) | ring(7, 1) | ring(1, 1), np.eye(9, dtype=bool), np.ones((1, 1), bool), np.ones((6, 9), bool), np.ones((1, 7), bool), np.zeros((3, 3), bool)]
    two = np.zeros((7, 20), bool)
    two[1:6, 2:9] = True
    two[2:5, 3:8] = False
    two[3, 4], two[3, 6], two[3, 12] = True, True, True
    out.append(two)
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, int(x), int(y)) for i, m in enumerate(masks()) for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows + rows[:50], "image int, x int, y int").repartition(5)


def test_outlines_equal_walking_around_regions(table):
    got = {}
    for r in C.trace(table, "image").orderBy("image", "contour", "k").collect():
        got.setdefault((r.image, r.contour), []).append((r.x, r.y))
    want = {(i, k): c for i, m in enumerate(masks()) for k, c in enumerate(walk(m))}
    assert got == want


def test_all_outlines_hold_those_of_holes(table):
    every = C.trace(table, "image", external=False).groupBy("image").agg(F.countDistinct("contour").alias("n"))
    counts = {r.image: r.n for r in every.collect()}
    assert counts[6] == 3 + 3 and counts[12] == 1 + 1 + 2 + 1 and counts[9] == 1  # rings with their holes; a frame, its hole, two inside, one beside
    whole = C.trace(table.where("image = 9"), "image", simple=False)
    assert whole.count() == 2 * (6 + 9) - 4


@pytest.mark.parametrize("n", [1, 3, 64, 700])
def test_rounds_grow_with_the_logarithm(spark, n):
    cycle = spark.range(n).select(F.lit("a").alias("image"), (F.col("id") * 7919 % n).alias("side"), ((F.col("id") + 1) % n * 7919 % n).alias("next")) if n != 1 else spark.createDataFrame([("a", 5, 5)], "image string, side long, next long")
    got, rounds = C.ranked(cycle, "image")
    assert rounds <= math.ceil(math.log2(n)) + 2
    order = {(i * 7919) % n: i for i in range(n)} if n != 1 else {5: 0}
    assert {r.side: r.place for r in got.collect()} == order


def test_empty_masks(spark, table):
    assert C.trace(table.where("image < 0"), "image").count() == 0


def test_known_ellipses_are_found(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        cx, cy, a, b, turn = rng.uniform(-500, 2000), rng.uniform(-500, 2000), rng.uniform(3, 400), rng.uniform(3, 400), rng.uniform(0, math.pi)
        a, b = min(a, b), max(a, b) + 1
        want[k] = (cx, cy, 2 * a, 2 * b, math.degrees(turn))
        for i in range(rng.randint(5, 60)):
            t = 2 * math.pi * rng.random() if i > 4 else 1.3 * i
            rows.append((k, cx + a * math.cos(t) * math.cos(turn) - b * math.sin(t) * math.sin(turn), cy + a * math.cos(t) * math.sin(turn) + b * math.sin(t) * math.cos(turn)))
    got = {r.c: r for r in C.fit_ellipses(spark.createDataFrame(rows, "c int, x double, y double"), ["c"]).collect()}
    for k, (cx, cy, w, h, angle) in want.items():
        r = got[k]
        assert (r.cx, r.cy, r.w, r.h) == pytest.approx((cx, cy, w, h), rel=1e-4, abs=1e-3)
        assert min(abs(r.angle - angle) % 180, 180 - abs(r.angle - angle) % 180) < 0.05 * h / (h - w)


def test_noisy_circle_and_degenerate_contours(spark):
    rng = random.Random(5)
    circle = [("circle", 50 + 30 * math.cos(t / 20) + rng.gauss(0, 0.3), 70 + 30 * math.sin(t / 20) + rng.gauss(0, 0.3)) for t in range(126)]
    line = [("line", float(i), 2.0 * i) for i in range(20)]
    few = [("few", 0.0, 0.0), ("few", 1.0, 0.0), ("few", 0.0, 1.0), ("few", 1.0, 1.0)]
    point = [("point", 3.0, 3.0)] * 9
    open_ = [("open", float(i), 1.0 / i) for i in range(1, 9)] + [("open", -float(i), -1.0 / i) for i in range(1, 9)]
    got = {r.c: r for r in C.fit_ellipses(spark.createDataFrame(circle + line + few + point + open_, "c string, x double, y double"), ["c"]).collect()}
    assert (got["circle"].cx, got["circle"].cy, got["circle"].w, got["circle"].h) == pytest.approx((50, 70, 60, 60), abs=0.5)
    assert all(got[k].cx is None and got[k].w is None and got[k].angle is None for k in ("line", "few", "point", "open")) and got["few"].n_points == 4


def test_a_row_a_contour_is_dealt(spark):
    """Points are summed up where they lie: what is shuffled are partial sums."""
    df = spark.range(1000).select((F.col("id") % 3).alias("c"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = C.fit_ellipses(df, ["c"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "partial_avg" in plan and "ArrowEval" not in plan
