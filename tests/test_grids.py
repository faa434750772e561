"""The grids of the spatial join, and pixels of an ellipse counted by rows, against looking at everything."""

import math
import random

from pyspark.sql import functions as F

from crestline.functions import geometry as G
from crestline.operators import features

W, H = 640, 360
ELLIPSES = "image_id string, ord int, cx double, cy double, w double, h double, angle double"


def some(rng, n):
    out = []
    for k in range(n):
        size = rng.choice([2, 9, 60, 500, 3000])
        out.append((f"i{k % 3}", k, rng.uniform(-200, 900), rng.uniform(-200, 600), rng.uniform(0.3, size), rng.uniform(0.3, size), rng.uniform(-90, 270)))
    return [*out, ("i0", n, 320.0, 180.0, 1e6, 1e6, 0.0), ("i1", n + 1, 10.0, 10.0, 0.0, 5.0, 0.0), ("i1", n + 2, float("nan"), 10.0, 4.0, 5.0, 0.0), ("i2", n + 3, 50.0, 50.0, 20.0, 20.0, 0.0), ("i2", n + 4, 0.0, 0.0, 12.0, 12.0, 0.0)]


def holds(e, x, y):
    _, _, cx, cy, w, h, angle = e
    if not (w > 0 and h > 0 and 0 <= x < W and 0 <= y < H) or math.isnan(cx):
        return False
    t = math.radians(angle)
    return ((x - cx) * math.cos(t) + (y - cy) * math.sin(t)) ** 2 / (w / 2) ** 2 + ((y - cy) * math.cos(t) - (x - cx) * math.sin(t)) ** 2 / (h / 2) ** 2 <= 1


def test_all_grids_give_the_same_hits(spark):
    rng = random.Random(1)
    e = some(rng, 200)
    points = [(f"i{k % 3}", k, rng.uniform(-5, W + 5), rng.uniform(-5, H + 5)) for k in range(400)]
    want = {(a[1], p[1]) for a in e for p in points if a[0] == p[0] and holds(a, int(p[2]), int(p[3]))}
    ellipses, table = spark.createDataFrame(e, ELLIPSES), spark.createDataFrame(points, "image_id string, k int, x double, y double")
    for cell in (None, 4.0, 16.0, 256.0, 5000.0):
        got = features.hits(table, ellipses, F.lit(W), F.lit(H), cell).select("ord", "k").collect()
        assert len(got) == len(set(got)) and {(r.ord, r.k) for r in got} == want


def test_an_ellipse_of_any_size_has_four_cells_at_most(spark):
    e = spark.createDataFrame(some(random.Random(2), 500), ELLIPSES)
    for cell in (1.0, 16.0, 256.0):
        cells = features.cells_of(e.where(G.valid(F.col("w"), F.col("h"))), F.lit(W), F.lit(H), cell).groupBy("ord").agg(F.count("*").alias("n"), F.max("__level").alias("level"))
        assert cells.agg(F.max("n")).first()[0] <= 4 and cells.agg(F.max("level")).first()[0] <= math.ceil(math.log2(W / cell))


def test_pixel_areas_equal_counting_pixels(spark):
    rng = random.Random(3)
    e = some(rng, 60)
    area = G.pixel_area(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")), F.lit(W), F.lit(H))
    got = {r.ord: r.n for r in spark.createDataFrame(e, ELLIPSES).select("ord", area.alias("n")).collect()}
    for a in e:
        if not (a[4] > 0 and a[5] > 0) or math.isnan(a[2]):
            assert got[a[1]] is None
            continue
        reach = max(a[4], a[5]) / 2 + 1
        box = [range(max(0, math.floor(c - reach)), min(n, math.ceil(c + reach) + 1)) for c, n in ((a[2], W), (a[3], H))]
        assert got[a[1]] == sum(holds(a, x, y) for x in box[0] for y in box[1]), a
