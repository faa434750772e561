"""Pixel operations on a frame of 256 x 200 against NumPy, plans that do not grow with the frame, components in few rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import rasters as R
from crestline.operators import components as C
from crestline.operators import rasters as T

W, H = 256, 200


@pytest.fixture(scope="module")
def picture():
    rng = np.random.default_rng(7)
    y, x = np.mgrid[:H, :W]
    a = 90 + 60 * np.sin(x / 9) * np.cos(y / 13) + 80 * ((x - 120) ** 2 + (y - 90) ** 2 < 2500) + rng.integers(-6, 7, (H, W))
    return np.clip(a, 0, 255).astype(int)


@pytest.fixture(scope="module")
def frame(spark, picture):
    """Size in columns: frames of one table may differ."""
    small = picture[:5, :7]
    return spark.createDataFrame([(0, W, H, picture.ravel().tolist()), (1, 7, 5, small.ravel().tolist()), (2, 1, 1, [9]), (3, 0, 0, [])], "k int, w int, h int, v array<int>")


def cols():
    return F.col("v"), F.col("w"), F.col("h")


def column(frame, c):
    return [r.c for r in frame.select("k", c.alias("c")).orderBy("k").collect()]


def test_filters(frame, picture):
    def want(a, kernel):
        n = len(kernel) // 2
        p = np.pad(a, n, mode="reflect")
        out = sum(kernel[i][j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * n + 1) for j in range(2 * n + 1))
        return np.clip(np.rint(out), 0, 255).astype(int).ravel().tolist()

    gauss = [[p * q / 256 for q in (1, 4, 6, 4, 1)] for p in (1, 4, 6, 4, 1)]
    for c, kernel in ((R.filter2d(*cols(), R.SHARPEN_FRAME), R.SHARPEN_FRAME), (R.gaussian(*cols()), gauss)):
        got = column(frame, c)
        assert got[0] == want(picture, kernel) and got[1] == want(picture[:5, :7], kernel) and got[2] == [9] and got[3] == []


def test_medians(frame, picture):
    got = column(frame, R.median(*cols(), 5))
    p = np.pad(picture, 2, mode="edge")
    want = np.median(np.stack([p[i : i + H, j : j + W] for i in range(5) for j in range(5)]), axis=0).astype(int)
    assert got[0] == want.ravel().tolist() and got[2] == [9]


def test_turns_and_sizes(frame, picture):
    for q in range(4):
        assert column(frame, R.turned(*cols(), q))[0] == np.rot90(picture, q).ravel().tolist()
    assert column(frame, R.upright(*cols()))[0] == np.rot90(picture).ravel().tolist()
    got = column(frame, R.resized(*cols(), 100, 333))[0]
    px, py = np.clip((np.arange(100) + 0.5) * W / 100 - 0.5, 0, W - 1), np.clip((np.arange(333) + 0.5) * H / 333 - 0.5, 0, H - 1)
    x0, y0 = px.astype(int), py.astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, W - 1), np.minimum(y0 + 1, H - 1), px - x0, (py - y0)[:, None]
    p = picture
    want = (p[np.ix_(y0, x0)] * (1 - fx) + p[np.ix_(y0, x1)] * fx) * (1 - fy) + (p[np.ix_(y1, x0)] * (1 - fx) + p[np.ix_(y1, x1)] * fx) * fy
    assert np.abs(np.array(got).reshape(333, 100) - want).max() <= 0.5 + 1e-9


def test_corners(frame, picture):
    got = np.array(column(frame, R.corner_scores(*cols()))[0]).reshape(H - 6, W - 6)
    middle = picture[3 : H - 3, 3 : W - 3]
    away = np.stack([picture[3 + dy : H - 3 + dy, 3 + dx : W - 3 + dx] - middle for dx, dy in [*R.RING, *R.RING[:8]]])
    runs = lambda a: np.max([a[k : k + 9].min(axis=0) for k in range(16)], axis=0)
    assert (got == np.maximum(runs(away), runs(-away))).all() and (got > 15).sum() > 0


def test_edges(spark, frame, picture):
    thin = frame.where("k = 0").select("k", F.posexplode(R.gradient_maxima(*cols())).alias("i", "size"))
    p = np.pad(picture, 1, mode="reflect")
    gx = sum((2 if d == 0 else 1) * s * p[1 + d : H + 1 + d, 1 + s : W + 1 + s] for s in (-1, 1) for d in (-1, 0, 1))
    gy = sum((2 if d == 0 else 1) * s * p[1 + s : H + 1 + s, 1 + d : W + 1 + d] for s in (-1, 1) for d in (-1, 0, 1))
    size, turn = np.abs(gx) + np.abs(gy), np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    out = np.pad(size, 1)
    keep = np.zeros((H, W), bool)
    for t, (dx, dy) in enumerate(((1, 0), (1, 1), (0, 1), (-1, 1))):
        ahead, behind = out[1 + dy : H + 1 + dy, 1 + dx : W + 1 + dx], out[1 - dy : H + 1 - dy, 1 - dx : W + 1 - dx]
        keep |= (turn == t) & (size > behind) & (size >= ahead)
    placed = thin.where("size > 0").select("k", (F.col("i") % W).alias("x"), F.floor(F.col("i") / W).cast("int").alias("y"), "size")
    assert {(r.x, r.y) for r in placed.collect()} == {(x, y) for y, x in np.argwhere(keep & (size > 0))}
    low, high = 60.0, 250.0
    weak = {(x, y) for y, x in np.argwhere(keep & (size > low))}
    want, todo = set(), [(x, y) for x, y in weak if size[y, x] > high]
    while todo:
        x, y = todo.pop()
        if (x, y) in weak and (x, y) not in want:
            want.add((x, y))
            todo += [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    assert {(r.x, r.y) for r in T.edges(placed, "k", low, high).collect()} == want and 0 < len(want) < len(weak)


def test_plans_do_not_grow_with_the_frame(spark):
    def plan(w, h):
        df = spark.range(1).select(F.array(F.lit(1)).alias("v"))
        every = [R.gaussian(F.col("v"), w, h), R.median(F.col("v"), w, h, 7), R.turned(F.col("v"), w, h), R.resized(F.col("v"), w, h, w, h), R.corner_scores(F.col("v"), w, h), R.gradient_maxima(F.col("v"), w, h)]
        return df.select(*[c.alias(f"c{i}") for i, c in enumerate(every)])._jdf.queryExecution().optimizedPlan().toString()

    assert len(plan(1920, 1080)) < 1.1 * len(plan(8, 8))


def test_components_of_many_graphs(spark, monkeypatch):
    rng = random.Random(1)
    edges = [("chain", i, i + 1) for i in range(2000)] + [("star", 0, i) for i in range(1, 500)] + [("loop", 5, 5)]
    edges += [("random", rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    cuts = []
    keep = C.durable
    monkeypatch.setattr(C, "durable", lambda df: cuts.append(1) or keep(df))
    got = {(r.g, r.node): r.root for r in C.components(spark.createDataFrame(edges, "g string, a long, b long").repartition(4), "g").collect()}
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for g, a, b in edges:
        if a != b:
            x, y = sorted((find((g, a)), find((g, b))))
            root[y] = x
    assert got == {v: find(v)[1] for v in list(root)}
    assert len(cuts) <= 2 * 13  # some twelve rounds for a chain of 2,000
