"""Local equalisation and lines of an image against NumPy and plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from crestline.operators import equalise as E
from crestline.operators import rasters as T


def plain(a, tiles, limit):
    h, w = a.shape
    tw, th = -(-w // tiles[0]), -(-h // tiles[1])
    p = np.pad(a, ((0, th * tiles[1] - h), (0, tw * tiles[0] - w)), mode="reflect")
    area = tw * th
    most = max(int(limit * area / 256), 1) if limit > 0 else area
    maps = np.zeros((tiles[1], tiles[0], 256))
    for j in range(tiles[1]):
        for i in range(tiles[0]):
            hist = np.bincount(p[j * th : (j + 1) * th, i * tw : (i + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(hist - most, 0).sum())
            hist = np.minimum(hist, most) + over // 256
            rest = over % 256
            if rest:
                step = max(256 // rest, 1)
                for k in range(0, 256, step):
                    if rest:
                        hist[k] += 1
                        rest -= 1
            maps[j, i] = np.minimum(np.rint(np.cumsum(hist) * (255.0 / area)), 255)
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            fx, fy = x / tw - 0.5, y / th - 0.5
            x1, y1 = math.floor(fx), math.floor(fy)
            ax, ay = fx - x1, fy - y1
            clip = lambda k, n: min(max(k, 0), n - 1)
            m = lambda j, i: maps[clip(j, tiles[1]), clip(i, tiles[0]), a[y, x]]  # noqa: B023, E731
            out[y, x] = np.rint((m(y1, x1) * (1 - ax) + m(y1, x1 + 1) * ax) * (1 - ay) + (m(y1 + 1, x1) * (1 - ax) + m(y1 + 1, x1 + 1) * ax) * ay)
    return out


@pytest.mark.parametrize("tiles, limit", [((8, 8), 2.0), ((3, 5), 40.0), ((1, 1), 0.0)])
def test_equalised_frames(spark, tiles, limit):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:90, :131]
    frames = {0: np.clip(60 + 40 * np.sin(x / 20) + rng.integers(-9, 10, x.shape), 0, 255).astype(int), 1: np.full(x.shape, 7), 2: rng.integers(0, 256, x.shape)}
    rows = [(k, int(i), int(j), int(f[j, i])) for k, f in frames.items() for j, i in np.ndindex(f.shape)]
    got = E.equalised(spark.createDataFrame(rows, "k int, x int, y int, v int"), "k", 131, 90, tiles, limit)
    found = {k: np.full(x.shape, -1) for k in frames}
    for r in got.collect():
        found[r.k][r.y, r.x] = r.equalised
    for k, f in frames.items():
        assert (found[k] == plain(f, tiles, limit)).all()


def votes_of(points):
    rho = lambda x, y, t: math.floor(x * math.cos(math.radians(t)) + y * math.sin(math.radians(t)) + 0.5 + 1e-7)
    return Counter((t, rho(x, y, t)) for x, y in points for t in range(180)), rho


def test_many_lines_take_their_points_away(spark):
    rng = random.Random(4)
    images = {"two": [(i, 2 * i + 3) for i in range(40)] + [(i, 90 - i) for i in range(60)] + [(5, 50)], "noise": [(rng.randrange(60), rng.randrange(60)) for _ in range(150)], "one": [(3, 3)]}
    rows = [(k, *p) for k, v in images.items() for p in v]
    lines, owned = T.many_lines(spark.createDataFrame(rows + rows[:9], "image string, x int, y int").repartition(3), "image", 6, 5)
    want, kept = [], {}
    for k, points in images.items():
        left = set(points)
        for n in range(5):
            votes, rho = votes_of(left)
            if not votes or max(votes.values()) < 6:
                break
            (t, r), v = min(votes.items(), key=lambda x: (-x[1], x[0]))
            want.append((k, n, t, r, v))
            kept[k, n] = {p for p in left if rho(*p, t) == r}
            left -= kept[k, n]
    assert sorted((r.image, r.line, r.theta, r.rho, r.votes) for r in lines.collect()) == sorted(want) and sum(k == "two" for k, *_ in want) >= 2
    got: dict = {}
    for r in owned.collect():
        got.setdefault((r.image, r.line), set()).add((r.x, r.y))
    assert got == kept
    segments = T.owned_segments(owned, lines, "image", least=20.0, gap=6.0).where("image = 'two' AND line < 2").collect()
    assert {(r.line, r.segment) for r in segments} == {(0, 0), (1, 0)} and all(r.n >= 35 for r in segments)


def test_no_points_no_lines(spark):
    lines, owned = T.many_lines(spark.createDataFrame([], "image string, x int, y int"), "image", 3, 4)
    assert lines.count() == owned.count() == 0 and lines.columns == ["image", "line", "theta", "rho", "votes"]
