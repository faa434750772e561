import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crestline.functions import geometry as G
from crestline.functions import kernels as K
from crestline.functions import quality as Q
from crestline.operators import clustering, features, frames


def values(df, *cs):
    return sorted(tuple(r) for r in df.select(*cs).collect())


def test_measures_match_numpy(spark):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, 64).astype(float), np.full(64, 7.0), np.eye(8).ravel() * 255]
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(images)], "i int, v array<double>")
    v = F.col("v")
    got = df.select("i", Q.variance(Q.laplacian(v, 8, 8)).alias("s"), Q.mean(v).alias("m"), F.sqrt(Q.variance(v)).alias("c"), Q.focus(v, 8, 8).alias("f")).orderBy("i").collect()
    for r, a in zip(got, images):
        g = a.reshape(8, 8)
        gx, gy = K.sobel(g)
        assert np.allclose([r.s, r.m, r.c, r.f], [K.laplacian(g).var(), g.mean(), g.std(), (gx**2 + gy**2).mean()])
    assert got[1].s == 0 and got[1].c == 0


def test_quality_is_capped_and_keeps_nan(spark):
    row = spark.range(1).select(Q.score(*[F.lit(1e9)] * 4).alias("full"), Q.score(*[F.lit(0.0)] * 4).alias("none"), Q.score(F.lit(float("nan")), *[F.lit(0.0)] * 3).alias("nan")).first()
    assert row.full == pytest.approx(1.0) and row.none == 0 and np.isnan(row.nan)


def test_interval_under_target_is_an_error(spark):
    df = spark.createDataFrame([(0.5,)], "fps double")
    with pytest.raises(Exception, match="fps is below"):
        df.select(frames.interval(F.col("fps"), 1.0)).collect()


def test_shots_are_exclusive_of_the_threshold_and_ties_keep_frame_order(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 1.0, 3.5, 3.5, 3.5, 3.5])] + [("b", 0, 9.0)], "video string, no int, v double")
    cut = frames.shots(frames.differences(df, "video", ["no"], lambda lag: F.abs(F.col("v") - lag("v"))), "video", ["no"], F.col("diff"), 1.0)
    assert values(cut, "video", "no", "shot_id") == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 1), ("a", 5, 1), ("b", 0, 0)]
    best = frames.best(cut, "video", "shot_id", F.col("v"), ["no"])
    assert values(best, "video", "shot_id", "rank", "no") == [("a", 0, 1, 1), ("a", 0, 2, 0), ("a", 1, 1, 2), ("a", 1, 2, 3), ("a", 1, 3, 4), ("b", 0, 1, 0)]
    assert values(frames.ranges(cut, "video", "shot_id", "no"), "video", "shot_id", "start_no", "end_no") == [("a", 0, 0, 2), ("a", 1, 2, 6), ("b", 0, 0, 1)]


def test_normalising_twice_finds_cuts_in_tiny_frames_only(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 255.0)], "video string, no int, diff double")
    shots = lambda pixels: values(frames.shots(df, "video", ["no"], F.col("diff"), 0.3, pixels=pixels), "no", "shot_id")
    assert shots(16) == [(0, 0), (1, 1)] and shots(64 * 64) == [(0, 0), (1, 0)] and shots(None) == [(0, 0), (1, 1)]


def test_no_frames(spark):
    empty = spark.createDataFrame([], "video string, no int, v double, diff double")
    assert frames.best(frames.shots(empty, "video", ["no"], F.col("diff"), 1.0), "video", "shot_id", F.col("v"), ["no"]).count() == 0


def test_size_groups(spark):
    df = spark.createDataFrame([([7, 12, 13, 18, 7, 30],), ([10, 14, 19, 24],), ([],)], "s array<int>")
    got = df.select(clustering.size_groups(F.col("s")).alias("g")).select("g", clustering.mode(F.col("g")).alias("m")).collect()
    assert [[(x.g, x.n) for x in r.g] for r in got] == [[(7, 3), (13, 2), (30, 1)], [(10, 2), (19, 2)], []]
    assert [r.m for r in got] == [7, 10, None]
    rows = spark.createDataFrame([(1, 10, 12), (2, 10, 16), (3, None, 99)], "i int, target int, size int")
    assert values(clustering.near_target(rows, F.col("size"), F.col("target")), "i") == [(1,), (3,)]


def _ellipses(spark, rows):
    return spark.createDataFrame(rows, "image_id string, ord int, cx double, cy double, w double, h double, angle double")


def test_points_in_ellipses_and_grid_agree(spark):
    rng = np.random.default_rng(3)
    e = _ellipses(spark, [("a", i, float(x), float(y), float(w), float(h), float(t)) for i, (x, y, w, h, t) in enumerate(rng.uniform(10, 90, (6, 5)))] + [("a", 9, 50.0, 50.0, 0.0, 10.0, 0.0)])
    p = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 110, (300, 2)))] + [("b", 999, 50.0, 50.0)], "image_id string, kp_id int, x double, y double")
    plain = values(features.hits(p, e, F.lit(100), F.lit(100)), "ord", "kp_id")
    assert plain == values(features.hits(p, e, F.lit(100), F.lit(100), cell=7.0), "ord", "kp_id") and plain
    want = set()
    for o in e.collect():
        for q in p.collect():
            x, y, t = int(q.x), int(q.y), np.radians(o.angle)
            dx, dy = x - o.cx, y - o.cy
            if q.image_id == o.image_id and o.w > 0 and 0 <= x < 100 and 0 <= y < 100 and ((dx * np.cos(t) + dy * np.sin(t)) / (o.w / 2)) ** 2 + ((dy * np.cos(t) - dx * np.sin(t)) / (o.h / 2)) ** 2 <= 1:
                want.add((o.ord, q.kp_id))
    assert set(plain) == want


def test_best_ellipse_prefers_score_then_order_and_falls_back(spark):
    e = _ellipses(spark, [("a", 0, 50.0, 50.0, 30.0, 30.0, 0.0), ("a", 1, 50.0, 50.0, 30.0, 30.0, 0.0), ("b", 0, 20.0, 20.0, 10.0, 10.0, 0.0), ("b", 1, 20.0, 20.0, 20.0, 10.0, 0.0), ("b", 2, 0.0, 0.0, float("nan"), 10.0, 0.0)])
    p = spark.createDataFrame([("a", "surf", 50.0 + i, 50.0) for i in range(4)] + [("a", "line", 50.0, 51.0)], "image_id string, kind string, x double, y double")
    scored = features.scores(e, p, F.lit(100), F.lit(100))
    assert values(scored, "image_id", "ord", "n_hits", "n_surf") == [("a", 0, 5, 4), ("a", 1, 5, 4), ("b", 0, 0, 0), ("b", 1, 0, 0)]
    best = features.best_ellipse(scored)
    assert values(best, "image_id", "ord", "fallback") == [("a", 0, False), ("b", 1, True)]
    assert values(features.compare(scored, best), "image_id", "ord", "is_best") == [("a", 0, True), ("a", 1, False), ("b", 0, False), ("b", 1, True)]


def test_crop_box_is_open_below(spark):
    e = _ellipses(spark, [("a", 0, 50.0, 40.0, 20.0, 10.0, 0.0), ("a", 1, 50.0, 40.0, -1.0, 10.0, 0.0), ("a", 2, 500.0, 40.0, 20.0, 10.0, 0.0)])
    box = G.crop_box(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")), F.lit(100), F.lit(80), padding=5)
    got = {r.ord: tuple(r.b) for r in e.select("ord", box.alias("b")).collect()}
    assert got == {0: (35, 30, 65, 80), 1: (0, 0, 100, 80), 2: (0, 0, 100, 80)}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 255))
def test_kernels_on_constants(h, w, c):
    a = np.full((h, w), c, np.uint8)
    assert not K.laplacian(a).any() and (K.gaussian(a) == c).all() and (K.median(a, 5) == c).all() and not K.canny(a, 50, 150).any()
    assert (np.rot90(a, 4) == a).all() and len(K.fast(a, 15)) == 0


def test_ellipse_fit_from_contour():
    y, x = np.mgrid[0:200, 0:300]
    t = np.radians(30)
    mask = (((x - 150) * np.cos(t) + (y - 100) * np.sin(t)) / 80) ** 2 + ((-(x - 150) * np.sin(t) + (y - 100) * np.cos(t)) / 40) ** 2 <= 1
    (contour,) = K.contours(mask)
    cx, cy, w, h, angle = K.fit_ellipse(contour)
    assert (cx, cy) == pytest.approx((150, 100), abs=0.5) and sorted((w, h)) == pytest.approx([80, 160], abs=2) and angle == pytest.approx(120, abs=1)
    assert K.area(contour) == pytest.approx(np.pi * 80 * 40, rel=0.03)
    assert K.fit_ellipse(np.array([[i, i] for i in range(9)])) is None


def test_lines_and_lab():
    edges = np.zeros((100, 100), bool)
    edges[50, 5:95] = True
    assert K.hough_segments(edges, 40) == [(94, 50, 5, 50)] or K.hough_segments(edges, 40) == [(5, 50, 94, 50)]
    grays = np.repeat(np.arange(0, 256, 5, dtype=np.uint8)[:, None, None], 3, 2)
    lab = K.to_lab(grays)
    assert np.abs(lab[..., 1:].astype(int) - 128).max() <= 1 and np.abs(K.from_lab(lab.astype(float)).astype(int) - grays).max() <= 2
