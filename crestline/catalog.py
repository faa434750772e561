"""The registered queries of the frame library over the given tables, with their oracle SQL.

Stand-ins: an embedding is an 8 x 8 gray frame (vec_id its order, label its video); an event's
value is a scalar frame signal (user its video); a part is a keypoint (type its image, brand its
ellipse); a line item's quantity is a keypoint size (order its image).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline import catalog_contours, catalog_pixels, catalog_prepared, catalog_sources, catalog_sql, catalog_still
from crestline.functions import geometry as G
from crestline.functions import quality as Q
from crestline.operators import clustering, features, frames
from crestline.schemas import STEPS
from crestline.session import table

FLAGSHIP = "representative_frames"

#: Caps that suit unit-norm frames, and the shot threshold on their mean differences.
CAPS = Q.Caps(sharpness=0.5, brightness=0.05, contrast=0.2, focus=0.5)
SHOT, EVENT_CUT, TARGET_FPS = 0.155, 50.0, 3.0
#: Pixels of an image of keypoints.
WIDTH, HEIGHT = 51, 101


def _round(c, digits: int = 6):
    return F.round(c, digits)


# --- frames -------------------------------------------------------------------------------


def _embeddings(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return e.select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _measured(spark: SparkSession, root: str) -> DataFrame:
    v = F.col("v")
    m = _embeddings(spark, root).withColumn("sharpness", Q.variance(Q.laplacian(v, 8, 8))).withColumn("brightness", Q.mean(v))
    m = m.withColumn("contrast", F.sqrt(Q.variance(v))).withColumn("focus", Q.focus(v, 8, 8))
    return m.withColumn("quality", Q.score(*(F.col(c) for c in ("sharpness", "brightness", "contrast", "focus")), CAPS))


def frame_quality(spark, root):
    return _measured(spark, root).select("label", "vec_id", *[_round(F.col(c)).alias(c) for c in ("sharpness", "brightness", "contrast", "focus")])


def frame_quality_score(spark, root):
    return _measured(spark, root).select("label", "vec_id", _round(F.col("quality")).alias("quality"))


def _with_diff(df: DataFrame) -> DataFrame:
    return frames.differences(df, "label", ["vec_id"], lambda lag: Q.mean_abs_diff(F.col("v"), lag("v")))


def frame_diff(spark, root):
    return _with_diff(_embeddings(spark, root)).select("label", "vec_id", _round(F.col("diff")).alias("diff"))


def _shots(df: DataFrame) -> DataFrame:
    return frames.shots(_with_diff(df), "label", ["vec_id"], F.col("diff"), SHOT)


def shot_boundaries(spark, root):
    return _shots(_embeddings(spark, root)).select("label", "vec_id", "shot_id")


def shot_boundaries_normalised_twice(spark, root):
    """The original rule: divided by the pixels once more, so that these frames are one shot each video."""
    df = frames.shots(_with_diff(_embeddings(spark, root)), "label", ["vec_id"], F.col("diff"), 0.0025, pixels=64)
    return df.select("label", "vec_id", "shot_id")


def representative_frames(spark, root):
    """The whole chain: measure, cut into shots, keep the best three frames of each."""
    picked = frames.best(_shots(_measured(spark, root)), "label", "shot_id", _round(F.col("quality"), 9), ["vec_id"])
    return picked.select("label", "shot_id", "rank", "vec_id", _round(F.col("quality")).alias("quality"))


def selected_outputs(spark, root):
    """File names and sidecars of the representative frames, in output order."""
    named = frames.output_names(representative_frames(spark, root), "label", "shot_id", "rank", "quality", "vec_id")
    return named.select("label", "vec_id", "out_no", "file_name", "sidecar")


def average_quality(spark, root):
    return representative_frames(spark, root).groupBy("label").agg(F.count("*").alias("n_saved"), _round(F.avg("quality"), 5).alias("avg_quality"))


def region_mean(spark, root):
    v = F.col("v")
    return _embeddings(spark, root).select("label", "vec_id", _round(Q.region_mean(v, 8, 8, 2, 6, 4)).alias("region_mean"))


def sharpness_band(spark, root):
    band = Q.sharpness_band(F.col("sharpness") * 3000)
    return _measured(spark, root).select("label", "vec_id", band.alias("band"))


# --- events as a scalar signal ------------------------------------------------------------


def _events(spark, root) -> DataFrame:
    return frames.number(table(spark, root, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "src_frame_no")


def _sampled(spark, root) -> DataFrame:
    fps = F.lit(20.0) + F.col("user_id") % 11 + 0.9
    return frames.sample(_events(spark, root).withColumn("frame_interval", frames.interval(fps, TARGET_FPS)), F.col("frame_interval"))


def frame_sample(spark, root):
    return _sampled(spark, root).select("user_id", "event_id", "src_frame_no", "frame_interval")


def _event_shots(df: DataFrame, no: str) -> DataFrame:
    changed = frames.differences(df, "user_id", [no], lambda lag: F.abs(F.col("value") - lag("value")))
    return frames.shots(changed, "user_id", [no], F.col("diff"), EVENT_CUT)


def shot_topk(spark, root):
    best = frames.best(_event_shots(_events(spark, root), "src_frame_no"), "user_id", "shot_id", F.col("value"), ["src_frame_no"])
    return best.select("user_id", "shot_id", "rank", "event_id", "value")


def shot_ranges(spark, root):
    return frames.ranges(_event_shots(_events(spark, root), "src_frame_no"), "user_id", "shot_id", "src_frame_no")


def shot_ranges_blocked(spark, root):
    """shot_ranges for users with very many events: windows run within days, and days hand over to each other."""
    day, events = F.to_date("ts"), table(spark, root, "events").select("user_id", "ts", "event_id", "value")
    numbered = frames.blocked_number(events, "user_id", ["ts", "event_id"], day, "src_frame_no")
    changed = frames.blocked_differences(numbered, "user_id", ["src_frame_no"], day, ["value"], lambda lag: F.abs(F.col("value") - lag("value")))
    return frames.ranges(frames.blocked_shots(changed, "user_id", ["src_frame_no"], day, F.col("diff"), EVENT_CUT), "user_id", "shot_id", "src_frame_no")


def sample_then_select(spark, root):
    """Sample, number what is left, cut into shots, keep the best frame of each, with both frame numbers."""
    df = frames.number(_sampled(spark, root), "user_id", ["src_frame_no"])
    best = frames.best(_event_shots(df, "frame_no"), "user_id", "shot_id", F.col("value"), ["frame_no"], most=1)
    return best.select("user_id", "shot_id", "frame_no", "src_frame_no", "value")


def all_frames_scored(spark, root):
    """Selection off: every frame is kept, in one shot a video."""
    df = frames.shots(_events(spark, root), "user_id", ["src_frame_no"], F.lit(None).cast("double"), EVENT_CUT, enabled=False)
    return df.select("user_id", "shot_id", "src_frame_no", "value")


# --- parts as keypoints -------------------------------------------------------------------


def _points(spark, root) -> DataFrame:
    p = table(spark, root, "part")
    return p.select(F.col("p_type").alias("image_id"), F.col("p_partkey").alias("kp_id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"))


def _ellipses(spark, root) -> DataFrame:
    """One ellipse per image and brand: its parts' centre and spread, turned by the brand's number."""
    number = F.regexp_extract("brand", r"(\d+)", 1).cast("int")
    e = _points(spark, root).groupBy("image_id", "brand").agg(
        F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"),
        F.round(2 * F.stddev_pop("x"), 3).alias("w"), F.round(2 * F.stddev_pop("y"), 3).alias("h"), F.count("*").cast("int").alias("points"),
    )
    return e.withColumn("angle", (number * 3).cast("double")).withColumn("ord", number).drop("brand")




def _dims():
    return F.lit(WIDTH), F.lit(HEIGHT)


def points_in_ellipse(spark, root):
    found = features.hits(_points(spark, root), _ellipses(spark, root), *_dims(), largest=HEIGHT)
    return found.select("image_id", "ord", "kp_id")


def points_in_ellipse_grid(spark, root):
    """The same join with a grid in its key, for images with very many points and ellipses."""
    found = features.hits(_points(spark, root), _ellipses(spark, root), *_dims(), cell=16.0, largest=HEIGHT)
    return found.groupBy("image_id", "ord").agg(F.count("*").alias("n_hits"))


def _lines(spark, root) -> DataFrame:
    p = _points(spark, root)
    x, y = F.col("x").cast("int"), F.floor("y").cast("int")
    return p.select("image_id", F.col("kp_id").alias("line_id"), x.alias("x1"), y.alias("y1"), (x + F.col("kp_id") % 37 - 18).cast("int").alias("x2"), (y + F.col("kp_id") % 53 - 26).cast("int").alias("y2"))


def endpoint_hits(spark, root):
    found = features.hits(features.line_ends(_lines(spark, root)), _ellipses(spark, root), *_dims(), largest=HEIGHT)
    return found.groupBy("image_id", "ord").agg(F.count("*").alias("n_ends"))


def line_pieces(spark, root):
    """Lines cut into segments of at most 10 pixels."""
    cut = _lines(spark, root).withColumn("pieces", G.pieces(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 10.0))
    last = F.element_at("pieces", 1)
    return cut.select("line_id", F.size("pieces").alias("n_pieces"), last["x2"].alias("first_x2"), last["y2"].alias("first_y2"))


def _scored(spark, root, **more) -> DataFrame:
    points = _points(spark, root)
    every = features.stack(surf=points.where("kp_id % 3 = 0"), line=features.line_ends(_lines(spark, root)), fast=points)
    return features.scores(_ellipses(spark, root), every, *_dims(), largest=HEIGHT, **more)


def feature_density(spark, root):
    return _scored(spark, root).select("image_id", "ord", "n_hits", _round(F.col("density"), 4).alias("density"))


def center_weighted_score(spark, root):
    return _scored(spark, root).select("image_id", "ord", "n_surf", _round(F.col("centre_score"), 4).alias("centre_score"))


def ellipse_scores(spark, root):
    return _scored(spark, root).select("image_id", "ord", _round(F.col("score"), 2).alias("score"), "qualifies")


def best_ellipse(spark, root):
    best = features.best_ellipse(_scored(spark, root))
    return best.select("image_id", "ord", "cx", "cy", "w", "h", "fallback")


def best_ellipse_fallback(spark, root):
    """No ellipse has enough hits, so the largest of each image is taken."""
    best = features.best_ellipse(_scored(spark, root, least_surf=10**9))
    return best.select("image_id", "ord", "w", "h", "fallback")


def ellipse_comparison(spark, root):
    scored = _scored(spark, root)
    return features.compare(scored, features.best_ellipse(scored)).select("image_id", "ord", "n_surf", "is_best")


def ellipse_candidates(spark, root):
    """Limits follow the image's own ellipses, so that they hold for tables of any size."""
    mean = lambda c: 0.9 * F.avg(c).over(Window.partitionBy("image_id"))
    e = _ellipses(spark, root).withColumn("__area", mean(G.listed_area(F.col("w"), F.col("h")))).withColumn("__axis", mean(F.least("w", "h"))).withColumn("__points", mean(F.col("points")))
    ok = G.candidate(F.col("points"), F.col("w"), F.col("h"), least_area=F.col("__area"), most_aspect=4.0, least_axis=F.col("__axis"), least_points=F.col("__points"))
    return e.where(ok).select("image_id", "ord", _round(G.listed_area(F.col("w"), F.col("h")), 3).alias("area"))


def crop_bbox(spark, root):
    box = G.crop_box(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")), *_dims(), padding=5)
    return _ellipses(spark, root).withColumn("box", box).select("image_id", "ord", *[F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def circularity_filter(spark, root):
    c = G.circularity(F.col("x") * F.col("y"), 2 * (F.col("x") + F.col("y")))
    return _points(spark, root).withColumn("c", c).where("c >= 0.5").select("kp_id", _round(F.col("c")).alias("circularity"))


def keypoint_bounds(spark, root):
    return _points(spark, root).where(G.in_bounds(F.col("x"), F.col("y"), F.lit(7.0), *_dims())).select("kp_id", "image_id")


def fit_scale(spark, root):
    return _ellipses(spark, root).select("image_id", "ord", _round(G.fit_scale(F.col("w"), F.col("h")), 4).alias("scale"))


def first_detection(spark, root):
    """The first part of each brand whose confidence, its share of the brand's greatest value, is over 0.6."""
    share = F.try_divide(F.col("y"), F.max("y").over(Window.partitionBy("brand")))
    found = features.first_match(_points(spark, root).withColumn("confidence", share), "brand", ["kp_id"], F.col("confidence"))
    return found.select("brand", "kp_id", _round(F.col("confidence")).alias("confidence"))


# --- line items as keypoint sizes ---------------------------------------------------------

_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def _modes(spark, root) -> DataFrame:
    items = table(spark, root, "lineitem").select("l_orderkey", *_ORDER, "l_quantity")
    return clustering.mode_size(items, "l_orderkey", _ORDER, "l_quantity")


def mode_size(spark, root):
    return _modes(spark, root)


def size_tolerance_filter(spark, root):
    items = table(spark, root, "lineitem").select("l_orderkey", *_ORDER, "l_quantity")
    kept = clustering.near_target(items.join(_modes(spark, root).select("l_orderkey", "mode_size"), "l_orderkey"), F.col("l_quantity"), F.col("mode_size"))
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n_kept"), F.sum("l_quantity").alias("sum_quantity"))


def debug_order(spark, root):
    """Orders as images and their items as steps, in the fixed order of step names, without those that are missing."""
    items = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % len(STEPS)).cast("int").alias("k"), "l_quantity").groupBy("image_id", "k").agg(F.max("l_quantity").alias("q"))
    steps = items.select("image_id", F.element_at(F.array(*map(F.lit, STEPS)), F.col("k") + 1).alias("step_name"), F.when(F.col("q") > 10, F.col("q")).alias("image"))
    return features.debug_order(steps, STEPS).select("image_id", "step_no", "step_name", F.col("image").alias("size"))


# --- oracle SQL ---------------------------------------------------------------------------

_E = """e AS (SELECT label, vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings),
px AS (SELECT label, vec_id, i, i // 8 AS y, i % 8 AS x, v[i + 1] AS p, v FROM e, range(64) t(i)),
nb AS (SELECT label, vec_id, p,
  CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS xl, CASE WHEN x = 7 THEN 6 ELSE x + 1 END AS xr,
  CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS yu, CASE WHEN y = 7 THEN 6 ELSE y + 1 END AS yd, x, y, v FROM px),
ms AS (SELECT label, vec_id,
  v[yu*8+x+1] + v[y*8+xl+1] + v[y*8+xr+1] + v[yd*8+x+1] - 4*p AS lap, p,
  v[yu*8+xr+1] + 2*v[y*8+xr+1] + v[yd*8+xr+1] - v[yu*8+xl+1] - 2*v[y*8+xl+1] - v[yd*8+xl+1] AS gx,
  v[yd*8+xl+1] + 2*v[yd*8+x+1] + v[yd*8+xr+1] - v[yu*8+xl+1] - 2*v[yu*8+x+1] - v[yu*8+xr+1] AS gy FROM nb),
q AS (SELECT label, vec_id, var_pop(lap) AS sharpness, avg(p) AS brightness, stddev_pop(p) AS contrast, avg(gx*gx + gy*gy) AS focus FROM ms GROUP BY 1, 2),
s AS (SELECT *, 0.4*least(sharpness/0.5, 1) + 0.2*least(brightness/0.05, 1) + 0.2*least(contrast/0.2, 1) + 0.2*least(focus/0.5, 1) AS quality FROM q)"""
_D = """pr AS (SELECT label, vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e),
d AS (SELECT label, vec_id, CASE WHEN w IS NULL THEN NULL ELSE list_sum([abs(v[i + 1] - w[i + 1]) for i in range(64)]) / 64 END AS diff FROM pr),
sh AS (SELECT label, vec_id, (sum(CASE WHEN diff > 0.155 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS shot_id FROM d)"""
_R = "rk AS (SELECT label, shot_id, row_number() OVER (PARTITION BY label, shot_id ORDER BY round(quality, 9) DESC, vec_id)::INT AS rank, vec_id, round(quality, 6) AS quality FROM s JOIN sh USING (label, vec_id)), rep AS (SELECT * FROM rk WHERE rank <= 3)"
_V = """ev AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS src_frame_no FROM events),
sm AS (SELECT *, floor((20.0::DOUBLE + user_id % 11 + 0.9::DOUBLE) / 3.0)::INT AS frame_interval FROM ev),
sp AS (SELECT * FROM sm WHERE src_frame_no % frame_interval = 0)"""
_VS = """vd AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY src_frame_no)) AS diff FROM ev),
vs AS (SELECT *, (sum(CASE WHEN diff > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY src_frame_no))::BIGINT AS shot_id FROM vd)"""
_P = """pt AS (SELECT p_type AS image_id, p_partkey AS kp_id, p_brand AS brand, p_size::DOUBLE AS x, p_retailprice - 900 AS y FROM part),
el AS (SELECT image_id, regexp_extract(brand, '([0-9]+)', 1)::INT AS ord, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy, round(2*stddev_pop(x), 3) AS w, round(2*stddev_pop(y), 3) AS h,
  count(*)::INT AS points, (regexp_extract(brand, '([0-9]+)', 1)::INT * 3)::DOUBLE AS angle FROM pt GROUP BY image_id, brand),
ln AS (SELECT image_id, kp_id AS line_id, x::INT AS x1, floor(y)::INT AS y1, (x::INT + kp_id % 37 - 18)::INT AS x2, (floor(y)::INT + kp_id % 53 - 26)::INT AS y2 FROM pt),
en AS (SELECT image_id, x1::DOUBLE AS x, y1::DOUBLE AS y FROM ln UNION ALL SELECT image_id, x2::DOUBLE, y2::DOUBLE FROM ln),
ft AS (SELECT image_id, 'surf' AS kind, x, y FROM pt WHERE kp_id % 3 = 0 UNION ALL SELECT image_id, 'line', x, y FROM en UNION ALL SELECT image_id, 'fast', x, y FROM pt)"""
_IN = """trunc({p}.x) >= 0 AND trunc({p}.x) < 51 AND trunc({p}.y) >= 0 AND trunc({p}.y) < 101 AND el.w > 0 AND el.h > 0 AND
 pow(((trunc({p}.x) - cx)*cos(radians(angle)) + (trunc({p}.y) - cy)*sin(radians(angle)))/(w/2), 2) + pow(((trunc({p}.y) - cy)*cos(radians(angle)) - (trunc({p}.x) - cx)*sin(radians(angle)))/(h/2), 2) <= 1"""
_C = f"""ht AS (SELECT el.image_id, ord, count(*) AS n, count(CASE WHEN kind = 'surf' THEN 1 END) AS ns,
  sum(CASE WHEN kind = 'surf' THEN 1 + (1 - sqrt(pow(x - 25, 2) + pow(y - 50, 2)) / sqrt(51.0*51 + 101.0*101)) END) AS c
  FROM el JOIN ft ON el.image_id = ft.image_id AND {_IN.format(p="ft")} GROUP BY 1, 2),
sc0 AS (SELECT el.*, coalesce(n, 0) AS n_hits, coalesce(ns, 0) AS n_surf, coalesce(c, 0.0) AS centre_score FROM el LEFT JOIN ht USING (image_id, ord) WHERE w > 0 AND h > 0),
sc1 AS (SELECT *, CASE WHEN w * h > 0 THEN 10.0*n_hits*n_hits/(pi()*w*h/4) ELSE 0 END AS density FROM sc0),
sc2 AS (SELECT *, density*10000 + centre_score*5 AS feature_score FROM sc1),
sc AS (SELECT *, feature_score - 0.02*sqrt(pow(cx - 25, 2) + pow(cy - 50, 2)) AS score, (pi()*w*h >= 500 AND n_surf >= 3 AND feature_score >= 5) AS qualifies FROM sc2)"""
_B = "bs AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY qualifies DESC, CASE WHEN qualifies THEN score ELSE w*h END DESC, ord) AS pos FROM sc)"
_T = "','".join(STEPS)
_G = """RECURSIVE l AS (SELECT l_orderkey, list(l_quantity::INT ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS sizes FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey, sizes, 0 AS i, []::INT[] AS g, []::INT[] AS n FROM l
 UNION ALL SELECT l_orderkey, sizes, i + 1,
  CASE WHEN len([x for x in g if abs(x - sizes[i + 1]) <= 5]) > 0 THEN g ELSE list_append(g, sizes[i + 1]) END,
  CASE WHEN len([x for x in g if abs(x - sizes[i + 1]) <= 5]) > 0
   THEN [n[k] + CASE WHEN k = list_position([abs(x - sizes[i + 1]) <= 5 for x in g], true) THEN 1 ELSE 0 END for k in range(1, len(g) + 1)] ELSE list_append(n, 1) END
  FROM f WHERE i < len(sizes)),
m AS (SELECT l_orderkey, len(sizes)::INT AS n_sizes, len(g)::INT AS n_groups, g[list_position(n, list_max(n))] AS mode_size FROM f WHERE i = len(sizes))"""

ORACLES = {
    "frame_quality": f"WITH {_E} SELECT label, vec_id, round(sharpness, 6) AS sharpness, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(focus, 6) AS focus FROM q",
    "frame_quality_score": f"WITH {_E} SELECT label, vec_id, round(quality, 6) AS quality FROM s",
    "frame_diff": f"WITH {_E}, {_D} SELECT label, vec_id, round(diff, 6) AS diff FROM d",
    "shot_boundaries": f"WITH {_E}, {_D} SELECT label, vec_id, shot_id FROM sh",
    "shot_boundaries_normalised_twice": f"WITH {_E}, {_D} SELECT label, vec_id, (sum(CASE WHEN diff / 64 > 0.0025 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS shot_id FROM d",
    "representative_frames": f"WITH {_E}, {_D}, {_R} SELECT label, shot_id, rank, vec_id, quality FROM rep",
    "selected_outputs": f"""WITH {_E}, {_D}, {_R}, o AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY shot_id, rank) - 1)::INT AS out_no FROM rep)
        SELECT label, vec_id, out_no, printf('frame_%04d.png', out_no) AS file_name, printf('Original frame index: %d' || chr(10) || 'Quality score: %.4f' || chr(10), vec_id, quality) AS sidecar FROM o""",
    "average_quality": f"WITH {_E}, {_D}, {_R} SELECT label, count(*) AS n_saved, round(avg(quality), 5) AS avg_quality FROM rep GROUP BY label",
    "region_mean": f"WITH {_E} SELECT label, vec_id, round(list_sum([v[(k // 4 + 4) * 8 + k % 4 + 3] for k in range(16)]) / 16, 6) AS region_mean FROM e",
    "sharpness_band": f"WITH {_E} SELECT label, vec_id, CASE WHEN sharpness*3000 > 1000 THEN 'median_7' WHEN sharpness*3000 > 500 THEN 'median_5' WHEN sharpness*3000 < 50 THEN 'sharpen_15' WHEN sharpness*3000 < 100 THEN 'sharpen_9' ELSE 'none' END AS band FROM q",
    "frame_sample": f"WITH {_V} SELECT user_id, event_id, src_frame_no, frame_interval FROM sp",
    "shot_topk": f"WITH {_V}, {_VS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, shot_id ORDER BY value DESC, src_frame_no)::INT AS rank FROM vs) SELECT user_id, shot_id, rank, event_id, value FROM r WHERE rank <= 3",
    "shot_ranges": f"WITH {_V}, {_VS}, g AS (SELECT user_id, shot_id, min(src_frame_no) AS start_no, max(src_frame_no) AS last_no FROM vs GROUP BY 1, 2) SELECT user_id, shot_id, start_no, coalesce(lead(start_no) OVER (PARTITION BY user_id ORDER BY shot_id), last_no + 1) AS end_no FROM g",
    "sample_then_select": f"""WITH {_V}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY src_frame_no) - 1 AS frame_no FROM sp),
        d AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY frame_no)) AS diff FROM n),
        s AS (SELECT *, (sum(CASE WHEN diff > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_no))::BIGINT AS shot_id FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, shot_id ORDER BY value DESC, frame_no) AS rank FROM s) SELECT user_id, shot_id, frame_no, src_frame_no, value FROM r WHERE rank = 1""",
    "all_frames_scored": f"WITH {_V} SELECT user_id, 0::BIGINT AS shot_id, src_frame_no, value FROM ev",
    "points_in_ellipse": f"WITH {_P} SELECT el.image_id, ord, kp_id FROM el JOIN pt ON el.image_id = pt.image_id AND {_IN.format(p='pt')}",
    "points_in_ellipse_grid": f"WITH {_P} SELECT el.image_id, ord, count(*) AS n_hits FROM el JOIN pt ON el.image_id = pt.image_id AND {_IN.format(p='pt')} GROUP BY 1, 2",
    "endpoint_hits": f"WITH {_P} SELECT el.image_id, ord, count(*) AS n_ends FROM el JOIN en ON el.image_id = en.image_id AND {_IN.format(p='en')} GROUP BY 1, 2",
    "line_pieces": f"""WITH {_P}, n AS (SELECT *, greatest(ceil(sqrt(pow((x2 - x1)::DOUBLE, 2) + pow((y2 - y1)::DOUBLE, 2)) / 10), 1)::INT AS n_pieces FROM ln)
        SELECT line_id, n_pieces, trunc(x1 + (1::DOUBLE / n_pieces) * (x2 - x1))::INT AS first_x2, trunc(y1 + (1::DOUBLE / n_pieces) * (y2 - y1))::INT AS first_y2 FROM n""",
    "feature_density": f"WITH {_P}, {_C} SELECT image_id, ord, n_hits, round(density, 4) AS density FROM sc",
    "center_weighted_score": f"WITH {_P}, {_C} SELECT image_id, ord, n_surf, round(centre_score, 4) AS centre_score FROM sc",
    "ellipse_scores": f"WITH {_P}, {_C} SELECT image_id, ord, round(score, 2) AS score, qualifies FROM sc",
    "best_ellipse": f"WITH {_P}, {_C}, {_B} SELECT image_id, ord, cx, cy, w, h, NOT qualifies AS fallback FROM bs WHERE pos = 1",
    "best_ellipse_fallback": f"WITH {_P}, b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY w*h DESC, ord) AS pos FROM el WHERE w > 0 AND h > 0) SELECT image_id, ord, w, h, true AS fallback FROM b WHERE pos = 1",
    "ellipse_comparison": f"WITH {_P}, {_C}, {_B} SELECT image_id, ord, n_surf, pos = 1 AS is_best FROM bs",
    "ellipse_candidates": f"""WITH {_P}, m AS (SELECT *, 0.9::DOUBLE * avg(pi()*w*h) OVER i AS ma, 0.9::DOUBLE * avg(least(w, h)) OVER i AS mx, 0.9::DOUBLE * avg(points) OVER i AS mp FROM el WINDOW i AS (PARTITION BY image_id))
        SELECT image_id, ord, round(pi()*w*h, 3) AS area FROM m WHERE points >= mp AND pi()*w*h >= ma AND w > 0 AND h > 0 AND greatest(w, h)/least(w, h) <= 4 AND least(w, h) >= mx""",
    "crop_bbox": f"""WITH {_P}, r AS (SELECT *, sqrt(pow(w/2*cos(radians(angle)), 2) + pow(h/2*sin(radians(angle)), 2)) AS rx, sqrt(pow(w/2*sin(radians(angle)), 2) + pow(h/2*cos(radians(angle)), 2)) AS ry FROM el),
        b AS (SELECT *, greatest(ceil(cx - rx), 0) AS l, least(floor(cx + rx), 50) AS r, greatest(ceil(cy - ry), 0) AS t, least(floor(cy + ry), 100) AS o FROM r),
        g AS (SELECT *, (w > 0 AND h > 0 AND l <= r AND t <= o) AS ok FROM b)
        SELECT image_id, ord, CASE WHEN ok THEN greatest(l - 5, 0)::INT ELSE 0 END AS x1, CASE WHEN ok THEN greatest(t - 5, 0)::INT ELSE 0 END AS y1, CASE WHEN ok THEN least(r + 5, 51)::INT ELSE 51 END AS x2, 101 AS y2 FROM g""",
    "circularity_filter": f"WITH {_P}, c AS (SELECT kp_id, CASE WHEN x*y > 0 AND x + y > 0 THEN 4*pi()*(x*y)/(2*(x + y)*(2*(x + y))) END AS c FROM pt) SELECT kp_id, round(c, 6) AS circularity FROM c WHERE c >= 0.5",
    "keypoint_bounds": f"WITH {_P} SELECT kp_id, image_id FROM pt WHERE trunc(x) >= 3 AND trunc(y) >= 3 AND trunc(x) < 48 AND trunc(y) < 98",
    "fit_scale": f"WITH {_P} SELECT image_id, ord, CASE WHEN w > 0 AND h > 0 THEN round(least(360.0::DOUBLE / w, 240.0::DOUBLE / h), 4) END AS scale FROM el",
    "first_detection": f"WITH {_P}, c AS (SELECT brand, kp_id, y / nullif(max(y) OVER (PARTITION BY brand), 0) AS confidence FROM pt), f AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY kp_id) AS pos FROM c WHERE confidence > 0.6) SELECT brand, kp_id, round(confidence, 6) AS confidence FROM f WHERE pos = 1",
    "mode_size": f"WITH {_G} SELECT l_orderkey, n_sizes, n_groups, mode_size FROM m",
    "size_tolerance_filter": f"WITH {_G} SELECT l_orderkey, count(*) AS n_kept, sum(l_quantity) AS sum_quantity FROM lineitem JOIN m USING (l_orderkey) WHERE abs(l_quantity - mode_size) <= 5 GROUP BY 1",
    "debug_order": f"""WITH i AS (SELECT l_orderkey AS image_id, l_linenumber % {len(STEPS)} AS k, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
        n AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY k) - 1)::INT AS step_no, ['{_T}'][k + 1] AS step_name, q FROM i)
        SELECT image_id, step_no, step_name, q AS size FROM n WHERE q > 10 AND step_no < 12""",
}


ORACLES["shot_ranges_blocked"] = ORACLES["shot_ranges"]
ORACLES["selected_pixels"] = f"WITH {_E}, {_D}, {_R}, {catalog_pixels._F} SELECT r.label, shot_id, rank, r.vec_id, {catalog_pixels._check('v').replace(' AS v', ' AS pixels')} FROM rep r JOIN f ON f.label = r.label AND f.vec_id = r.vec_id"
_OWN = set(ORACLES) - {"selected_pixels"}
ORACLES |= catalog_pixels.ORACLES | catalog_contours.ORACLES | {"pixel_areas": catalog_contours.areas_oracle(_P, _IN)} | catalog_sources.oracle_sql(ORACLES["selected_outputs"])
ORACLES["prepared_frames"] = catalog_prepared.oracle(_E[_E.index("px AS") :], _D, _R)
ORACLES["still_images"] = catalog_still.oracle(_C, _IN, _B, catalog_contours.ORACLES["many_segments"])
ORACLES |= {name: ORACLES[other] for name, other in catalog_sql.SAME_AS.items()}


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES if name in _OWN} | catalog_pixels.queries() | catalog_contours.queries() | catalog_sources.queries() | catalog_sql.queries() | catalog_prepared.queries() | catalog_still.queries()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
