"""The registered query of the whole chain on still images: outlines, ellipses, lines, features, scores, best ellipse, crop box.

Stand-ins: parts on a coarse grid are the edge pixels of an image (its type), and its keypoints.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline.catalog_contours import _ELLIPSES, _mask, _outlines
from crestline.catalog_pixels import _CM, _ED
from crestline.plans.outlined import best_outlined
from crestline.session import table

#: Pixels of an image; lines of an image are the constants of the contour queries.
SIDE, VOTES, LINES, LENGTH, GAP, PAD = 26, 3, 5, 5.0, 30.0, 2
LIMITS = dict(least_area=30.0, most_aspect=10.0, least_axis=1.5, least_points=5)


def still_images(spark, root):
    mask = _mask(spark, root)
    at = table(spark, root, "part").select(F.col("p_type").alias("image_id"), "p_partkey", (F.col("p_size") / 2).alias("x"), ((F.col("p_retailprice") - 900) / 4).alias("y"))
    keypoints = at.where("p_partkey % 3 = 0").withColumn("kind", F.lit("surf")).unionByName(at.withColumn("kind", F.lit("fast")))
    best = best_outlined(mask, keypoints, F.lit(SIDE), F.lit(SIDE), VOTES, LINES, LENGTH, GAP, PAD, dict(least_area=30.0), **LIMITS)
    box = [F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return best.select("image_id", "ord", "cx", "cy", "w", "h", "angle", "n_hits", "n_surf", F.round("score", 2).alias("score"), "fallback", *box)


def oracle(scoring: str, inside: str, best: str, segments: str) -> str:
    """`scoring`, `inside` and `best` are the SQL of plain ellipses; `segments` that of many lines."""
    mask = "SELECT DISTINCT p_type AS image_id, (p_size // 2)::INT AS x, floor((p_retailprice - 900) / 4)::INT AS y FROM part"
    half = SIDE // 2

    def sized(sql: str) -> str:
        for a, b in (("< 51", f"< {SIDE}"), ("< 101", f"< {SIDE}"), ("x - 25,", f"x - {half},"), ("y - 50,", f"y - {half},"), ("51.0*51 + 101.0*101", f"{SIDE}.0*{SIDE} + {SIDE}.0*{SIDE}"), ("pi()*w*h >= 500", "pi()*w*h >= 30")):
            sql = sql.replace(a, b)
        return sql

    lines = segments[: segments.index("SELECT image_id, line, theta, rho, segment")].replace(_ED, f"ed AS ({mask})") + "SELECT image_id, first(x ORDER BY along, x, y) AS x1, first(y ORDER BY along, x, y) AS y1, last(x ORDER BY along, x, y) AS x2, last(y ORDER BY along, x, y) AS y2 FROM s GROUP BY image_id, line, segment HAVING max(along) - min(along) >= 5"
    points = "cp AS (SELECT image_id, contour, x::DOUBLE AS x, y::DOUBLE AS y FROM tc)"
    fitted = _ELLIPSES.replace(_CM, points)
    angle = "CASE WHEN turn < 0 THEN turn + 180 ELSE turn END"
    return f"""WITH tc AS MATERIALIZED (WITH RECURSIVE {_outlines(mask, True)} SELECT image_id, contour, k, x, y FROM pt),
        fe AS MATERIALIZED (WITH {fitted} SELECT image_id, contour AS ord, n_points AS points, round(cx, 3) AS cx, round(cy, 3) AS cy, round(w, 3) AS w, round(h, 3) AS h, round({angle}, 3) AS angle FROM el JOIN me USING (image_id, contour)),
        el AS MATERIALIZED (SELECT * FROM fe WHERE points >= 5 AND pi() * w * h >= 30 AND w > 0 AND h > 0 AND h / w <= 10 AND w >= 1.5),
        sg AS MATERIALIZED ({lines}), kp AS (SELECT p_type AS image_id, p_partkey, p_size / 2 AS x, (p_retailprice - 900) / 4 AS y FROM part),
        ft AS (SELECT image_id, 'surf' AS kind, x, y FROM kp WHERE p_partkey % 3 = 0 UNION ALL SELECT image_id, 'line', x1, y1 FROM sg UNION ALL SELECT image_id, 'line', x2, y2 FROM sg UNION ALL SELECT image_id, 'fast', x, y FROM kp),
        {sized(scoring)}, {best}, bb AS (SELECT *, sqrt(pow(w/2*cos(radians(angle)), 2) + pow(h/2*sin(radians(angle)), 2)) AS rx, sqrt(pow(w/2*sin(radians(angle)), 2) + pow(h/2*cos(radians(angle)), 2)) AS ry FROM bs WHERE pos = 1),
        bx AS (SELECT *, greatest(ceil(cx - rx), 0) AS l, least(floor(cx + rx), {SIDE - 1}) AS r, greatest(ceil(cy - ry), 0) AS t, least(floor(cy + ry), {SIDE - 1}) AS o FROM bb)
        SELECT image_id, ord, cx, cy, w, h, angle, n_hits, n_surf, round(score, 2) AS score, NOT qualifies AS fallback, CASE WHEN l <= r AND t <= o THEN greatest(l - {PAD}, 0)::INT ELSE 0 END AS x1, CASE WHEN l <= r AND t <= o THEN greatest(t - {PAD}, 0)::INT ELSE 0 END AS y1,
          CASE WHEN l <= r AND t <= o THEN least(r + {PAD}, {SIDE})::INT ELSE {SIDE} END AS x2, {SIDE}::INT AS y2 FROM bx"""


def queries() -> dict:
    return {"still_images": still_images}
