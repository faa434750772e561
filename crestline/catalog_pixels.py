"""Registered queries on pixels, points and contours, with their oracle SQL.

Stand-ins: an embedding's absolute values, scaled to 0..255, are an 8 x 8 frame (or one of 16 x 4, or 22 pixels of three
channels, the last two values being 0); parts are edge pixels of an image (its type), and the points of a contour (its brand) in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.functions import geometry as G
from crestline.functions import quality as Q
from crestline.functions import rasters as R
from crestline.operators import frames
from crestline.operators import rasters as T
from crestline.session import table

SIZE, CORNER, VOTES, ROUND, EDGE = 8, 15, 3, 0.9, (150.0, 400.0)


def _frames(spark: SparkSession, root: str) -> DataFrame:
    level = lambda x: F.least(F.floor(F.abs(x.cast("double")) * 512), F.lit(255)).cast("int")
    return table(spark, root, "embeddings").select("label", "vec_id", F.transform("embedding", level).alias("v"))


def _sum(v: Column) -> Column:
    """A checksum that depends on values and places."""
    return F.aggregate(F.transform(v, lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


def sharpened_frames(spark, root):
    v, kernels = F.col("v"), {"frame": R.SHARPEN_FRAME, "nine": R.SHARPEN_9, "fifteen": R.SHARPEN_15}
    return _frames(spark, root).select("vec_id", *[_sum(R.filter2d(v, SIZE, SIZE, k)).alias(n) for n, k in kernels.items()])


def blurred_frames(spark, root):
    v = F.col("v")
    return _frames(spark, root).select("vec_id", _sum(R.gaussian(v, SIZE, SIZE)).alias("gaussian"), _sum(R.median(v, SIZE, SIZE, 5)).alias("median_5"), _sum(R.median(v, SIZE, SIZE, 7)).alias("median_7"))


def turned_frames(spark, root):
    """Landscape frames turned upright, and frames turned by an EXIF orientation."""
    v, exif = F.col("v"), F.col("vec_id") % 9
    return _frames(spark, root).select("vec_id", _sum(R.upright(v, 16, 4)).alias("upright"), _sum(R.upright(v, 4, 16)).alias("portrait"), _sum(R.oriented(v, 16, 4, exif)).alias("oriented"))


def channel_frames(spark, root):
    """Channels split, grayed, and merged the other way round."""
    f = _frames(spark, root).withColumn("v", F.concat("v", F.array(F.lit(0), F.lit(0))))
    b, g, r = R.channels(F.col("v"))
    f = f.select("vec_id", b.alias("b"), g.alias("g"), r.alias("r"))
    gray = F.transform("b", lambda x, i: F.rint(R.gray(x, F.get("g", i), F.get("r", i))).cast("int"))
    return f.select("vec_id", _sum(gray).alias("gray"), _sum(R.merged(F.col("r"), F.col("g"), F.col("b"))).alias("rgb"))


def channel_means(spark, root):
    """Mean of each channel in the region under a box, of frames of 11 x 2 pixels."""
    f = _frames(spark, root).withColumn("v", F.concat("v", F.array(F.lit(0), F.lit(0))))
    means = Q.region_means([F.transform(c, lambda x: x.cast("double")) for c in R.channels(F.col("v"))], 11, 2, 2, 6, 0)
    return f.select("vec_id", *[F.round(m, 6).alias(n) for n, m in zip("bgr", means, strict=True)])


def lab_means(spark, root):
    f = _frames(spark, root).select("vec_id", F.posexplode(F.sequence(F.lit(0), F.lit(21))).alias("i", "p"), F.concat("v", F.array(F.lit(0), F.lit(0))).alias("v"))
    px = [F.get("v", F.col("p") * 3 + c).cast("double") for c in range(3)]
    parts = R.lab(*px)
    return f.select("vec_id", *[p.alias(n) for n, p in zip("lab", parts, strict=True)]).groupBy("vec_id").agg(*[F.round(F.avg(n), 4).alias(n) for n in "lab"])


def otsu_thresholds(spark, root):
    pixels = _frames(spark, root).select("vec_id", F.explode("v").alias("p"))
    found = T.otsu(pixels, "vec_id", "p")
    over = pixels.join(found, "vec_id").groupBy("vec_id", "threshold").agg(F.count(F.when(F.col("p") > F.col("threshold"), 1)).alias("n_over"))
    return over.select("vec_id", "threshold", "n_over")


def corner_points(spark, root):
    scored = _frames(spark, root).select("vec_id", F.posexplode(R.corner_scores(F.col("v"), SIZE, SIZE)).alias("i", "score"))
    placed = scored.select("vec_id", (F.col("i") % (SIZE - 6) + 3).alias("x"), (F.floor(F.col("i") / (SIZE - 6)) + 3).cast("int").alias("y"), "score")
    return T.local_maxima(placed, "vec_id", CORNER).select("vec_id", "x", "y", "score")


def resized_frames(spark, root):
    return _frames(spark, root).select("vec_id", _sum(R.resized(F.col("v"), SIZE, SIZE, 5, 11)).alias("resized"))


def edge_pixels(spark, root):
    """Edges of frames, with bounds at which chains of weak pixels occur."""
    thin = _frames(spark, root).select("vec_id", F.posexplode(R.gradient_maxima(F.col("v"), SIZE, SIZE)).alias("i", "size"))
    placed = thin.where("size > 0").select("vec_id", (F.col("i") % SIZE).alias("x"), F.floor(F.col("i") / SIZE).cast("int").alias("y"), "size")
    found = T.edges(placed, "vec_id", *EDGE)
    return found.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(F.col("x") + 8 * F.col("y")).cast("long").alias("places"))


def point_patches(spark, root):
    """Patches around points, some of them at or beyond the border; empty ones go."""
    x, y = (F.col("vec_id") % 17 - 5).cast("int"), (F.col("vec_id") % 13 - 4).cast("int")
    cut = _frames(spark, root).withColumn("patch", R.patch(F.col("v"), SIZE, SIZE, x, y, 7)).where(F.size("patch") > 0)
    return cut.select("vec_id", F.size("patch").alias("n"), _sum(F.col("patch")).alias("patch"))


def _edge_pixels(spark, root) -> DataFrame:
    p = table(spark, root, "part")
    return p.select(F.col("p_type").alias("image_id"), F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") - 900).cast("int").alias("y")).distinct()


def line_votes(spark, root):
    """The most voted line of each image."""
    return T.best_line(T.line_votes(_edge_pixels(spark, root), "image_id"), "image_id", VOTES)


def line_segments(spark, root):
    points = _edge_pixels(spark, root)
    found = T.line_segments(points, line_votes(spark, root), "image_id", least=5.0, gap=6.0)
    return found.select("image_id", "segment", "x1", "y1", "x2", "y2", "n")


def _contours(spark, root) -> DataFrame:
    p = table(spark, root, "part").select(F.col("p_type").alias("image_id"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("contour"), "p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"))
    return T.contour_measures(p, "image_id", "contour", "p_partkey")


def contour_measures(spark, root):
    return _contours(spark, root).select("image_id", "contour", "n_points", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


def largest_contours(spark, root):
    measured = _contours(spark, root).withColumn("area", F.round("area", 3))
    return T.largest_contour(measured, "image_id", "contour").select("image_id", "contour", "area")


def round_contours(spark, root):
    """Contours that are about as round as their image's are on average, or whose roundness failed to compute (those of one point stand for that)."""
    m = _contours(spark, root).withColumn("circularity", F.round(G.circularity(F.col("area"), F.col("perimeter")), 6))
    m = m.withColumn("least", ROUND * F.avg("circularity").over(Window.partitionBy("image_id")))
    return m.where(T.round_enough(F.col("circularity"), F.col("n_points") == 1, F.col("least"))).select("image_id", "contour", "n_points", "circularity")


def sheet_cells(spark, root):
    """Where pictures lie on a sheet: items of an order as steps, their quantities and discounts as sizes; without one there is no picture."""
    items = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") - 1).alias("step_no")).agg(F.max("l_quantity").alias("w"), F.max("l_discount").alias("d")).where("w > 0 AND d > 0")
    return T.sheet_cells(items.select("image_id", "step_no", "w", (F.col("d") * 1000).alias("h")), "step_no", F.col("w"), F.col("h")).select("image_id", "step_no", "cell_row", "cell_column", "x0", "y0", "shown_w", "shown_h")


def video_metadata(spark, root):
    fps = F.lit(20.0) + F.col("user_id") % 11 + 0.9
    return frames.videos(table(spark, root, "events").select("user_id"), "user_id", fps, 3.0)


def selected_pixels(spark, root):
    """Frames selected by their measures alone, and their pixels joined back."""
    from crestline.catalog import representative_frames

    picked = representative_frames(spark, root).select("label", "shot_id", "rank", "vec_id")
    return frames.with_pixels(picked, _frames(spark, root), ["label", "vec_id"], "v").select("label", "shot_id", "rank", "vec_id", _sum(F.col("v")).alias("pixels"))


# --- oracle SQL ---------------------------------------------------------------------------

_F = "f AS (SELECT label, vec_id, [least(floor(abs(x::DOUBLE) * 512), 255)::INT for x in embedding] AS v FROM embeddings)"


def _at(dx: int, dy: int, border: str = "mirror") -> str:
    """The neighbour's value by arithmetic on the index i."""
    x, y = f"(i % 8 + {dx})", f"(i // 8 + {dy})"
    cut = (lambda e: f"(7 - abs(7 - abs({e})))") if border == "mirror" else (lambda e: f"least(greatest({e}, 0), 7)")
    return f"v[{cut(y)} * 8 + {cut(x)} + 1]"


def _filtered(kernel) -> str:
    n = len(kernel) // 2
    total = " + ".join(f"{_at(dx - n, dy - n)} * {float(k)!r}::DOUBLE" for dy, row in enumerate(kernel) for dx, k in enumerate(row) if k)
    return f"[least(greatest(round_even({total}, 0), 0), 255)::INT for i in range(64)]"


def _median(size: int) -> str:
    n = size // 2
    near = ", ".join(_at(dx, dy, "edge") for dy in range(-n, n + 1) for dx in range(-n, n + 1))
    return f"[list_sort([{near}])[{size * size // 2 + 1}] for i in range(64)]"


def _check(name: str) -> str:
    return f"list_sum([{name}[k + 1]::BIGINT * (k + 1) for k in range(len({name}))])::BIGINT AS {name}"


_GAUSSIAN = [[a * b / 256 for b in (1, 4, 6, 4, 1)] for a in (1, 4, 6, 4, 1)]
_TURN = "[v[({0}) + 1] for i in range(64)]"
_LINEAR = "CASE WHEN {0} / 255 > 0.04045 THEN pow(({0} / 255 + 0.055) / 1.055, 2.4) ELSE {0} / 255 / 12.92 END"
_ROOT = "CASE WHEN {0} > 0.008856 THEN cbrt({0}) ELSE 7.787 * {0} + 16::DOUBLE / 116 END"
#: Frames of three channels: 22 pixels.
_F3 = f"{_F}, f3 AS (SELECT vec_id, list_concat(v, [0, 0]) AS v FROM f)"
_LAB = f"""p AS (SELECT vec_id, v[3 * k + 1]::DOUBLE AS b, v[3 * k + 2]::DOUBLE AS g, v[3 * k + 3]::DOUBLE AS r FROM f3, range(22) t(k)),
n AS (SELECT vec_id, {_LINEAR.format("b")} AS b, {_LINEAR.format("g")} AS g, {_LINEAR.format("r")} AS r FROM p),
t AS (SELECT vec_id, {", ".join(f"(b * {x[0]}::DOUBLE + g * {x[1]}::DOUBLE + r * {x[2]}::DOUBLE) / {w}::DOUBLE AS {n}" for n, x, w in zip("xyz", R.XYZ, R.WHITE, strict=True))} FROM n),
s AS (SELECT vec_id, y, {", ".join(f"{_ROOT.format(n)} AS f{n}" for n in "xyz")} FROM t)"""
_AX, _AY = (" + ".join(f"{_at(*((s, d) if x else (d, s)))} * {s * (2 if d == 0 else 1)}" for s in (-1, 1) for d in (-1, 0, 1)) for x in (True, False))
_INNER = ", ".join(f"({y * 8 + x}, {x}, {y})" for y in (3, 4) for x in (3, 4))
_RING = ", ".join(f"v[c + {dy * 8 + dx} + 1] - v[c + 1]" for dx, dy in [*R.RING, *R.RING[:8]])
_ED = "ed AS (SELECT DISTINCT p_type AS image_id, p_size AS x, floor(p_retailprice - 900)::INT AS y FROM part)"
_RHO = "floor(x * cos(radians(theta::DOUBLE)) + y * sin(radians(theta::DOUBLE)) + 0.5::DOUBLE + 1e-7::DOUBLE)::INT"
_VT = f"""{_ED}, vt AS (SELECT image_id, theta::INT AS theta, {_RHO} AS rho, count(*) AS votes FROM ed, range(180) t(theta) GROUP BY 1, 2, 3),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, theta, rho) AS pos FROM vt WHERE votes >= {VOTES}) WHERE pos = 1)"""
_CM = """cp AS (SELECT p_type AS image_id, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS contour, p_partkey AS k, p_size::DOUBLE AS x, p_retailprice - 900 AS y FROM part),
cn AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM cp WINDOW w AS (PARTITION BY image_id, contour ORDER BY k)),
cm AS (SELECT image_id, contour, count(*) AS n_points, abs(sum(x * ny - y * nx)) / 2 AS area, sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) AS perimeter FROM cn GROUP BY 1, 2)"""

ORACLES = {
    "sharpened_frames": f"WITH {_F}, o AS (SELECT vec_id, {_filtered(R.SHARPEN_FRAME)} AS frame, {_filtered(R.SHARPEN_9)} AS nine, {_filtered(R.SHARPEN_15)} AS fifteen FROM f) SELECT vec_id, {_check('frame')}, {_check('nine')}, {_check('fifteen')} FROM o",
    "blurred_frames": f"WITH {_F}, o AS (SELECT vec_id, {_filtered(_GAUSSIAN)} AS gaussian, {_median(5)} AS median_5, {_median(7)} AS median_7 FROM f) SELECT vec_id, {_check('gaussian')}, {_check('median_5')}, {_check('median_7')} FROM o",
    "turned_frames": f"""WITH {_F}, o AS (SELECT vec_id, {_TURN.format("i % 4 * 16 + 15 - i // 4")} AS upright, v AS portrait,
        CASE vec_id % 9 WHEN 3 THEN list_reverse(v) WHEN 6 THEN {_TURN.format("(3 - i % 4) * 16 + i // 4")} WHEN 8 THEN {_TURN.format("i % 4 * 16 + 15 - i // 4")} ELSE v END AS oriented FROM f)
        SELECT vec_id, {_check("upright")}, {_check("portrait")}, {_check("oriented")} FROM o""",
    "channel_frames": f"""WITH {_F3}, o AS (SELECT vec_id, [round_even(0.114::DOUBLE * v[3 * i + 1] + 0.587::DOUBLE * v[3 * i + 2] + 0.299::DOUBLE * v[3 * i + 3], 0)::INT for i in range(22)] AS gray,
        [v[i - i % 3 + 2 - i % 3 + 1] for i in range(66)] AS rgb FROM f3) SELECT vec_id, {_check("gray")}, {_check("rgb")} FROM o""",
    "channel_means": f"WITH {_F3} SELECT vec_id, {', '.join(f'round(list_sum([v[((k // 4) * 11 + 2 + k % 4) * 3 + {c + 1}]::DOUBLE for k in range(8)]) / 8, 6) AS {n}' for c, n in enumerate('bgr'))} FROM f3",
    "lab_means": f"WITH {_F3}, {_LAB} SELECT vec_id, round(avg((CASE WHEN y > 0.008856 THEN 116 * fy - 16 ELSE 903.3 * y END) * 255 / 100), 4) AS l, round(avg(500 * (fx - fy) + 128), 4) AS a, round(avg(200 * (fy - fz) + 128), 4) AS b FROM s GROUP BY 1",
    "otsu_thresholds": f"""WITH {_F}, p AS (SELECT vec_id, unnest(v) AS p FROM f), h AS (SELECT vec_id, t, count(CASE WHEN p <= t THEN 1 END) AS b, sum(CASE WHEN p <= t THEN p ELSE 0 END) AS m, count(*) AS n, sum(p) AS s FROM p, range(256) r(t) GROUP BY 1, 2),
        a AS (SELECT vec_id, t, CASE WHEN b > 0 AND b < n THEN pow(s::DOUBLE * b / n - m, 2) / (b * (n - b)) ELSE 0 END AS apart FROM h),
        k AS (SELECT vec_id, t, row_number() OVER (PARTITION BY vec_id ORDER BY apart DESC, t) AS pos FROM a)
        SELECT vec_id, t::INT AS threshold, count(CASE WHEN p > t THEN 1 END) AS n_over FROM k JOIN p USING (vec_id) WHERE pos = 1 GROUP BY 1, 2""",
    "corner_points": f"""WITH {_F}, i AS (SELECT * FROM (VALUES {_INNER}) q(c, x, y)), d AS (SELECT vec_id, x, y, [{_RING}] AS a FROM f, i),
        s AS (SELECT vec_id, x, y, greatest(list_max([list_min(a[k:k + 8]) for k in range(1, 17)]), list_max([-list_max(a[k:k + 8]) for k in range(1, 17)])) AS score FROM d)
        SELECT vec_id, x, y, score FROM s WHERE score > {CORNER} AND NOT EXISTS (SELECT 1 FROM s o WHERE o.vec_id = s.vec_id AND (o.x <> s.x OR o.y <> s.y) AND abs(o.x - s.x) <= 1 AND abs(o.y - s.y) <= 1 AND o.score > {CORNER} AND o.score >= s.score)""",
    "resized_frames": f"""WITH {_F}, c AS (SELECT (k // 5 * 5 + k % 5)::INT AS k, least(greatest((k % 5 + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE, 0), 7) AS px, least(greatest((k // 5 + 0.5::DOUBLE) * 8 / 11 - 0.5::DOUBLE, 0), 7) AS py FROM range(55) r(k)),
        a AS (SELECT k, trunc(px)::INT AS x, trunc(py)::INT AS y, px - trunc(px) AS fx, py - trunc(py) AS fy, least(trunc(px)::INT + 1, 7) AS x1, least(trunc(py)::INT + 1, 7) AS y1 FROM c),
        o AS (SELECT vec_id, k, round_even((v[y * 8 + x + 1] * (1 - fx) + v[y * 8 + x1 + 1] * fx) * (1 - fy) + (v[y1 * 8 + x + 1] * (1 - fx) + v[y1 * 8 + x1 + 1] * fx) * fy, 0) AS p FROM f, a)
        SELECT vec_id, sum(least(greatest(p, 0), 255)::BIGINT * (k + 1))::BIGINT AS resized FROM o GROUP BY 1""",
    "edge_pixels": f"""WITH RECURSIVE {_F}, g AS (SELECT vec_id, [{_AX} for i in range(64)] AS gx, [{_AY} for i in range(64)] AS gy FROM f),
        p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, abs(gx[i + 1]) + abs(gy[i + 1]) AS size, ((round(atan2(gy[i + 1], gx[i + 1]) / (pi() / 4))::INT % 4) + 4) % 4 AS turn FROM g, range(64) r(i)),
        w AS (SELECT *, CASE turn WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS dx, CASE turn WHEN 0 THEN 0 ELSE 1 END AS dy FROM p),
        t AS (SELECT w.vec_id, w.x, w.y, w.size FROM w LEFT JOIN p a ON a.vec_id = w.vec_id AND a.x = w.x + dx AND a.y = w.y + dy LEFT JOIN p b ON b.vec_id = w.vec_id AND b.x = w.x - dx AND b.y = w.y - dy
          WHERE w.size > coalesce(b.size, 0) AND w.size >= coalesce(a.size, 0)),
        e AS (SELECT vec_id, x, y FROM t WHERE size > {EDGE[1]} UNION SELECT t.vec_id, t.x, t.y FROM e JOIN t ON t.vec_id = e.vec_id AND abs(t.x - e.x) <= 1 AND abs(t.y - e.y) <= 1 WHERE t.size > {EDGE[0]})
        SELECT vec_id, count(*) AS n, sum(x + 8 * y)::BIGINT AS places FROM e GROUP BY 1""",
    "point_patches": f"""WITH {_F}, q AS (SELECT *, (vec_id % 17 - 5)::INT AS x, (vec_id % 13 - 4)::INT AS y FROM f), o AS (SELECT vec_id, [v[k + 1] for k in range(64) if k % 8 >= x - 3 AND k % 8 < x + 3 AND k // 8 >= y - 3 AND k // 8 < y + 3] AS patch FROM q)
        SELECT vec_id, len(patch)::INT AS n, {_check("patch")} FROM o WHERE len(patch) > 0""",
    "line_votes": f"WITH {_VT} SELECT image_id, theta, rho, votes FROM bl",
    "line_segments": f"""WITH {_VT}, o AS (SELECT ed.*, theta, rho, round(y * cos(radians(theta::DOUBLE)) - x * sin(radians(theta::DOUBLE)), 6) AS along FROM ed JOIN bl USING (image_id) WHERE {_RHO} = rho),
        c AS (SELECT *, CASE WHEN along - lag(along) OVER w > 6 THEN 1 ELSE 0 END AS cut FROM o WINDOW w AS (PARTITION BY image_id ORDER BY along, x, y)),
        s AS (SELECT *, (sum(cut) OVER (PARTITION BY image_id ORDER BY along, x, y))::INT AS segment FROM c),
        e AS (SELECT *, row_number() OVER (PARTITION BY image_id, segment ORDER BY along, x, y) AS up, row_number() OVER (PARTITION BY image_id, segment ORDER BY along DESC, x DESC, y DESC) AS down FROM s),
        g AS (SELECT image_id, segment, max(CASE WHEN up = 1 THEN x END) AS x1, max(CASE WHEN up = 1 THEN y END) AS y1, max(CASE WHEN down = 1 THEN x END) AS x2, max(CASE WHEN down = 1 THEN y END) AS y2, max(along) - min(along) AS length, count(*) AS n FROM e GROUP BY 1, 2)
        SELECT image_id, segment, x1, y1, x2, y2, n FROM g WHERE length >= 5""",
    "contour_measures": f"WITH {_CM} SELECT image_id, contour, n_points, round(area, 3) AS area, round(perimeter, 3) AS perimeter FROM cm",
    "largest_contours": f"WITH {_CM}, r AS (SELECT image_id, contour, round(area, 3) AS area, row_number() OVER (PARTITION BY image_id ORDER BY round(area, 3) DESC, contour) AS pos FROM cm) SELECT image_id, contour, area FROM r WHERE pos = 1",
    "round_contours": f"""WITH {_CM}, c AS (SELECT image_id, contour, n_points, round(CASE WHEN area > 0 AND perimeter > 0 THEN 4 * pi() * area / (perimeter * perimeter) END, 6) AS circularity FROM cm),
        l AS (SELECT *, {ROUND}::DOUBLE * avg(circularity) OVER (PARTITION BY image_id) AS least FROM c) SELECT image_id, contour, n_points, circularity FROM l WHERE n_points = 1 OR circularity >= least""",
    "sheet_cells": """WITH i AS (SELECT l_orderkey AS image_id, l_linenumber - 1 AS step_no, max(l_quantity) AS w, max(l_discount) * 1000 AS h FROM lineitem GROUP BY 1, 2),
        s AS (SELECT *, least(360.0::DOUBLE / w, 240.0::DOUBLE / h) AS scale FROM i WHERE w > 0 AND h > 0)
        SELECT image_id, step_no, (step_no // 4)::INT AS cell_row, (step_no % 4)::INT AS cell_column, (step_no % 4 * 400)::INT AS x0, (step_no // 4 * 300)::INT AS y0, floor(w * scale)::INT AS shown_w, floor(h * scale)::INT AS shown_h FROM s""",
    "video_metadata": "WITH v AS (SELECT user_id, max(20.0::DOUBLE + user_id % 11 + 0.9::DOUBLE) AS fps, count(*) AS frame_count FROM events GROUP BY 1) SELECT *, floor(fps / 3.0::DOUBLE)::INT AS frame_interval FROM v",
}


def queries() -> dict:
    return {name: globals()[name] for name in [*ORACLES, "selected_pixels"]}
