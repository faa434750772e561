"""Registered queries on outlines of masks and ellipses through contours, with their oracle SQL.

Stand-ins: parts on a coarse grid are the set pixels of an image (its type); an embedding's absolute values over
their own threshold are a mask of 8 x 8; parts of a brand are the points of a contour.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.catalog_pixels import _CM, _ED, _F, _RHO, SIZE, VOTES, _edge_pixels, _frames
from crestline.operators import contours as C
from crestline.operators import denoise as N
from crestline.operators import equalise as E
from crestline.operators import rasters as T
from crestline.session import table

#: Times the mean of a tile's histogram that a value may have.
LIMIT = 40.0
#: Lines of an image at most.
MOST = 5
#: Root of the mean squared difference of patches that weighs 1/e.
STRENGTH = 40.0


def _mask(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return p.select(F.col("p_type").alias("image_id"), F.floor(F.col("p_size") / 2).cast("int").alias("x"), F.floor((F.col("p_retailprice") - 900) / 4).cast("int").alias("y"))


def traced_contours(spark, root):
    """The points of the outer outlines of each image's mask, in order."""
    return C.trace(_mask(spark, root), "image_id")


def traced_measures(spark, root):
    """Area and perimeter of the outlines of frames over their own threshold, those of holes among them."""
    pixels = _frames(spark, root).select("vec_id", F.posexplode("v").alias("i", "p"))
    over = pixels.join(T.otsu(pixels, "vec_id", "p"), "vec_id").where(F.col("p") > F.col("threshold"))
    mask = over.select("vec_id", (F.col("i") % SIZE).alias("x"), F.floor(F.col("i") / SIZE).cast("int").alias("y"))
    return T.contour_measures(C.trace(mask, "vec_id", external=False), "vec_id", "contour", "k").select("vec_id", "contour", "n_points", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


def fitted_ellipses(spark, root):
    """The ellipse through the points of each contour; null where there is none."""
    p = table(spark, root, "part").select(F.col("p_type").alias("image_id"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("contour"), F.col("p_size").alias("x"), (F.col("p_retailprice") - 900).alias("y"))
    return C.fit_ellipses(p, ["image_id", "contour"]).select("image_id", "contour", "n_points", *[F.round(c, 3).alias(c) for c in ("cx", "cy", "w", "h", "angle")])


def pixel_areas(spark, root):
    """Pixels of the image that each ellipse covers, turned and partly beside the image (0 without an axis); and the features' density over them."""
    from crestline.catalog import HEIGHT, _dims, _ellipses, _points
    from crestline.functions import geometry as G
    from crestline.operators import features

    e = _ellipses(spark, root).withColumn("cx", F.col("cx") * 1.5).withColumn("w", F.col("w") * 1.7)
    area = G.pixel_area(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")), *_dims())
    found = features.hits(_points(spark, root), e, *_dims(), cell=8.0, largest=HEIGHT).groupBy("image_id", "ord").agg(F.count("*").alias("n"))
    measured = e.select("image_id", "ord", F.coalesce(area, F.lit(0)).alias("pixels")).join(found, ["image_id", "ord"], "left")
    return measured.select("image_id", "ord", "pixels", F.round(features.density(F.coalesce("n", F.lit(0)), F.col("pixels").cast("double")), 6).alias("density"))


def equalised_frames(spark, root):
    """Frames with their histogram equalised in two by two tiles; a checksum of values and places."""
    pixels = _frames(spark, root).select("vec_id", F.posexplode("v").alias("i", "v"))
    placed = pixels.select("vec_id", (F.col("i") % SIZE).alias("x"), F.floor(F.col("i") / SIZE).cast("int").alias("y"), "v")
    done = E.equalised(placed, "vec_id", SIZE, SIZE, (2, 2), LIMIT)
    return done.groupBy("vec_id").agg(F.sum((F.col("equalised") * (F.col("y") * SIZE + F.col("x") + 1)).cast("long")).alias("equalised"), F.max("equalised").alias("brightest"))


def denoised_frames(spark, root):
    """Frames by non-local means, with patches of 3 and a search of 5 pixels; a checksum of values and places."""
    pixels = _frames(spark, root).select("vec_id", F.posexplode("v").alias("i", "v"))
    placed = pixels.select("vec_id", (F.col("i") % SIZE).alias("x"), F.floor(F.col("i") / SIZE).cast("int").alias("y"), "v")
    done = N.denoised(placed, "vec_id", SIZE, SIZE, STRENGTH, 3, 5)
    return done.groupBy("vec_id").agg(F.sum((F.col("denoised") * (F.col("y") * SIZE + F.col("x") + 1)).cast("long")).alias("denoised"))


def many_segments(spark, root):
    """The best lines of each image, each without the points of those before, as segments."""
    lines, owned = T.many_lines(_edge_pixels(spark, root), "image_id", VOTES, MOST)
    return T.owned_segments(owned, lines, "image_id", least=5.0, gap=30.0).join(lines.select("image_id", "line", "votes"), ["image_id", "line"])


# --- oracle SQL: walks around every side, a flood from outside, determinants ------------------

_STEP = ((1, 0), (0, 1), (-1, 0), (0, -1))  # along the sides above, right, below, left; outwards is the one before
_SIDES = "VALUES " + ", ".join(f"({d}, {_STEP[d][0]}, {_STEP[d][1]}, {_STEP[d - 1][0]}, {_STEP[d - 1][1]})" for d in range(4))


def _outlines(mask: str, external: bool, simple: bool = True) -> str:
    """CTEs after `m` (image_id, x, y): `pt` has image_id, contour, k, x, y."""
    has = "EXISTS (SELECT 1 FROM m WHERE m.image_id = s.image_id AND m.x = s.x + {0} AND m.y = s.y + {1})"
    surrounded = "" if not external else "AND (w.image_id, w.x0, w.y0 - 1) IN (SELECT (image_id, x, y) FROM o)"
    return f"""m AS MATERIALIZED ({mask}), d(d, ax, ay, ox, oy) AS ({_SIDES}),
s AS MATERIALIZED (SELECT m.image_id, m.x, m.y, d, ax, ay, ox, oy FROM m, d WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.image_id = m.image_id AND n.x = m.x + ox AND n.y = m.y + oy)),
nx AS MATERIALIZED (SELECT image_id, x, y, d, CASE WHEN {has.format("ax + ox", "ay + oy")} THEN (x + ax + ox, y + ay + oy, (d + 3) % 4) WHEN {has.format("ax", "ay")} THEN (x + ax, y + ay, d) ELSE (x, y, (d + 1) % 4) END AS z FROM s),
b AS (SELECT image_id, min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1 FROM m GROUP BY 1),
o AS (SELECT image_id, x0 AS x, y0 AS y FROM b UNION SELECT o.image_id, o.x + ax, o.y + ay FROM o JOIN b USING (image_id), d
  WHERE o.x + ax BETWEEN x0 AND x1 AND o.y + ay BETWEEN y0 AND y1 AND NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = o.image_id AND m.x = o.x + ax AND m.y = o.y + ay)),
w AS (SELECT image_id, x AS x0, y AS y0, d AS d0, x, y, d, 0 AS n FROM s {"WHERE d = 0" if external else ""}
  UNION ALL SELECT w.image_id, x0, y0, d0, z[1], z[2], z[3], n + 1 FROM w JOIN nx ON nx.image_id = w.image_id AND nx.x = w.x AND nx.y = w.y AND nx.d = w.d WHERE z <> (x0, y0, d0)),
f AS (SELECT image_id, x0, y0, d0 FROM w GROUP BY ALL HAVING min((y, x, d)) = (y0, x0, d0)),
c AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY y0, x0, d0) - 1)::INT AS contour FROM f w WHERE true {surrounded}),
r AS (SELECT image_id, contour, x, y, row_number() OVER (PARTITION BY image_id, contour ORDER BY CASE WHEN n = 0 THEN 0 ELSE 1 END, n DESC) AS k FROM c JOIN w USING (image_id, x0, y0, d0)),
u AS (SELECT * FROM (SELECT *, lag((x, y)) OVER (PARTITION BY image_id, contour ORDER BY k) AS p FROM r) WHERE p IS NULL OR p <> (x, y)),
l AS (SELECT *, row_number() OVER v AS q, count(*) OVER (PARTITION BY image_id, contour) AS t, first((x, y)) OVER (PARTITION BY image_id, contour ORDER BY k) AS h FROM u WINDOW v AS (PARTITION BY image_id, contour ORDER BY k)),
e AS (SELECT image_id, contour, x, y, q FROM l WHERE NOT (q = t AND t > 1 AND h = (x, y))),
g AS (SELECT a.*, n.x - a.x AS tx, n.y - a.y AS ty, a.x - p.x AS fx, a.y - p.y AS fy, z.t FROM e a JOIN (SELECT image_id, contour, count(*) AS t FROM e GROUP BY ALL) z USING (image_id, contour)
  JOIN e n ON n.image_id = a.image_id AND n.contour = a.contour AND n.q = a.q % t + 1 JOIN e p ON p.image_id = a.image_id AND p.contour = a.contour AND p.q = (a.q + t - 2) % t + 1),
pt AS (SELECT image_id, contour, (row_number() OVER (PARTITION BY image_id, contour ORDER BY q) - 1)::INT AS k, x, y FROM g WHERE t = 1 OR tx <> fx OR ty <> fy)"""


def _determinant(rows: list[list[str]]) -> str:
    total = []
    for p in itertools.permutations(range(len(rows))):
        odd = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2
        total.append(("- " if odd else "+ ") + " * ".join(rows[i][j] for i, j in enumerate(p)))
    return "(0 " + " ".join(total) + ")"


def _by_determinants(m: list[list[str]], b: list[str], name: str) -> str:
    whole = _determinant(m)
    return ", ".join(f"{_determinant([[b[i] if j == k else m[i][j] for j in range(len(b))] for i in range(len(b))])} / {whole} AS {name}{k}" for k in range(len(b)))


_TERMS = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1)]
_S = "sum(pow(u, {0}) * pow(v, {1})) AS s{0}{1}"
_ABOUT = "sum(pow(u - u0, {0}) * pow(v - v0, {1})) AS s{0}{1}"
_ELLIPSES = f"""{_CM}, me AS (SELECT image_id, contour, count(*) AS n_points, avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x) + var_pop(y)) AS unit FROM cp GROUP BY 1, 2),
ce AS (SELECT image_id, contour, n_points, mx, my, unit, (x - mx) / unit AS u, (y - my) / unit AS v FROM cp JOIN me USING (image_id, contour) WHERE n_points >= 5),
s1 AS (SELECT image_id, contour, {", ".join(_S.format(i, j) for i, j in C.POWERS)} FROM ce GROUP BY 1, 2),
q1 AS (SELECT image_id, contour, {_by_determinants([[f"s{a[0] + b[0]}{a[1] + b[1]}" for b in _TERMS] for a in _TERMS], [f"s{i}{j}" for i, j in _TERMS], "q")} FROM s1),
q2 AS (SELECT *, (q1 * q4 - 2 * q2 * q3) / (4 * q0 * q2 - q1 * q1) AS u0, (q1 * q3 - 2 * q0 * q4) / (4 * q0 * q2 - q1 * q1) AS v0 FROM q1 WHERE 4 * q0 * q2 - q1 * q1 > 0),
s2 AS (SELECT image_id, contour, mx, my, unit, u0, v0, {", ".join(_ABOUT.format(i, j) for i, j in C.POWERS if i + j in (2, 4))} FROM ce JOIN q2 USING (image_id, contour) GROUP BY ALL),
r1 AS (SELECT *, {_by_determinants([[f"s{a[0] + b[0]}{a[1] + b[1]}" for b in _TERMS[:3]] for a in _TERMS[:3]], [f"s{i}{j}" for i, j in _TERMS[:3]], "r")} FROM s2),
r2 AS (SELECT *, (r0 + r2) / 2 AS mean, sqrt(pow((r0 - r2) / 2, 2) + pow(r1 / 2, 2)) AS half FROM r1),
el AS (SELECT image_id, contour, mx + unit * u0 AS cx, my + unit * v0 AS cy, 2 * unit / sqrt(mean + half) AS w, 2 * unit / sqrt(mean - half) AS h, degrees(atan2(r1, r0 - r2)) / 2 AS turn FROM r2 WHERE mean - half > 0)"""
_OTSU = f"""{_F}, px AS (SELECT vec_id, unnest(v) AS p, unnest(range(64)) AS i FROM f), hi AS (SELECT vec_id, t, count(CASE WHEN p <= t THEN 1 END) AS b, sum(CASE WHEN p <= t THEN p ELSE 0 END) AS ms, count(*) AS n, sum(p) AS s FROM px, range(256) r(t) GROUP BY 1, 2),
ap AS (SELECT vec_id, t, CASE WHEN b > 0 AND b < n THEN pow(s::DOUBLE * b / n - ms, 2) / (b * (n - b)) ELSE 0 END AS apart FROM hi), th AS (SELECT vec_id, t FROM (SELECT vec_id, t, row_number() OVER (PARTITION BY vec_id ORDER BY apart DESC, t) AS pos FROM ap) WHERE pos = 1)"""

_MIRROR = "(7 - abs(7 - abs({0})))"
_VOTED = "(SELECT image_id, theta::INT AS theta, {rho} AS rho, count(*) AS votes FROM p{n}, range(180) t(theta) GROUP BY 1, 2, 3)"
_ROUNDS = ", ".join(
    f"""p{n} AS MATERIALIZED ({"SELECT * FROM ed" if not n else f"SELECT p{n - 1}.* FROM p{n - 1} LEFT JOIN b{n - 1} USING (image_id) WHERE theta IS NULL OR {_RHO} <> rho"}),
b{n} AS MATERIALIZED (SELECT image_id, theta, rho, votes FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, theta, rho) AS pos FROM {_VOTED.format(rho=_RHO, n=n)} WHERE votes >= {VOTES}) WHERE pos = 1)"""
    for n in range(MOST)
) + ", ow AS (" + " UNION ALL ".join(f"SELECT image_id, {n}::INT AS line, theta, rho, votes, x, y FROM p{n} JOIN b{n} USING (image_id) WHERE {_RHO} = rho" for n in range(MOST)) + ")"

ORACLES = {
    "traced_contours": f"WITH RECURSIVE {_outlines('SELECT DISTINCT p_type AS image_id, (p_size // 2)::INT AS x, floor((p_retailprice - 900) / 4)::INT AS y FROM part', True)} SELECT image_id, contour, k, x, y FROM pt",
    "traced_measures": f"""WITH RECURSIVE {_OTSU.replace("f AS (", "fr AS (").replace("FROM f)", "FROM fr)")}, {_outlines("SELECT vec_id AS image_id, (i % 8)::INT AS x, (i // 8)::INT AS y FROM px JOIN th USING (vec_id) WHERE p > t", False)},
        an AS (SELECT *, coalesce(lead(x) OVER v, first(x) OVER v) AS ax, coalesce(lead(y) OVER v, first(y) OVER v) AS ay FROM pt WINDOW v AS (PARTITION BY image_id, contour ORDER BY k))
        SELECT image_id AS vec_id, contour, count(*) AS n_points, round((abs(sum(x * ay - y * ax)) / 2)::DOUBLE, 3) AS area, round(sum(sqrt(pow(ax - x, 2) + pow(ay - y, 2))), 3) AS perimeter FROM an GROUP BY 1, 2""",
    "many_segments": f"""WITH {_ED}, {_ROUNDS}, o AS (SELECT *, round(y * cos(radians(theta::DOUBLE)) - x * sin(radians(theta::DOUBLE)), 6) AS along FROM ow),
        c AS (SELECT *, CASE WHEN along - lag(along) OVER w > 30 THEN 1 ELSE 0 END AS cut FROM o WINDOW w AS (PARTITION BY image_id, line ORDER BY along, x, y)),
        s AS (SELECT *, (sum(cut) OVER (PARTITION BY image_id, line ORDER BY along, x, y))::INT AS segment FROM c)
        SELECT image_id, line, theta, rho, segment, first(x ORDER BY along, x, y) AS x1, first(y ORDER BY along, x, y) AS y1, last(x ORDER BY along, x, y) AS x2, last(y ORDER BY along, x, y) AS y2, count(*) AS n, votes
        FROM s GROUP BY image_id, line, theta, rho, segment, votes HAVING max(along) - min(along) >= 5""",
    "denoised_frames": f"""WITH {_F}, g AS (SELECT i, x, y, tx, ty, dx, dy, {_MIRROR.format("y + ty")} * 8 + {_MIRROR.format("x + tx")} AS a, {_MIRROR.format("y + ty + dy")} * 8 + {_MIRROR.format("x + tx + dx")} AS b
          FROM (SELECT i, (i % 8)::INT AS x, (i // 8)::INT AS y, tx, ty, dx, dy FROM range(64) t(i), range(-1, 2) p(tx), range(-1, 2) q(ty), range(-2, 3) r(dx), range(-2, 3) s(dy))),
        d AS (SELECT vec_id, i, dx, dy, sum((v[a + 1] - v[b + 1]) * (v[a + 1] - v[b + 1]))::DOUBLE AS away, max(CASE WHEN tx = 0 AND ty = 0 THEN v[b + 1] END) AS other FROM f, g GROUP BY ALL),
        w AS (SELECT vec_id, i, exp(-(away / 9) / {STRENGTH * STRENGTH}::DOUBLE) AS k, other FROM d)
        SELECT vec_id, sum(z * (i + 1))::BIGINT AS denoised FROM (SELECT vec_id, i, round_even(sum(k * other) / sum(k), 0)::BIGINT AS z FROM w WHERE k >= {N.LEAST} GROUP BY 1, 2) GROUP BY 1""",
    "equalised_frames": f"""WITH {_F}, p AS (SELECT vec_id, unnest(v) AS v, unnest(range(64)) AS i FROM f), q AS (SELECT *, (i % 8)::INT AS x, (i // 8)::INT AS y FROM p),
        h AS (SELECT vec_id, x // 4 AS tx, y // 4 AS ty, v, count(*) AS n FROM q GROUP BY ALL), o AS (SELECT vec_id, tx, ty, sum(greatest(n - {int(LIMIT * 16 / 256)}, 0))::BIGINT AS over FROM h GROUP BY ALL),
        r AS (SELECT *, over // 256 AS each, over % 256 AS rest, greatest(256 // greatest(over % 256, 1), 1) AS step FROM o),
        m AS (SELECT r.vec_id, r.tx, r.ty, k, least(round_even((coalesce(sum(least(n, {int(LIMIT * 16 / 256)})) FILTER (h.v <= k), 0) + each * (k + 1) + least(k // step + 1, rest)) * (255.0::DOUBLE / 16), 0), 255)::INT AS new
          FROM r JOIN h ON h.vec_id = r.vec_id AND h.tx = r.tx AND h.ty = r.ty, range(256) t(k) GROUP BY r.vec_id, r.tx, r.ty, k, each, rest, step),
        c AS (SELECT *, floor(x / 4.0::DOUBLE - 0.5) AS fx, floor(y / 4.0::DOUBLE - 0.5) AS fy FROM q), w AS (SELECT *, x / 4.0::DOUBLE - 0.5 - fx AS ax, y / 4.0::DOUBLE - 0.5 - fy AS ay FROM c),
        e AS (SELECT w.vec_id, i, round_even(sum(new * CASE WHEN b.k = 0 THEN 1 - ax ELSE ax END * CASE WHEN d.k = 0 THEN 1 - ay ELSE ay END), 6) AS z
          FROM w, (VALUES (0), (1)) b(k), (VALUES (0), (1)) d(k), m WHERE m.vec_id = w.vec_id AND m.k = w.v AND m.tx = least(greatest(fx + b.k, 0), 1) AND m.ty = least(greatest(fy + d.k, 0), 1) GROUP BY w.vec_id, i)
        SELECT vec_id, sum(round_even(z, 0)::BIGINT * (i + 1))::BIGINT AS equalised, max(round_even(z, 0)::INT) AS brightest FROM e GROUP BY 1""",
    "fitted_ellipses": f"""WITH {_ELLIPSES} SELECT image_id, contour, n_points, {", ".join(f"round({c}, 3) AS {c}" for c in ("cx", "cy", "w", "h"))}, round(CASE WHEN turn < 0 THEN turn + 180 ELSE turn END, 3) AS angle
        FROM me LEFT JOIN el USING (image_id, contour)""",
}


def areas_oracle(points: str, inside: str) -> str:
    """Every pixel of the image against every ellipse; `points` and `inside` are the CTEs and the test of ellipses and points."""
    return f"""WITH {points}, big AS (SELECT image_id, ord, cx * 1.5::DOUBLE AS cx, cy, w * 1.7::DOUBLE AS w, h, angle FROM el),
        gx AS (SELECT a.range::DOUBLE AS x, b.range::DOUBLE AS y FROM range(51) a, range(101) b),
        ar AS (SELECT image_id, ord, count(*) AS pixels FROM big el, gx WHERE {inside.format(p="gx")} GROUP BY 1, 2),
        nh AS (SELECT el.image_id, ord, count(*) AS n FROM big el JOIN pt ON el.image_id = pt.image_id AND {inside.format(p="pt")} GROUP BY 1, 2)
        SELECT image_id, ord, coalesce(pixels, 0)::BIGINT AS pixels, round(CASE WHEN pixels > 0 AND w > 0 AND h > 0 THEN 10.0::DOUBLE * coalesce(n, 0) * coalesce(n, 0) / pixels ELSE 0 END, 6) AS density
        FROM big LEFT JOIN ar USING (image_id, ord) LEFT JOIN nh USING (image_id, ord)"""


def queries() -> dict:
    return {name: globals()[name] for name in [*ORACLES, "pixel_areas"]}
