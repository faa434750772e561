"""Features in ellipses: spatial joins, densities, scores, the best ellipse and its fallback.

Keypoints, line ends and ellipses meet on image_id and a grid cell of it, with the exact test as
residual, so that an image with very many of both is spread over its cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.functions import geometry as G


def line_ends(lines: DataFrame) -> DataFrame:
    """Two points of each line: image_id, x, y."""
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    return lines.select("image_id", ends.alias("p")).select("image_id", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))


def stack(**kinds: DataFrame) -> DataFrame:
    """All feature sets as one, by kind; a point of two kinds counts twice."""
    out = None
    for kind, df in kinds.items():
        part = df.select("image_id", F.lit(kind).alias("kind"), "x", "y")
        out = part if out is None else out.unionByName(part)
    return out


#: Pixels across the cells of the coarsest grid; in an image that is larger an ellipse may have more than four of them.
LARGEST = 65_536


def hits(points: DataFrame, ellipses: DataFrame, width: Column, height: Column, cell: float | None = 256.0, largest: int = LARGEST) -> DataFrame:
    """A row for each point and ellipse of one image that holds it: the ellipse's columns, then the point's.

    Grids of doubling cells lie over an image, the finest of `cell` pixels. An ellipse goes to the grid whose
    cells are as large as what the image has of its bounding square, so to four cells at most; a point asks its
    cell in each grid, of which there are as many as doublings from `cell` to `largest`, the longest side that images
    have. `cell` None joins on the image alone. Width and height may be columns of the ellipses.

    Points pass the ellipses of their cell, which are hashed, and are never broadcast: Spark takes their size for that
    of the file, however many rows come of each.
    """
    e = ellipses.where(G.valid(F.col("w"), F.col("h")))
    test = G.inside(*(F.col(c) for c in ("x", "y", "cx", "cy", "w", "h", "angle")), width, height)
    p = points.withColumnRenamed("image_id", "__image")
    if cell is None:
        return e.hint("shuffle_hash").join(p, (F.col("image_id") == F.col("__image")) & test).drop("__image")
    e = cells_of(e, width, height, cell, largest)
    p = p.withColumn("__pl", F.explode(F.sequence(F.lit(0), F.lit(_levels(cell, largest)))))
    side = cell * F.pow(F.lit(2.0), F.col("__pl"))
    p = p.withColumn("__px", F.floor(G.whole(F.col("x")) / side)).withColumn("__py", F.floor(G.whole(F.col("y")) / side))
    on = (F.col("image_id") == F.col("__image")) & (F.col("__level") == F.col("__pl")) & (F.col("__gx") == F.col("__px")) & (F.col("__gy") == F.col("__py"))
    return e.hint("shuffle_hash").join(p, on & test).drop("__image", "__level", "__gx", "__gy", "__pl", "__px", "__py")


def _levels(cell: float, largest: int) -> int:
    return max(0, math.ceil(math.log2(largest / cell)))


def cells_of(ellipses: DataFrame, width: Column, height: Column, cell: float, largest: int = LARGEST) -> DataFrame:
    """A row for each of the at most four cells that an ellipse has in its grid: __level, __gx, __gy. One beside the image has none."""
    reach = F.greatest("w", "h") / 2 + 1
    low = {c: F.floor(F.greatest(F.col(c) - reach, F.lit(0.0))) for c in ("cx", "cy")}
    high = {c: F.floor(F.least(F.col(c) + reach, size.cast("double") - 1)) for c, size in (("cx", width), ("cy", height))}
    e = ellipses.where((low["cx"] <= high["cx"]) & (low["cy"] <= high["cy"]))
    extent = F.greatest(*[high[c] - low[c] + 1 for c in ("cx", "cy")]).cast("double")
    e = e.withColumn("__level", F.least(F.greatest(F.ceil(F.log2(extent / cell)), F.lit(0)), F.lit(_levels(cell, largest))).cast("int"))
    side = cell * F.pow(F.lit(2.0), F.col("__level"))
    for c, out in (("cx", "__gx"), ("cy", "__gy")):
        e = e.withColumn(out, F.explode(F.sequence(F.floor(low[c] / side), F.floor(high[c] / side))))
    return e


def centre_weight(x: Column, y: Column, width: Column, height: Column, weight: float = 2.0) -> Column:
    """1 at a full diagonal's distance from the image's centre, `weight` at the centre."""
    away = F.try_divide(F.hypot(x - F.floor(width / 2), y - F.floor(height / 2)), F.hypot(width.cast("double"), height.cast("double")))
    return 1 + (weight - 1) * (1 - away)


def density(n: Column, area: Column) -> Column:
    """n squared over a tenth of the area."""
    return F.when(area > 0, 10.0 * n * n / area).otherwise(0.0)


def scores(ellipses: DataFrame, points: DataFrame, width: Column, height: Column, surf: str = "surf", has_surf: bool = True,
           least_area: float = 500.0, least_surf: int = 3, least_score: float = 5.0, centre_bias: float = 0.02, surf_weight: float = 5.0, largest: int = LARGEST) -> DataFrame:
    """Each ellipse (image_id, ord) with n_hits, n_surf, density, centre_score, feature_score, score and whether it qualifies.

    An ellipse without hits keeps counts of 0. Without surf features their minimum does not apply.
    """
    found = hits(points, ellipses, width, height, largest=largest).groupBy("image_id", "ord").agg(
        F.count("*").alias("__n"),
        F.count(F.when(F.col("kind") == surf, 1)).alias("__s"),
        F.sum(F.when(F.col("kind") == surf, centre_weight(F.col("x"), F.col("y"), width, height))).alias("__c"),
    )
    e = ellipses.where(G.valid(F.col("w"), F.col("h"))).join(found, ["image_id", "ord"], "left")
    e = e.withColumn("n_hits", F.coalesce("__n", F.lit(0))).withColumn("n_surf", F.coalesce("__s", F.lit(0))).withColumn("centre_score", F.coalesce("__c", F.lit(0.0))).drop("__n", "__s", "__c")
    e = e.withColumn("density", density(F.col("n_hits"), G.true_area(F.col("w"), F.col("h"))))
    e = e.withColumn("feature_score", F.col("density") * 10_000 + F.col("centre_score") * surf_weight)
    away = F.hypot(F.col("cx") - F.floor(width / 2), F.col("cy") - F.floor(height / 2))
    e = e.withColumn("score", F.col("feature_score") - away * centre_bias)
    enough = (F.col("n_surf") >= least_surf) if has_surf else F.lit(True)
    return e.withColumn("qualifies", (G.listed_area(F.col("w"), F.col("h")) >= least_area) & enough & (F.col("feature_score") >= least_score) & ~F.isnan("score"))


def best_ellipse(scored: DataFrame) -> DataFrame:
    """Of each image the qualifying ellipse with the greatest score, else the one with the largest w * h; the earliest of equals."""
    w = Window.partitionBy("image_id").orderBy(F.col("qualifies").desc(), F.when(F.col("qualifies"), F.col("score")).otherwise(F.col("w") * F.col("h")).desc(), "ord")
    return scored.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at").withColumn("fallback", ~F.col("qualifies"))


def compare(scored: DataFrame, best: DataFrame) -> DataFrame:
    """Every ellipse with whether it is its image's best."""
    b = best.select("image_id", F.col("ord").alias("__best"))
    return scored.join(b, "image_id", "left").withColumn("is_best", F.coalesce(F.col("ord") == F.col("__best"), F.lit(False))).drop("__best")


def first_match(detections: DataFrame, group: str, order: list[str], confidence: Column, above: float = 0.6) -> DataFrame:
    """The first detection of each group whose confidence is over the bound."""
    w = Window.partitionBy(group).orderBy(*order)
    return detections.where(confidence > above).withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def debug_order(images: DataFrame, names: tuple[str, ...], most: int = 12) -> DataFrame:
    """Step images in the fixed order of their names, numbered from 0; null images go but keep their number; at most so many cells."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("step_name"))
    w = Window.partitionBy("image_id").orderBy(place)
    numbered = images.where(place > 0).withColumn("step_no", (F.row_number().over(w) - 1).cast("int"))
    return numbered.where((F.col("step_no") < most) & F.col("image").isNotNull())
