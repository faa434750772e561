"""From still images to the ellipse that holds most features, and the crop around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions import geometry as G
from crestline.functions import images as I
from crestline.functions import quality as Q
from crestline.operators import detection, features
from crestline.operators import rasters as R


def ready(images: DataFrame) -> DataFrame:
    """image_id, image, sharpness, band, original: each image blurred or sharpened as its sharpness asks."""
    measured = images.where(F.col("image").isNotNull()).withColumn("sharpness", I.sharpness(F.col("image"))).withColumn("band", Q.sharpness_band(F.col("sharpness")))
    return measured.select("image_id", I.apply_band(F.col("image"), F.col("band")).alias("image"), "sharpness", "band", F.col("image").alias("original"))


def best_ellipses(images: DataFrame, padding: int = 100, surf_circularity: float = 0.5, fast_circularity: float = 0.4, line_votes: int = 100, **limits) -> DataFrame:
    """One row per image that has a candidate: its best ellipse, whether that is the fallback, scores and the crop box.

    The two kinds of corners differ in roundness only: each corner is found once and listed for every kind that it fits.
    """
    prepared = ready(images).select("image_id", "image")
    points = detection.corners(prepared, least_circularity=min(surf_circularity, fast_circularity))
    fits = lambda kind, least: F.when(R.round_enough(F.col("circularity"), F.col("failed"), least), F.lit(kind))
    corners = points.select("image_id", F.explode(F.array_compact(F.array(fits("surf", surf_circularity), fits("fast", fast_circularity)))).alias("kind"), "x", "y")
    every = corners.unionByName(features.stack(line=features.line_ends(detection.lines(prepared, threshold=line_votes))))
    size = images.select("image_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    candidates = detection.ellipses(prepared, **limits).join(size, "image_id")
    scored = features.scores(candidates, every, F.col("width"), F.col("height"))
    best = features.best_ellipse(scored)
    return best.withColumn("box", G.crop_box(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle", "width", "height")), padding=padding))


def crops(images: DataFrame, best: DataFrame) -> DataFrame:
    """image_id and the crop of the original; images without an ellipse stay whole."""
    boxed = images.join(best.select("image_id", "box"), "image_id", "left")
    return boxed.select("image_id", F.when(F.col("box").isNull(), F.col("image")).otherwise(I.crop(F.col("image"), F.col("box"))).alias("image"))
