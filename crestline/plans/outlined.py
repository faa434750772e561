"""From the edge pixels and keypoints of still images to the ellipse that holds most features, by relations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions import geometry as G
from crestline.operators import contours as C
from crestline.operators import features
from crestline.operators import rasters as R
from crestline.session import durable


def candidates(edges: DataFrame, digits: int = 3, **limits) -> DataFrame:
    """image_id, ord, cx, cy, w, h, angle, points of the ellipses through the outer outlines of edge pixels (image_id, x, y) that are worth scoring.

    `limits` are those of geometry.candidate().
    """
    fitted = C.fit_ellipses(C.trace(edges, "image_id"), ["image_id", "contour"])
    named = fitted.select("image_id", F.col("contour").alias("ord"), *[F.round(c, digits).alias(c) for c in ("cx", "cy", "w", "h", "angle")], F.col("n_points").cast("int").alias("points"))
    return named.where(G.candidate(F.col("points"), F.col("w"), F.col("h"), **limits))


def best_outlined(edges: DataFrame, keypoints: DataFrame, width: Column, height: Column, votes: int = 100, lines: int = 50, least_length: float = 20.0, gap: float = 10.0, padding: int = 100,
                  scoring: dict | None = None, **limits) -> DataFrame:
    """Of each image with a candidate its best ellipse, whether that is the fallback, its scores and the crop box.

    Features are keypoints (image_id, kind, x, y) and the ends of line segments among the edge pixels.
    Edge pixels are outlined and voted for on their own; what meets in the end are a row an ellipse and a row a feature.
    """
    found, owned = R.many_lines(edges, "image_id", votes, lines)
    segments = R.owned_segments(owned, found, "image_id", least_length, gap)
    every = keypoints.select("image_id", "kind", "x", "y").unionByName(features.stack(line=features.line_ends(segments)))
    scored = features.scores(durable(candidates(edges, **limits)), every, width, height, **(scoring or {}))
    best = features.best_ellipse(scored)
    return best.withColumn("box", G.crop_box(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")), width, height, padding=padding))
