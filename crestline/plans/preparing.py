"""Frames made ready to be measured, by relations and expressions alone: equalised, denoised, sharpened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions import rasters as R
from crestline.operators.denoise import denoised
from crestline.operators.equalise import equalised


def prepared(frames: DataFrame, frame: str, width: int, height: int, tiles: tuple[int, int] = (8, 8), limit: float = 2.0, strength: float = 10.0, patch: int = 7, search: int = 21) -> DataFrame:
    """frame, v of gray frames (frame, v: pixels 0..255 row by row) of one size.

    Frames are dealt out once, before they become pixels, in as many parts as the session's shuffles have (it is little data for
    much work, so that parts are not merged); pixels stay in their frame's part.
    """
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pixels = frames.select(frame, "v").repartition(parts, frame).select(frame, F.posexplode("v").alias("i", "v")).select(frame, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "v")
    even = equalised(pixels, frame, width, height, tiles, limit).select(frame, "x", "y", F.col("equalised").alias("v"))
    calm = denoised(even, frame, width, height, strength, patch, search)
    placed = F.array_sort(F.collect_list(F.struct((F.col("y") * width + F.col("x")).alias("i"), F.col("denoised").alias("v"))))
    whole = calm.groupBy(frame).agg(F.transform(placed, lambda p: p["v"]).alias("v"))
    return whole.select(frame, R.filter2d(F.col("v"), width, height, R.SHARPEN_FRAME).alias("v"))
