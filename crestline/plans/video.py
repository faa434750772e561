"""From the frames of videos to their representative frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crestline.functions import images as I
from crestline.functions import quality as Q
from crestline.operators import features
from crestline.operators import frames as O


def representative_frames(frames: DataFrame, fps: str = "fps", target_fps: float = 1.0, threshold: float = 0.3, normalize: str = "double", most: int | None = 3,
                          cut_shots: bool = True, select: bool = True, prepare: bool = True) -> DataFrame:
    """video_id, shot_id, rank, frame_no, src_frame_no, quality, image of the best frames of each shot.

    Frames are sampled before anything costs, then prepared, measured and cut into shots.
    `normalize` is "double" (the mean difference divided by the pixels again, as the original
    does: frames of usual size are then one shot) or "mean". Without `select` every sampled
    frame is kept. Measures are taken where the frame lies, and only they and frame numbers go through the
    windows of a video. Pixels meet their predecessor's in a join on both frames' numbers, dealt by frame and not
    by video, and the pixels of kept frames are joined back.
    """
    sampled = O.sample(frames.withColumn("__every", O.interval(F.col(fps), target_fps)), F.col("__every"))
    prepared = (lambda c: I.preprocess(c)) if prepare else (lambda c: c)
    w = Window.partitionBy("video_id").orderBy("src_frame_no")
    measured = sampled.withColumn("image", prepared(F.col("image"))).withColumn("q", I.quality_parts(F.col("image")))
    numbers = sampled.select("video_id", "src_frame_no").withColumn("__before", F.lag("src_frame_no").over(w))
    earlier = measured.select("video_id", F.col("src_frame_no").alias("__before"), F.col("image").alias("__earlier"))
    measured = measured.join(numbers, ["video_id", "src_frame_no"]).join(earlier, ["video_id", "__before"], "left").withColumn("__diff", I.difference(F.col("image"), F.col("__earlier")))
    narrow = measured.select("video_id", "src_frame_no", (F.col("image.height") * F.col("image.width")).alias("__pixels"), "__diff", *[F.col(f"q.{c}").alias(c) for c in ("sharpness", "brightness", "contrast", "focus")])
    narrow = O.number(narrow, "video_id", ["src_frame_no"])
    change = F.col("__diff") / F.col("__pixels") if normalize == "double" else F.col("__diff")
    framed = O.shots(narrow, "video_id", ["frame_no"], change, threshold, enabled=cut_shots)
    framed = framed.withColumn("quality", Q.score(*(F.col(c) for c in ("sharpness", "brightness", "contrast", "focus"))))
    kept = O.best(framed, "video_id", "shot_id", F.col("quality"), ["frame_no"], most if select else None)
    picked = kept.select("video_id", "shot_id", "rank", "frame_no", "src_frame_no", "quality")
    raw = sampled.select("video_id", "src_frame_no", F.col("image").alias("__raw"))  # only kept frames are prepared again
    return picked.join(raw, ["video_id", "src_frame_no"]).withColumn("image", prepared(F.col("__raw"))).drop("__raw")


def sampled_frames(frames: DataFrame, fps: str = "fps", target_fps: float = 1.0) -> DataFrame:
    """Every sampled frame, turned upright, numbered from 0 and not selected or prepared otherwise."""
    kept = O.sample(frames.withColumn("__every", O.interval(F.col(fps), target_fps)), F.col("__every")).drop("__every")
    return O.number(kept.drop("frame_no"), "video_id", ["src_frame_no"]).withColumn("image", I.upright(F.col("image")))


def stream_colours(frames: DataFrame, detections: DataFrame, rows: int = 100) -> DataFrame:
    """video_id, frame_no and the mean Lab colour under each frame's first confident box; null without one.

    `detections` has video_id, frame_no, ord, confidence and box struct<x1, y1, x2, y2>.
    """
    named = detections.withColumn("__key", F.struct("video_id", "frame_no"))
    first = features.first_match(named, "__key", ["ord"], F.col("confidence")).select("video_id", "frame_no", "box")
    joined = frames.join(first, ["video_id", "frame_no"], "left")
    return joined.select("video_id", "frame_no", I.region_colour(F.col("image"), F.col("box"), rows).alias("colour"))


def observed(selected: DataFrame, name: str = "selected_frames") -> DataFrame:
    """The same rows, with their number and mean quality as an observation of that name (NULL of none)."""
    return selected.observe(name, F.count(F.lit(1)).alias("saved"), F.avg("quality").alias("average_quality"))
