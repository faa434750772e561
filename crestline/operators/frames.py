"""Sampling, shots and representative frames of videos, as windows over (video, order) columns.

All windows partition by the video, so a plan has one exchange on it. Frames' pixels need not
travel: select by measures first and join pixels to what is kept. A video too long for one task is
cut into blocks of its order (the functions named blocked_*): windows run within a block, and a
narrow table with a row for each block carries numbers, last values and shots over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number(frames: DataFrame, video: str, order: list[str], out: str = "frame_no") -> DataFrame:
    """Add the ordinal of each frame in its video, from 0."""
    return frames.withColumn(out, (F.row_number().over(Window.partitionBy(video).orderBy(*order)) - 1).cast("long"))


def interval(fps: Column, target_fps: float) -> Column:
    """Frames from one sample to the next; an error where fps is below the target."""
    step = F.floor(fps / F.lit(target_fps)).cast("int")
    return F.when(step >= 1, step).otherwise(F.raise_error(F.lit("fps is below the target rate: no frame interval")).cast("int"))


def videos(frames: DataFrame, video: str, fps: Column, target_fps: float) -> DataFrame:
    """video, fps, frame_count, frame_interval of each video; `fps` is the same for all frames of one."""
    counted = frames.groupBy(video).agg(F.max(fps).cast("double").alias("fps"), F.count("*").alias("frame_count"))
    return counted.withColumn("frame_interval", interval(F.col("fps"), target_fps))


def with_pixels(selected: DataFrame, frames: DataFrame, keys: list[str], pixels: str) -> DataFrame:
    """Selected frames with their pixels joined back; only narrow rows were selected on, and of the pixels those of kept frames are all that is left."""
    return selected.join(frames.select(*keys, pixels), keys)


def sample(frames: DataFrame, every: Column, src: str = "src_frame_no") -> DataFrame:
    """Every so many frames of each video."""
    return frames.where(F.col(src) % every == 0)


def differences(frames: DataFrame, video: str, order: list[str], diff, out: str = "diff") -> DataFrame:
    """Add diff(previous) to each frame, null for a video's first; diff takes a function that gives a column's previous value."""
    w = Window.partitionBy(video).orderBy(*order)
    return frames.withColumn(out, diff(lambda c: F.lag(c, 1).over(w)))


def shots(frames: DataFrame, video: str, order: list[str], change: Column, threshold: float, out: str = "shot_id", enabled: bool = True, pixels: int | None = None) -> DataFrame:
    """Number the shots of each video from 0: a new one begins where the change is over the threshold.

    With `pixels` the change (already a mean) is divided by the frame's pixels once more, as
    the original rule does; with that rule hardly any frame of usual size begins a shot.
    """
    if not enabled:
        return frames.withColumn(out, F.lit(0).cast("long"))
    value = change / F.lit(float(pixels)) if pixels else change
    cut = F.when(value > threshold, 1).otherwise(0)
    w = Window.partitionBy(video).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn("__cut", cut).withColumn(out, F.sum("__cut").over(w).cast("long")).drop("__cut")


def _carried(held: DataFrame, blocks: DataFrame, video: str) -> DataFrame:
    """Each frame with the row of its block; null videos are a video like others."""
    b = blocks.withColumnRenamed(video, "__v").withColumnRenamed("__block", "__b")
    return held.join(b, held[video].eqNullSafe(b["__v"]) & held["__block"].eqNullSafe(b["__b"])).drop("__v", "__b")


def blocked_number(frames: DataFrame, video: str, order: list[str], block: Column, out: str = "frame_no") -> DataFrame:
    """number() of videos of any length; `block` ascends with the order and cuts a video into parts that fit a task."""
    held = frames.withColumn("__block", block)
    earlier = Window.partitionBy(video).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy(video, "__block").agg(F.count("*").alias("__n")).select(video, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    at = F.row_number().over(Window.partitionBy(video, "__block").orderBy(*order)) - 1
    return _carried(held, blocks, video).withColumn(out, (F.col("__first") + at).cast("long")).drop("__block", "__first")


def blocked_differences(frames: DataFrame, video: str, order: list[str], block: Column, values: list[str], diff, out: str = "diff") -> DataFrame:
    """differences() of videos of any length: a block's first frame takes the `values` of the last frame of the block before."""
    held = frames.withColumn("__block", block)
    ends = held.groupBy(video, "__block").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__end"))
    blocks = ends.select(video, "__block", F.lag("__end").over(Window.partitionBy(video).orderBy("__block")).alias("__end"))
    w = Window.partitionBy(video, "__block").orderBy(*order)
    first = F.row_number().over(w) == 1
    return _carried(held, blocks, video).withColumn(out, diff(lambda c: F.when(first, F.col("__end")[c]).otherwise(F.lag(c, 1).over(w)))).drop("__block", "__end")


def blocked_shots(frames: DataFrame, video: str, order: list[str], block: Column, change: Column, threshold: float, out: str = "shot_id") -> DataFrame:
    """shots() of videos of any length: shots are counted within blocks, and those of the blocks before are added."""
    held = frames.withColumn("__block", block).withColumn("__cut", F.when(change > threshold, 1).otherwise(0))
    earlier = Window.partitionBy(video).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = held.groupBy(video, "__block").agg(F.sum("__cut").alias("__n")).select(video, "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    w = Window.partitionBy(video, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _carried(held, blocks, video).withColumn(out, (F.col("__before") + F.sum("__cut").over(w)).cast("long")).drop("__block", "__cut", "__before")


def ranges(framed: DataFrame, video: str, shot: str, no: str) -> DataFrame:
    """First frame of each shot, and the one after its last: the next shot's first, or the video's length."""
    firsts = framed.groupBy(video, shot).agg(F.min(no).alias("start_no"), F.max(no).alias("last_no"))
    after = F.lead("start_no").over(Window.partitionBy(video).orderBy(shot))
    return firsts.withColumn("end_no", F.coalesce(after, F.col("last_no") + 1)).drop("last_no")


def best(framed: DataFrame, video: str, shot: str, quality: Column, no: list[str], most: int | None = 3, out: str = "rank") -> DataFrame:
    """The best frames of each shot, ranked from 1; equal qualities in frame order. `most` None keeps all."""
    w = Window.partitionBy(video, shot).orderBy(quality.desc(), *no)
    ranked = framed.withColumn(out, F.row_number().over(w).cast("int"))
    return ranked if most is None else ranked.where(F.col(out) <= most)


def fixed(c: Column, digits: int = 4) -> Column:
    """The number's text with so many digits after the point, rounded by its exact binary value, halves to even, as C and Python print it.

    format_string rounds the shortest decimal that names the number: 0.52245, a bit below its name, would be 0.5225. Halves
    of the number times a power of ten have no rounding error here, so that what lies on which side is certain. From 1e11 on, and
    where it is null, not a number or 0, the text is that of format_string.
    """
    unit, size = 10**digits, F.abs(c)
    high = size.cast("float").cast("double")
    n = F.rint(size * unit)
    # the distance to n less a half, and plus a half; high * unit and the rest * unit are exact
    over, under = ((high * unit - n + k) + (size - high) * unit for k in (-0.5, 0.5))
    odd = n % 2 == 1
    n = (n + F.when((over > 0) | ((over == 0) & odd), 1).when((under < 0) | ((under == 0) & odd), -1).otherwise(0)).cast("long")
    text = F.format_string(f"%s%d.%0{digits}d", F.when(c < 0, "-").otherwise(""), F.floor(n / unit), n % unit)
    return F.when((size > 0) & (size < 1e11), text).otherwise(F.format_string(f"%.{digits}f", c))


def output_names(selected: DataFrame, video: str, shot: str, rank: str, quality: str, no: str) -> DataFrame:
    """Ordinal, file name and sidecar lines of each selected frame, in order of shot, then rank."""
    at = F.row_number().over(Window.partitionBy(video).orderBy(shot, rank)) - 1
    return selected.withColumn("out_no", at.cast("int")).withColumn("file_name", F.format_string("frame_%04d.png", "out_no")).withColumn(
        "sidecar", F.format_string("Original frame index: %d\nQuality score: %s\n", F.col(no), fixed(F.col(quality)))
    )
