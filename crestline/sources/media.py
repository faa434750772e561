"""Images, frame folders and raw videos as DataFrames, and images out again. Spark reads the files, from any store."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import images as I
from crestline.schemas import FRAMES


def images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, image) of image files, in no set order; files that cannot be decoded are left out. A missing path is Spark's error."""
    found = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob).load(path)
    return found.select(F.col("image.origin").alias("path"), "image")


def oriented_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(image_id, image), turned by the orientation that a file's EXIF data gives."""

    @F.pandas_udf("int")
    def orientation(content: pd.Series) -> pd.Series:
        return pd.Series([I.exif_orientation(c) for c in content], dtype="Int32")

    tags = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("p"), orientation("content").alias("turn"))
    found = images(spark, path, glob).withColumn("p", F.regexp_replace("path", "^file:/+", "/"))
    turned = found.join(tags, "p", "left").select("path", F.when(F.col("turn").isin(3, 6, 8), I.orient(F.col("image"), F.col("turn"))).otherwise(F.col("image")).alias("image"))
    return turned.select(F.col("path").alias("image_id"), "image")


def frame_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Frames (video_id, frame_no, src_frame_no, image) of folders of numbered images: the folder is the video, the last number in a name the frame's."""
    found = images(spark, path, glob)
    number = F.regexp_extract("path", r"(\d+)\D*$", 1).cast("long")
    return found.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("video_id"), number.alias("frame_no"), number.alias("src_frame_no"), "image").where("frame_no IS NOT NULL")


#: Bytes of frames that one task reads of a raw video.
RANGE_BYTES = 64_000_000


def _opened(path: str):
    """A file opened for reading by ranges, in any store that Arrow knows."""
    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if ":" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def y4m_videos(spark: SparkSession, path: str, target_fps: float = 1.0) -> DataFrame:
    """video_id, fps, frame_count, frame_interval of uncompressed YUV4MPEG2 videos, and path, width, height, chroma, first_byte, frame_bytes.

    Only headers are read; a frame that the file's end cuts off does not count. frame_interval is null where fps is below the target.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                with _opened(name) as f:
                    head = f.read(min(length, 4096)).partition(b"\n")[0]
                if not head.startswith(b"YUV4MPEG2"):
                    raise ValueError(f"not a YUV4MPEG2 video: {name}")
                field = {x[:1]: x[1:].decode() for x in head.split(b" ")[1:]}
                w, h = int(field[b"W"]), int(field[b"H"])
                num, den = map(int, field.get(b"F", "25:1").split(":"))
                chroma = field.get(b"C", "420")
                cw, ch = _chroma_size(w, h, chroma)
                frame, first = len(b"FRAME\n") + w * h + 2 * cw * ch, len(head) + 1
                yield pa.RecordBatch.from_pylist([{"video_id": name.rsplit("/", 1)[-1], "fps": num / den, "frame_count": max(0, length - first) // frame, "path": name, "width": w, "height": h, "chroma": chroma, "first_byte": first, "frame_bytes": frame}], schema=_VIDEO)

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the contents are not read
    found = files.mapInArrow(run, "video_id string, fps double, frame_count long, path string, width int, height int, chroma string, first_byte long, frame_bytes long")
    step = F.floor(F.col("fps") / target_fps).cast("int")
    return found.select("video_id", "fps", "frame_count", F.when(step >= 1, step).alias("frame_interval"), "path", "width", "height", "chroma", "first_byte", "frame_bytes")


def y4m(spark: SparkSession, path: str) -> DataFrame:
    """Frames of uncompressed YUV4MPEG2 videos (4:4:4, 4:2:0 or gray), with their rate: the frame table and fps.

    Videos are cut into ranges of whole frames of about RANGE_BYTES, so that one of any size is read by many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with _opened(r["path"]) as f:
                    f.seek(r["first_byte"] + r["at"] * r["frame_bytes"])
                    for no in range(r["at"], min(r["at"] + r["per"], r["frame_count"])):
                        data = f.read(r["frame_bytes"])
                        if not data.startswith(b"FRAME\n"):
                            raise ValueError(f"frame {no} of {r['path']} has parameters of its own")
                        frame = _frame(data[6:], r["width"], r["height"], r["chroma"])
                        image = dict(zip(("origin", "height", "width", "nChannels", "mode", "data"), I.record(frame, r["path"]), strict=True))
                        yield pa.RecordBatch.from_pylist([{"video_id": r["video_id"], "frame_no": no, "src_frame_no": no, "image": image, "fps": r["fps"]}], schema=_Y4M)

    videos = y4m_videos(spark, path).where("frame_count > 0").withColumn("per", F.greatest(F.lit(1), F.floor(F.lit(RANGE_BYTES) / F.col("frame_bytes"))).cast("long"))
    ranges = videos.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1, F.col("per"))))
    return ranges.repartition("path", "at").mapInArrow(run, f"{FRAMES}, fps double")


_IMAGE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
_Y4M = pa.schema([("video_id", pa.string()), ("frame_no", pa.int64()), ("src_frame_no", pa.int64()), ("image", _IMAGE), ("fps", pa.float64())])
_VIDEO = pa.schema([
    ("video_id", pa.string()), ("fps", pa.float64()), ("frame_count", pa.int64()), ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
    ("chroma", pa.string()), ("first_byte", pa.int64()), ("frame_bytes", pa.int64()),
])


def _chroma_size(w: int, h: int, chroma: str) -> tuple[int, int]:
    return (w, h) if chroma.startswith("444") else (0, 0) if chroma.startswith("mono") else (-(-w // 2), -(-h // 2))


def _frame(data: bytes, w: int, h: int, chroma: str) -> np.ndarray:
    """The picture of one frame's planes, blue-green-red unless it is gray."""
    cw, ch = _chroma_size(w, h, chroma)
    y = np.frombuffer(data, np.uint8, w * h).reshape(h, w)
    if not cw:
        return y
    planes = []
    for k in range(2):
        c = np.frombuffer(data, np.uint8, cw * ch, w * h + k * cw * ch).reshape(ch, cw).astype(float) - 128
        planes.append(c if cw == w and ch == h else c.repeat(2, 0).repeat(2, 1)[:h, :w])
    u, v = planes
    light = 1.164 * (y.astype(float) - 16)
    return np.clip(np.rint(np.stack([light + 2.018 * u, light - 0.391 * u - 0.813 * v, light + 1.596 * v], -1)), 0, 255).astype(np.uint8)


def write_frames(selected: DataFrame, path: str) -> None:
    """The canonical sink: one Parquet row a frame with its PNG bytes, file name and sidecar lines, by video. It replaces what was there."""
    selected.withColumn("png", I.as_png(F.col("image"))).drop("image").write.mode("overwrite").partitionBy("video_id").parquet(path)


def export_files(named: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
    """Write binary contents as files into a folder that all executors mount; gives the manifest (file, bytes) when it is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            sizes = []
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with open(os.path.join(folder, file), "wb") as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return named.select(name.alias("file"), content.cast("binary").alias("data")).where("data IS NOT NULL").mapInArrow(run, "file string, bytes long")
