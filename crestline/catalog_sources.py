"""Registered queries that write files and read them back: raw videos through the video source, frames through the file sink.

Stand-ins: an embedding's absolute values, scaled to 0..255, are a gray 8 x 8 frame of the video named by its label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.catalog_pixels import SIZE, _F, _frames
from crestline.operators import frames
from crestline.session import scratch
from crestline.sources import files, video

#: Rate of the written videos, of the frames that are read again, first frame that is.
FPS, RATE, FROM = 25, 12.0, 4


def _bytes(v: Column) -> Column:
    """Numbers 0..255 as one binary."""
    return F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def scanned_frames(spark: SparkSession, root: str) -> DataFrame:
    """All frames written as raw videos and read again at a lower rate, from a first frame on: both go into the scan."""
    numbered = frames.number(_frames(spark, root), "label", ["vec_id"], "src_frame_no")
    image = F.struct(F.lit("").alias("origin"), F.lit(SIZE).alias("height"), F.lit(SIZE).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), _bytes(F.col("v")).alias("data"))
    path = scratch(spark, "videos")
    video.write_videos(numbered.select(F.col("label").cast("string").alias("video_id"), "src_frame_no", image.alias("image")), path, f"{FPS}:1", block=64)
    read = video.scan(spark, path, RATE).where(F.col("src_frame_no") >= FROM)
    level = F.aggregate(F.sequence(F.lit(1), F.lit(SIZE * SIZE)), F.lit(0).cast("long"), lambda a, i: a + i * F.conv(F.hex(F.substr(F.col("image.data"), i, F.lit(1))), 16, 10).cast("long"))
    return read.select("video_id", "frame_no", "src_frame_no", "fps", level.alias("pixels"))


def committed_files(spark: SparkSession, root: str) -> DataFrame:
    """The selected frames and their sidecars as files, committed together, read back and held against the manifest."""
    from crestline.catalog import selected_outputs

    named = selected_outputs(spark, root).join(_frames(spark, root).select("label", "vec_id", "v"), ["label", "vec_id"])
    path = scratch(spark, "selected")
    files.write_files(named.select(F.concat_ws("/", F.col("label").cast("string"), "file_name").alias("name"), _bytes(F.col("v")).alias("data"), "sidecar"), path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "frame_*").load(path)
    file = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    read = found.select(file.alias("file"), "length", F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc"))
    # the manifest has a row a file; one that lacks either side would have a null
    return read.join(files.manifest(spark, path), "file", "full").select("file", F.col("length").alias("bytes"), "sha256", ((F.col("crc") == F.col("crc32")) & (F.col("length") == F.col("bytes"))).alias("intact"))


_HEX = "[printf('%02x', p) for p in v]"

ORACLES = {
    "scanned_frames": f"""WITH {_F}, n AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM f)
        SELECT label::VARCHAR AS video_id, (k // 2)::BIGINT AS frame_no, k::BIGINT AS src_frame_no, {FPS}.0::DOUBLE AS fps, list_sum([v[i + 1]::BIGINT * (i + 1) for i in range(64)])::BIGINT AS pixels FROM n WHERE k % 2 = 0 AND k >= {FROM}""",
}


def committed_oracle(selected: str) -> str:
    """The files that the selected frames (SQL of label, vec_id, file_name, sidecar) make."""
    return f"""WITH so AS ({selected}), {_F}, a AS (SELECT so.label, file_name, sidecar, unhex(array_to_string({_HEX}, '')) AS data FROM so JOIN f ON f.label = so.label AND f.vec_id = so.vec_id),
        b AS (SELECT label || '/' || file_name AS file, data FROM a UNION ALL SELECT label || '/' || replace(file_name, '.png', '_quality.txt'), encode(sidecar) FROM a)
        SELECT file, octet_length(data)::BIGINT AS bytes, sha256(data) AS sha256, true AS intact FROM b"""


def queries() -> dict:
    return {"scanned_frames": scanned_frames, "committed_files": committed_files}


def oracle_sql(selected: str) -> dict[str, str]:
    return ORACLES | {"committed_files": committed_oracle(selected)}
