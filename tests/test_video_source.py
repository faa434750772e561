"""The raw video source and the sinks: pruning and sampling in the scan, ranges read once, commits that are whole or nothing."""

import glob
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import images as I
from crestline.sources import files, stores, video

SCHEMA = "video_id string, src_frame_no long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def gray(k, h=4, w=6):
    return np.full((h, w), k % 251, np.uint8)


@pytest.fixture(scope="module")
def videos(spark, tmp_path_factory):
    """Two videos of 90 and 40 frames in segments of at most 16."""
    path = str(tmp_path_factory.mktemp("videos"))
    rows = [(v, i, I.record(gray(i + 7 * k), v)) for k, (v, n) in enumerate((("a/b 1", 90), ("c", 40))) for i in range(n)]
    video.write_videos(spark.createDataFrame(rows, SCHEMA).repartition(5), path, fps="10:1", block=16)
    return path


def test_written_videos_are_read_back_whole(spark, videos):
    got = video.scan(spark, videos).collect()
    want = {(v, i, (i + 7 * k) % 251) for k, (v, n) in enumerate((("a/b 1", 90), ("c", 40))) for i in range(n)}
    assert {(r.video_id, r.src_frame_no, r.image.data[0]) for r in got} == want and len(got) == len(want)
    assert all(r.frame_no == r.src_frame_no and r.fps == 10.0 and (r.image.width, r.image.height) == (6, 4) for r in got)
    segments = glob.glob(f"{videos}/*/*.y4m")
    assert len(segments) == 6 + 3 and os.path.exists(f"{videos}/_SUCCESS") and not glob.glob(f"{videos}/_staging*")


@pytest.mark.parametrize("range_bytes", [1, 200, 100_000])
def test_each_frame_is_read_once_at_any_range(spark, videos, range_bytes):
    df = video.scan(spark, videos, range_bytes=range_bytes)
    got = [(r.video_id, r.src_frame_no) for r in df.collect()]
    assert len(got) == len(set(got)) == 130
    assert range_bytes == 200 or df.rdd.getNumPartitions() == (130 if range_bytes == 1 else 1)


def reads(monkeypatch, reader):
    """The frames that a reader reads, and the files that it opens."""
    seen = []
    keep = video._frame
    monkeypatch.setattr(video, "_frame", lambda data, *a: seen.append(data[0]) or keep(data, *a))
    rows = [b.to_pylist()[0] for p in reader.partitions() for b in reader.read(p)]
    return rows, seen


def test_only_wanted_frames_are_read(videos, monkeypatch):
    reader = video.Y4mReader(videos, 2.0, 200)
    left = reader.pushFilters([video.EqualTo(("video_id",), "a/b 1"), video.GreaterThan(("src_frame_no",), 20), video.LessThanOrEqual(("frame_no",), 10), video.EqualTo(("fps",), 10.0)])
    assert [type(f) for f in left] == [video.EqualTo]  # the rate stays with Spark
    rows, seen = reads(monkeypatch, reader)
    assert [(r["frame_no"], r["src_frame_no"]) for r in sorted(rows, key=lambda r: r["frame_no"])] == [(k, 5 * k) for k in range(5, 11)] and len(seen) == len(rows)
    assert all(len(p.files) == 1 and p.end is not None for p in reader.partitions()) and len(reader.partitions()) <= 6


def test_filters_and_sampling_are_in_the_plan(spark, videos):
    df = video.scan(spark, videos, target_fps=2.0).where((F.col("video_id") == "c") & (F.col("src_frame_no") >= 8) & F.col("frame_no").isin(1, 2, 3, 99)).select("video_id", "frame_no", "src_frame_no")
    assert sorted((r.frame_no, r.src_frame_no) for r in df.collect()) == [(2, 10), (3, 15)]
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "src_frame_no" in plan.split("PushedFilters")[1].split("\n")[0]
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in executed and "- Filter" not in executed  # nothing is left to Spark


@pytest.mark.parametrize("condition", ["frame_no > 3 AND frame_no < 6", "src_frame_no IN (0, 5, 6)", "video_id IN ('c', 'x') AND frame_no = 2", "video_id <=> 'c'", "video_id > 'b'", "frame_no = 1 OR frame_no = 4", "frame_no < 0", "src_frame_no <= 5 AND frame_no >= 1", "frame_no <> 2"])
def test_pushed_filters_equal_spark_filters(spark, videos, condition):
    rows = lambda df: sorted((r.video_id, r.frame_no, r.src_frame_no) for r in df.select("video_id", "frame_no", "src_frame_no").collect())
    plain = spark.createDataFrame([(r.video_id, r.frame_no, r.src_frame_no) for r in video.scan(spark, videos, target_fps=2.0).collect()], "video_id string, frame_no long, src_frame_no long")
    assert rows(video.scan(spark, videos, target_fps=2.0).where(condition)) == rows(plain.where(condition))


def test_errors(spark, videos, tmp_path):
    with pytest.raises(Exception, match="fewer than 30"):
        video.scan(spark, videos, target_fps=30.0).count()
    with pytest.raises(Exception, match="none.y4m"):
        video.scan(spark, str(tmp_path / "none.y4m")).count()
    (tmp_path / "n.y4m").write_bytes(b"no video\n")
    with pytest.raises(Exception, match="not a YUV4MPEG2 video"):
        video.scan(spark, str(tmp_path / "n.y4m")).collect()
    colour = spark.createDataFrame([("v", 0, I.record(np.zeros((2, 2, 3), np.uint8), "v"))], SCHEMA)
    with pytest.raises(Exception, match="only gray frames"):
        video.write_videos(colour, str(tmp_path / "colour"))
    assert not glob.glob(str(tmp_path / "colour" / "*"))


def test_plain_files_of_other_makers(spark, tmp_path):
    (tmp_path / "b.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F30000:1001 C420\n" + b"FRAME\n" + bytes([200] * 4 + [128, 128]) + b"FRAME\ncut")
    (tmp_path / "e.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F1:2 C444\n")
    got = video.scan(spark, str(tmp_path / "*.y4m")).collect()
    assert [(r.video_id, r.frame_no, r.image.data[0], r.image.nChannels, round(r.fps, 2)) for r in got] == [("b.y4m", 0, 214, 3, 29.97)]


def contents(path):
    return {os.path.relpath(f, path): open(f, "rb").read() for f in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(f) and "/_" not in f}


def test_files_are_written_with_sidecars_and_a_manifest(spark, tmp_path):
    out = str(tmp_path / "o")
    rows = [(f"v{i % 3}/frame_{i:04d}.png", bytes([i]) * i, f"number {i}" if i % 2 else None) for i in range(1, 30)] + [("gone.png", None, None), (None, b"x", None)]
    files.write_files(spark.createDataFrame(rows, "name string, data binary, sidecar string").repartition(4), out)
    want = {n: d for n, d, _ in rows if n and d is not None} | {n[:-4] + "_quality.txt": s.encode() for n, _, s in rows if s}
    assert contents(out) == want
    assert {(r.file, r.bytes, r.crc32) for r in files.manifest(spark, out).collect()} == {(n, len(d), zlib.crc32(d)) for n, d in want.items()}
    with pytest.raises(FileExistsError):
        files.write_files(spark.createDataFrame(rows, "name string, data binary, sidecar string"), out)
    more = spark.createDataFrame([("more.txt", "text"), ("v1/z.txt", "z")], "name string, data string")
    files.write_files(more, out, mode="append")
    assert contents(out) == want | {"more.txt": b"text", "v1/z.txt": b"z"} and files.manifest(spark, out).count() == len(want) + 2
    files.write_files(more, out, mode="overwrite")
    assert contents(out) == {"more.txt": b"text", "v1/z.txt": b"z"} and files.manifest(spark, out).count() == 2


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "o")
    rows = spark.createDataFrame([("kept.txt", "old")], "name string, data string")
    files.write_files(rows, out)
    bad = spark.range(40).repartition(4).select(F.format_string("f%03d.txt", "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("no such frame"))).otherwise("x").cast("string").alias("data"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no such frame"):
            files.write_files(bad, out, mode=mode)
        assert contents(out) == {"kept.txt": b"old"} and not glob.glob(f"{out}/_staging*")
    twice = spark.createDataFrame([("same.txt", "1"), ("same.txt", "2")], "name string, data string").repartition(2, "data")
    for df, clash in ((twice, "same.txt"), (rows, "kept.txt")):
        with pytest.raises(Exception, match=clash):
            files.write_files(df, out, mode="append")
        assert contents(out) == {"kept.txt": b"old"} and not glob.glob(f"{out}/_staging*")
    with pytest.raises(Exception, match="not a name"):
        files.write_files(spark.createDataFrame([("../x", "1")], "name string, data string"), out, mode="append")


def test_attempts_that_failed_are_not_in_the_result(tmp_path):
    """A task that is run again: only the attempt whose message comes back counts."""
    staged = stores.StagedFiles(str(tmp_path / "s"), False)
    lost = staged.write(iter([("a.txt", [b"half"], "a")]))
    kept = staged.write(iter([("a.txt", [b"who", b"le"], "a"), ("b.txt", [b"b"], "b")]))
    assert lost.folder != kept.folder
    staged.commit([kept, None])
    assert contents(str(tmp_path / "s")) == {"a.txt": b"whole", "b.txt": b"b"}
