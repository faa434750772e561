import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import images as I
from crestline.functions import kernels as K
from crestline.operators import detection
from crestline.plans import still, video
from crestline.sources import media
from crestline.streaming.shots import live_shots


def write(path, a):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(I.png(a))


def disc(h=160, w=200, r=60):
    y, x = np.mgrid[0:h, 0:w]
    a = np.where((x - w // 2) ** 2 + (y - h // 2) ** 2 <= r * r, 200, 20).astype(np.uint8)
    rng = np.random.default_rng(0)
    for cx, cy in rng.integers(-25, 26, (14, 2)):
        a[h // 2 + cy : h // 2 + cy + 3, w // 2 + cx : w // 2 + cx + 3] = 90
    return np.repeat(a[..., None], 3, 2)


def test_png_is_read_back_as_blue_green_red(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    write(str(tmp_path / "v" / "frame_0003.png"), a)
    (row,) = media.frame_folder(spark, str(tmp_path / "v")).collect()
    assert (row.video_id, row.frame_no) == ("v", 3)
    assert (I.pixels(row.image.height, row.image.width, row.image.nChannels, row.image.data) == a).all()


def test_exif_orientation():
    tiff = b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    head = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe1" + (len(head) + 2).to_bytes(2, "big") + head + b"\xff\xda"
    assert I.exif_orientation(jpeg) == 6 and I.exif_orientation(b"\xff\xd8\xff\xda") is None and I.exif_orientation(None) is None
    a = np.array([[1, 2, 3], [4, 5, 6]])
    assert K.oriented(a, 6).tolist() == [[4, 1], [5, 2], [6, 3]] and K.oriented(a, 2).tolist() == a.tolist()


def y4m(frames, fps=2):
    h, w = frames[0].shape
    return f"YUV4MPEG2 W{w} H{h} F{fps}:1 Cmono\n".encode() + b"".join(b"FRAME\n" + f.tobytes() for f in frames)


def test_video_plan_from_raw_video(spark, tmp_path):
    rng = np.random.default_rng(5)
    shots = [rng.integers(0, 60, (4, 4), dtype=np.uint8), rng.integers(190, 250, (4, 4), dtype=np.uint8)]
    (tmp_path / "clip.y4m").write_bytes(y4m([shots[i // 6] for i in range(12)]))
    frames = media.y4m(spark, str(tmp_path / "clip.y4m"))
    assert frames.count() == 12
    got = video.representative_frames(frames, prepare=False).orderBy("shot_id", "rank").collect()  # 16 pixels: found by the original rule
    assert [(r.shot_id, r.rank, r.frame_no, r.src_frame_no) for r in got] == [(0, 1, 0, 0), (0, 2, 1, 2), (0, 3, 2, 4), (1, 1, 3, 6), (1, 2, 4, 8), (1, 3, 5, 10)]
    assert all(0 <= r.quality <= 1 for r in got)
    everything = video.representative_frames(frames, prepare=False, select=False, cut_shots=False)
    assert sorted(r.frame_no for r in everything.collect()) == list(range(6))
    out = str(tmp_path / "out")
    media.write_frames(video.representative_frames(frames, prepare=False), out)
    assert spark.read.parquet(out).where("png IS NOT NULL").count() == 6


def test_preparing_turns_frames_upright(spark):
    a = np.random.default_rng(2).integers(0, 256, (10, 24, 3), dtype=np.uint8)
    df = spark.createDataFrame([(I.record(a, "x"),), (None,)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    got = df.select(I.preprocess(F.col("image")).alias("i")).collect()
    assert (got[0].i.height, got[0].i.width) == (24, 10) and (got[1].i is None or got[1].i.data is None)


def test_still_plan_finds_the_disc(spark):
    df = spark.createDataFrame([("disc", I.record(disc())), ("blank", I.record(np.zeros((40, 40, 3), np.uint8)))], "image_id string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    assert detection.corners(df, least_circularity=0.0).where("image_id = 'disc'").count() > 3
    best = still.best_ellipses(df, padding=10, surf_circularity=0.0, fast_circularity=0.0, line_votes=60, least_area=5000.0).collect()
    assert [r.image_id for r in best] == ["disc"]
    assert (best[0].cx, best[0].cy) == pytest.approx((100, 80), abs=3) and best[0].w == pytest.approx(120, abs=8)
    boxes = still.best_ellipses(df, padding=10, surf_circularity=0.0, fast_circularity=0.0, line_votes=60, least_area=5000.0)
    sizes = {r.image_id: (r.h, r.w) for r in still.crops(df, boxes).select("image_id", F.col("image.height").alias("h"), F.col("image.width").alias("w")).collect()}
    assert sizes["blank"] == (40, 40) and sizes["disc"][0] > 120 and sizes["disc"][1] < 160


def test_region_colour_is_null_without_a_strip(spark):
    df = spark.createDataFrame([(1, I.record(disc())), (2, I.record(disc()))], "i int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    box = F.struct(F.lit(10).alias("x1"), F.lit(0).alias("y1"), F.lit(50).alias("x2"), F.when(F.col("i") == 1, 100).otherwise(500).alias("y2"))
    got = {r.i: r.c for r in df.select("i", I.region_colour(F.col("image"), box).alias("c")).collect()}
    assert got[1].l > 0 and abs(got[1].a - 128) < 2 and (got[2] is None or got[2].l is None)


def test_sampled_frames_and_colours(spark, tmp_path):
    wide = np.full((4, 6), 100, np.uint8)
    (tmp_path / "w.y4m").write_bytes(y4m([wide] * 5))
    frames = media.y4m(spark, str(tmp_path / "w.y4m"))
    got = video.sampled_frames(frames).orderBy("frame_no").select("frame_no", "src_frame_no", "image.height", "image.width").collect()
    assert [tuple(r) for r in got] == [(0, 0, 6, 4), (1, 2, 6, 4), (2, 4, 6, 4)]
    colour = spark.createDataFrame([("v", 0, I.record(disc())), ("v", 1, I.record(disc()))], "video_id string, frame_no long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    boxes = spark.createDataFrame([("v", 0, 0, 0.5, (0, 0, 9, 9)), ("v", 0, 1, 0.7, (0, 0, 50, 60)), ("v", 0, 2, 0.9, (0, 0, 1, 1))], "video_id string, frame_no long, ord int, confidence double, box struct<x1:int,y1:int,x2:int,y2:int>")
    found = {r.frame_no: r.colour for r in video.stream_colours(colour, boxes, 20).collect()}
    assert found[0].l > 0 and (found[1] is None or found[1].l is None)
    assert video.observed(spark.createDataFrame([(0.5,), (0.7,)], "quality double")).count() == 2


def test_export_writes_files(spark, tmp_path):
    df = spark.createDataFrame([("a.png", bytearray(b"xyz")), ("b.png", None)], "name string, data binary")
    manifest = media.export_files(df, str(tmp_path / "o"), F.col("name"), F.col("data")).collect()
    assert [(r.file, r.bytes) for r in manifest] == [("a.png", 3)] and (tmp_path / "o" / "a.png").read_bytes() == b"xyz"


def test_live_shots(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", 0, 1.0), ("a", 1, 9.0), ("b", 0, 5.0), ("a", 2, 9.5)]
    spark.createDataFrame(rows[:3], "video string, no long, v double").coalesce(1).write.parquet(src)
    told = str(tmp_path / "told")

    def take_what_is_there():
        stream = live_shots(spark.readStream.schema("video string, no long, v double").parquet(src), "video", "no", "v", 5.0)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(told)
        assert q.awaitTermination(60)

    take_what_is_there()
    spark.createDataFrame(rows[3:], "video string, no long, v double").coalesce(1).write.mode("append").parquet(src)
    take_what_is_there()
    got = sorted((r.video, r.frame_no, r.shot_id) for r in spark.read.parquet(told).collect())
    assert got == [("a", 0, 0), ("a", 1, 1), ("a", 2, 1), ("b", 0, 0)]


def test_videos_are_read_by_ranges_of_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE_BYTES", 100)
    pictures = [np.full((4, 6), 10 * i, np.uint8) for i in range(25)]
    (tmp_path / "a.y4m").write_bytes(y4m(pictures, fps=3) + b"FRAME\n123")  # the last frame is cut off
    (tmp_path / "b.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F30000:1001 C420\n" + b"FRAME\n" + bytes([200] * 4 + [128, 128]))
    (tmp_path / "c.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F1:2 C444\n")
    made = media.y4m_videos(spark, str(tmp_path / "*.y4m")).orderBy("video_id").collect()
    assert [(r.video_id, round(r.fps, 2), r.frame_count, r.frame_interval) for r in made] == [("a.y4m", 3.0, 25, 3), ("b.y4m", 29.97, 1, 29), ("c.y4m", 0.5, 0, None)]
    got = media.y4m(spark, str(tmp_path / "*.y4m"))
    rows = sorted((r.video_id, r.frame_no, r.image.data[0], r.image.nChannels) for r in got.collect())
    assert rows == [("a.y4m", i, 10 * i, 1) for i in range(25)] + [("b.y4m", 0, 214, 3)]
    images = tmp_path / "n.y4m"
    images.write_bytes(b"no video\n")
    with pytest.raises(Exception, match="not a YUV4MPEG2 video"):
        media.y4m(spark, str(images)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        media.y4m(spark, str(tmp_path / "none.y4m")).collect()
