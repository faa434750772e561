"""Raw YUV4MPEG2 videos as a Spark data source: spark.read.format("crestline_y4m") with pruning, and a writer of segments.

A partition is a range of frames of one file, or several whole small files. Filters on video_id, frame_no
and src_frame_no go into the scan, as does the sampling rate: files of other videos are not opened, and of
a range only the frames that are wanted are read. A file's comment fields may say that it is a segment of
a longer video (XVIDEO=, XFIRST=: its video and first frame), as the writer's are: a video of any length is
written by many tasks and read as one.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from crestline.functions import images as I
from crestline.schemas import FRAMES
from crestline.sources.media import _frame, _chroma_size
from crestline.sources.stores import AT_ONCE, Staged, StagedFiles, listed, opened

FORMAT = "crestline_y4m"
#: Bytes of frames that a partition has about; bytes that hold a header; frames of a written segment at most.
RANGE_BYTES, HEAD_BYTES, SEGMENT_FRAMES = 64_000_000, 4096, 100_000
MARK = b"FRAME\n"

_IMAGE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
_FRAMES = pa.schema([("video_id", pa.string()), ("frame_no", pa.int64()), ("src_frame_no", pa.int64()), ("image", _IMAGE), ("fps", pa.float64())])


@dataclass
class Header:
    """What a file's first line says: its video and the number of its first frame, rate, size, and where its frames are."""

    video: str
    first: int
    fps: float
    width: int
    height: int
    chroma: str
    at: int
    frame_bytes: int

    @staticmethod
    def of(path: str, data: bytes) -> Header:
        line, end, _ = data.partition(b"\n")
        if not end or not line.startswith(b"YUV4MPEG2"):
            raise ValueError(f"not a YUV4MPEG2 video: {path}")
        fields, video, first = {}, path.rsplit("/", 1)[-1], 0
        for x in line.decode().split(" ")[1:]:
            if x.startswith("XVIDEO="):
                video = urllib.parse.unquote(x[7:])
            elif x.startswith("XFIRST="):
                first = int(x[7:])
            else:
                fields[x[:1]] = x[1:]
        w, h, chroma = int(fields["W"]), int(fields["H"]), fields.get("C", "420")
        num, den = map(int, fields.get("F", "25:1").split(":"))
        cw, ch = _chroma_size(w, h, chroma)
        return Header(video, first, num / den, w, h, chroma, len(line) + 1, len(MARK) + w * h + 2 * cw * ch)


@dataclass
class Wanted:
    """The frames that filters and the sampling rate leave: videos (None: all), least and greatest number of each column, numbers (None: all)."""

    rate: float | None = None
    videos: set | None = None
    least: dict = field(default_factory=dict)
    most: dict = field(default_factory=dict)
    numbers: dict = field(default_factory=dict)

    def take(self, f: Filter) -> bool:
        """Take the filter over if it can be: True if no row that fails it will come."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name not in ("video_id", "frame_no", "src_frame_no"):
            return False
        if isinstance(f, IsNotNull):  # none of the three is null
            return True
        if isinstance(f, (EqualTo, EqualNullSafe, In)):
            values = {v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
            if name == "video_id":
                self.videos = values if self.videos is None else self.videos & values
            else:
                self.numbers[name] = values & self.numbers.get(name, values)
        elif name == "video_id" or not isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            return False
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least[name] = max(self.least.get(name, 0), f.value + isinstance(f, GreaterThan))
        else:
            self.most[name] = min(self.most.get(name, f.value), f.value - isinstance(f, LessThan))
        return True

    def every(self, head: Header) -> int:
        """Frames from one sample to the next."""
        if self.rate is None:
            return 1
        if head.fps < self.rate:
            raise ValueError(f"the video {head.video} has {head.fps} frames a second, fewer than {self.rate}: no frame interval")
        return int(head.fps // self.rate)

    def frames(self, head: Header, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """(frame_no, src_frame_no) of the wanted ones with begin <= src_frame_no < end."""
        if self.videos is not None and head.video not in self.videos:
            return
        step = self.every(head)
        low = max(begin, self.least.get("src_frame_no", 0), step * self.least.get("frame_no", 0))
        high = min(end - 1, self.most.get("src_frame_no", end), step * self.most.get("frame_no", end))
        sources = [s for s in self.numbers["src_frame_no"] if s % step == 0] if "src_frame_no" in self.numbers else None
        if "frame_no" in self.numbers:
            named = {step * n for n in self.numbers["frame_no"]}
            sources = sorted(named if sources is None else named & set(sources))
        for src in range(-(-low // step) * step, high + 1, step) if sources is None else (s for s in sorted(sources) if low <= s <= high):
            yield src // step, src


class Y4m(DataSource):
    """Options: path (a file, a folder, or a pattern of names), targetFps (read so many frames a second only), rangeBytes; for written videos fps and block (frames of a segment at most)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{FRAMES}, fps double"

    def reader(self, schema: StructType) -> Y4mReader:
        return Y4mReader(self.options["path"], float(self.options["targetFps"]) if "targetFps" in self.options else None, int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> Y4mWriter:
        return Y4mWriter(self.options["path"], overwrite, self.options.get("fps", "25:1"), int(self.options.get("block", SEGMENT_FRAMES)))


class Range(InputPartition):
    """A range of frames of a file (numbers within the file; end None: to its end), or whole files."""

    def __init__(self, files: list[tuple[str, int]], begin: int = 0, end: int | None = None):
        self.files, self.begin, self.end = files, begin, end


class Y4mReader(DataSourceReader):
    def __init__(self, path: str, rate: float | None, range_bytes: int):
        self.path, self.range_bytes, self.wanted = path, range_bytes, Wanted(rate)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[Range]:
        """Small files travel together up to the wanted bytes, unopened; of larger ones the header is read and ranges without a wanted frame go."""
        store, files = opened(self.path)[0], listed(self.path, ".y4m")
        large = [f for f in files if f[1] > self.range_bytes]
        out, held, size = [], [], 0
        for name, length in files:
            if length <= self.range_bytes:
                if held and size + length > self.range_bytes:
                    out.append(Range(held))
                    held, size = [], 0
                held.append((name, length))
                size += length
        out += [Range(held)] if held else []
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for (name, length), head in zip(large, pool.map(lambda f: _header(store, *f), large), strict=True):
                count, per = (length - head.at) // head.frame_bytes, max(1, self.range_bytes // head.frame_bytes)
                for begin in range(0, count, per):
                    end = min(count, begin + per)
                    if next(self.wanted.frames(head, head.first + begin, head.first + end), None) is not None:
                        out.append(Range([(name, length)], begin, end))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store = opened(self.path)[0]
        for name, length in partition.files:
            head = _header(store, name, length)
            count = (length - head.at) // head.frame_bytes  # a frame that the file's end cuts off does not count
            end = count if partition.end is None else partition.end
            with store.open_input_file(name) as f:
                for no, src in self.wanted.frames(head, head.first + partition.begin, head.first + end):
                    f.seek(head.at + (src - head.first) * head.frame_bytes)
                    data = f.read(head.frame_bytes)
                    if not data.startswith(MARK):
                        raise ValueError(f"frame {src} of {name} has parameters of its own")
                    record = I.record(_frame(data[len(MARK) :], head.width, head.height, head.chroma), name)
                    image = dict(zip(("origin", "height", "width", "nChannels", "mode", "data"), record, strict=True))
                    yield pa.RecordBatch.from_pylist([{"video_id": head.video, "frame_no": no, "src_frame_no": src, "image": image, "fps": head.fps}], schema=_FRAMES)


def _header(store, name: str, length: int) -> Header:
    with store.open_input_file(name) as f:
        return Header.of(name, f.read(min(length, HEAD_BYTES)))


class Y4mWriter(DataSourceArrowWriter):
    """Gray frames (video_id, src_frame_no, image) as segments: a run of frames of one video, size and following numbers is a file."""

    def __init__(self, path: str, overwrite: bool, fps: str, block: int):
        self.files, self.fps, self.block = StagedFiles(path, overwrite), fps, block

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return self.files.write(self._segments(iterator))

    def _segments(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes], str]]:
        rows = ((r["video_id"], r["src_frame_no"], r["image"]) for b in iterator for r in b.to_pylist())
        ahead = next(rows, None)
        while ahead is not None:
            video, first, image = ahead
            if image is None or image["nChannels"] != 1:
                raise ValueError("only gray frames are written as raw video")
            size, state = (image["width"], image["height"]), {"next": first, "row": ahead}

            def frames(state=state, video=video, size=size, first=first) -> Iterator[bytes]:
                yield f"YUV4MPEG2 W{size[0]} H{size[1]} F{self.fps} Cmono XVIDEO={urllib.parse.quote(video, safe='')} XFIRST={first}\n".encode()
                while (row := state["row"]) is not None and row[0] == video and row[1] == state["next"] < (first // self.block + 1) * self.block and row[2] is not None and (row[2]["width"], row[2]["height"], row[2]["nChannels"]) == (*size, 1):
                    yield MARK + row[2]["data"]
                    state["next"] += 1
                    state["row"] = next(rows, None)

            name = f"{urllib.parse.quote(video, safe='')}/{first:012d}.y4m"
            yield name, frames(), name
            ahead = state["row"]

    def commit(self, messages: list) -> None:
        self.files.commit(messages)

    def abort(self, messages: list) -> None:
        self.files.abort(messages)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters into Python sources."""
    spark.dataSource.register(Y4m)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan(spark: SparkSession, path: str, target_fps: float | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of raw videos: the frame table and fps, frame_no counting the sampled ones."""
    register(spark)
    reader = spark.read.format(FORMAT).option("rangeBytes", range_bytes)
    return (reader if target_fps is None else reader.option("targetFps", target_fps)).load(path)


def write_videos(frames: DataFrame, path: str, fps: str = "25:1", block: int = SEGMENT_FRAMES, overwrite: bool = False) -> None:
    """Gray frames (video_id, src_frame_no, image) as raw videos, dealt by video and blocks of frames, so that a long one is written by many tasks."""
    from pyspark.sql import functions as F

    register(frames.sparkSession)
    named = frames.select("video_id", "src_frame_no", "image").withColumn("__block", F.floor(F.col("src_frame_no") / block))
    dealt = named.repartition("video_id", "__block").sortWithinPartitions("video_id", "src_frame_no").drop("__block")
    dealt.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("fps", fps).option("block", block).save(path)
