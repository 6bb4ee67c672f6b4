"""Frames of videos as a data source: folders of PNG files, of which only those that a query asks for are opened.

A video is a folder of files whose names end in the frame's number.  Registered with register(spark), the source reads

    spark.read.format("plumbline_frames").option("fps", "30").load(path)

as (video_id, frame_index, fps, content).  A partition is a range of one folder's files.  With the option push_down (see read_frames) conditions on
video_id and frame_index are pushed down: other folders aren't listed and other frames aren't opened.  With the option every, a number n, only every n-th
frame is read, and the option per_second, which takes n from the frame rate as sampling does (0 or less: no sampling).  Files are reached through Arrow's file
systems, so the path may be local or in a store that these know.  A file that vanishes or can't be read is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from plumbline.session import ship

FRAME = re.compile(r"(\d+)\.png$", re.I)
SCHEMA = "video_id string, frame_index long, fps double, content binary"
#: Files that a partition reads.
FRAMES_PER_PARTITION = 512
#: Bytes of files that are handed on together.
BATCH_BYTES = 16 << 20

_COMPARED = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class FrameRange(InputPartition):
    """Some frames of a video: their numbers and files."""

    video_id: str
    frames: list[tuple[int, str]]


def every_nth(options: dict[str, str]) -> int:
    """How many frames make one that is read."""
    if n := int(options.get("every", 0)):
        return n
    target, fps = float(options.get("per_second", 0)), float(options.get("fps", 0))
    if target <= 0:
        return 1
    return max(1, round(fps / target)) if fps > 0 else 10


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.tests = dict(options), []
        self.fps, self.every = float(options.get("fps", 0)), every_nth(options)

    def _wanted(self, column: str, value: object) -> bool:
        return all(_COMPARED[kind](value, bound) for c, kind, bound in self.tests if c == column)

    def partitions(self) -> list[FrameRange]:
        files, root = fs.FileSystem.from_uri(self.options["path"])
        out = []
        for folder in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            if folder.type != fs.FileType.Directory or not self._wanted("video_id", folder.base_name):
                continue
            named = [(int(m[1]), i.path) for i in files.get_file_info(fs.FileSelector(folder.path)) if i.type == fs.FileType.File and (m := FRAME.search(i.base_name))]
            frames = sorted((n, p) for n, p in named if n % self.every == 0 and self._wanted("frame_index", n))
            out += [FrameRange(folder.base_name, frames[a : a + FRAMES_PER_PARTITION]) for a in range(0, len(frames), FRAMES_PER_PARTITION)]
        return out or [FrameRange("", [])]

    def _content(self, files: fs.FileSystem, path: str) -> bytes:
        with files.open_input_stream(path) as f:
            return f.read()

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.options["path"])
        held: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            n, content = zip(*held, strict=True)
            columns = [pa.array([partition.video_id] * len(held)), pa.array(n, pa.int64()), pa.array([self.fps] * len(held)), pa.array(content, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["video_id", "frame_index", "fps", "content"])

        for number, path in partition.frames:
            held.append((number, self._content(files, path)))
            if sum(len(c) for _, c in held) >= BATCH_BYTES:
                yield batch()
                held = []
        if held:
            yield batch()


class PushedReader(FrameReader):
    """The reader that takes conditions."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1 and f.attribute[0] in ("video_id", "frame_index"):
                self.tests.append((f.attribute[0], type(f), tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plumbline_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:  # noqa: ANN001  Spark's schema
        kind = PushedReader if self.options.get("push_down", "false").lower() == "true" else FrameReader
        return kind({k: self.options[k] for k in ("path", "fps", "every", "per_second") if k in self.options})


def register(spark: SparkSession) -> None:
    """Makes the source known to the session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def read_frames(spark: SparkSession, path: str, where: Column | None = None, **options: object) -> DataFrame:
    """The frames of a folder that meet a condition, which is pushed down as far as it can be; options as the source has them.

    What is pushed down stays with a DataFrame in Spark 4.1, for all later queries on it; so the condition belongs to this call, and a
    further one is checked in Spark.
    """
    register(spark)
    reader = spark.read.format(FrameSource.name()).options(**options)
    if where is None:
        return reader.load(path)
    return reader.option("push_down", "true").load(path).where(where)


def _big_endian(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")


def probe(frames: DataFrame) -> DataFrame:
    """(video_id, fps, frame_count, width, height): sizes from the first frame that is a PNG, by its header; a missing rate is 0.

    Only headers are shuffled.  Without such a frame the sizes are null.
    """
    is_png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    rows = frames.select("video_id", "frame_index", "fps", F.when(is_png, F.substring("content", 1, 24)).alias("head"))
    out = rows.groupBy("video_id").agg(F.coalesce(F.max("fps"), F.lit(0.0)).alias("fps"), F.count(F.lit(1)).alias("frame_count"), F.min_by("head", F.when(F.col("head").isNotNull(), F.col("frame_index"))).alias("head"))
    return out.select("video_id", "fps", "frame_count", _big_endian(F.col("head"), 17).alias("width"), _big_endian(F.col("head"), 21).alias("height"))
