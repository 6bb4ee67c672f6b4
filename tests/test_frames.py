"""The frame source opens what is asked for, and nothing else."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, StringContains

from plumbline.sources import frames
from plumbline.sources.png import encode


@pytest.fixture
def folder(tmp_path):
    for video, n in (("a", 20), ("b", 7), ("c", 0)):
        (tmp_path / "in" / video).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "in" / video / f"frame_{i:04d}.png").write_bytes(encode(np.full((3, 5 + (video == "b")), i, np.uint8)))
    (tmp_path / "in" / "a" / "notes.txt").write_text("no frame")
    return tmp_path / "in"


def opened(reader, folder):
    names = []
    inner = reader._content
    reader._content = lambda files, path: names.append(path.removeprefix(f"{folder}/")) or inner(files, path)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == len(names)
    return sorted(names)


def test_sampled_out_frames_are_not_opened(folder, monkeypatch):
    monkeypatch.setattr(frames, "FRAMES_PER_PARTITION", 3)
    everything = opened(frames.FrameReader({"path": str(folder)}), folder)
    assert len(everything) == 27
    reader = frames.FrameReader({"path": str(folder), "every": "6"})
    assert opened(reader, folder) == ["a/frame_0000.png", "a/frame_0006.png", "a/frame_0012.png", "a/frame_0018.png", "b/frame_0000.png", "b/frame_0006.png"]
    reader = frames.PushedReader({"path": str(folder)})
    left = list(reader.pushFilters([EqualTo(("video_id",), "a"), GreaterThanOrEqual(("frame_index",), 18), StringContains(("video_id",), "a")]))
    assert len(left) == 1 and opened(reader, folder) == ["a/frame_0018.png", "a/frame_0019.png"]
    reader = frames.PushedReader({"path": str(folder)})
    assert list(reader.pushFilters([In(("frame_index",), (2, 5, 99))])) == [] and len(opened(reader, folder)) == 4
    assert [frames.every_nth(o) for o in ({}, {"per_second": "2", "fps": "25"}, {"per_second": "2"}, {"per_second": "2", "fps": "1"}, {"every": "4", "per_second": "2"})] == [1, 12, 10, 1, 4]


def test_source_in_a_query(spark, folder):
    table = frames.read_frames(spark, str(folder), fps="30")
    assert table.count() == 27
    some = frames.read_frames(spark, str(folder), (F.col("video_id") == "a") & (F.col("frame_index") > 16) & (F.length("content") > 0))
    assert sorted(r["frame_index"] for r in some.collect()) == [17, 18, 19]
    frames.register(spark)
    table = spark.read.format("plumbline_frames").option("fps", "30").load(str(folder))
    assert table.where("video_id = 'b'").count() == 7 and table.count() == 27
    (folder / "b" / "frame_0003.png").unlink()
    (folder / "b" / "frame_0003.png").symlink_to("/nowhere")
    assert spark.read.format("plumbline_frames").option("every", "2").load(str(folder)).where("video_id = 'b'").count() == 4
    table = spark.read.format("plumbline_frames").option("fps", "30").load(str(folder))
    got = {r["video_id"]: tuple(r)[1:] for r in frames.probe(table.withColumn("content", F.when(F.col("frame_index") > 0, F.col("content")))).collect()}
    assert got == {"a": (30.0, 20, 5, 3), "b": (30.0, 6, 6, 3)}
    assert spark.read.format("plumbline_frames").load(str(folder / "c")).count() == 0
