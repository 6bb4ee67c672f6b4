"""Whole inspections: images or sampled frames, measured, scored and judged, and their sinks."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import DEMO_PX_PER_MM, base64_text
from plumbline.operators import fusion, video
from plumbline.plans.measurement import calibrated, measure_images
from plumbline.session import ship


def inspect_images(images: DataFrame, scores: DataFrame, px_per_mm: float = DEMO_PX_PER_MM, source: str = "demo_reference", validated: bool = False, strict: bool = False) -> DataFrame:
    """A verdict for each scored image; scores: (image_id, score, threshold).

    strict: an image that can't be measured is an error; else its dimensional check is skipped.
    """
    measured = calibrated(measure_images(images), F.lit(px_per_mm), source, validated)
    if strict:
        measured = measured.where(F.assert_true(F.col("error").isNull(), F.concat(F.lit("measurement failed: "), F.col("image_id"))).isNull())
    rows = fusion.join_measurements(scores, measured.drop("estimator"), "image_id")
    return fusion.fuse_verdict(rows)


def inspect_video(frames: DataFrame, scores: DataFrame, asked: Column | None = None, px_per_mm: float = DEMO_PX_PER_MM) -> tuple[DataFrame, DataFrame]:
    """Verdicts of the sampled frames, and the worst case of each video.

    frames: (video_id, frame_index, fps, height, width, data); scores: (video_id, frame_index, score, threshold).
    Frames are sampled before anything is decoded or measured.
    """
    name = F.concat_ws("/", "video_id", F.col("frame_index").cast("string"))
    sampled = video.sample_frames(frames, asked).withColumn("image_id", name)
    keyed = scores.withColumn("image_id", name).drop("video_id", "frame_index")
    keyed = sampled.select("image_id", "video_id", "frame_index", "timestamp_sec", "fps", "interval").join(keyed, "image_id")
    measured = calibrated(measure_images(sampled), F.lit(px_per_mm), "demo_reference", False).drop("estimator")
    verdicts = fusion.fuse_verdict(fusion.join_measurements(keyed, measured, "image_id"))
    notes = F.when(F.col("error").isNotNull(), F.concat(F.lit("frame "), F.col("frame_index").cast("string"), F.lit(": measurement failed ("), F.col("error"), F.lit(")")))
    verdicts = verdicts.withColumn("frame_note", notes).withColumn("display_fps", video.playback_rate(F.col("fps"), F.col("interval")))
    return verdicts, video.worst_case(verdicts)


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


#: Values of the colours that are blended at a time, unless one image has more.
OVERLAY_VALUES = 1 << 20


def overlay_png(images: DataFrame, maps: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """(image_id, png_base64): each image (height, width, data) blended with its heatmap's colours.

    maps: (image_id, heatmap), joined to the images; none where the images carry their heatmap, which then costs no join and no second reading of what
    they were made from.  Images of one shape are blended together, so many at a time that a task's memory doesn't follow the batch.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.operators.imaging import blend
        from plumbline.sources.png import encode

        for batch in batches:
            shapes: dict[tuple[int, int], list[int]] = {}
            for i, shape in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                shapes.setdefault(shape, []).append(i)
            for (height, width), same in shapes.items():
                at_once = max(1, OVERLAY_VALUES // (3 * height * width))
                for at in range(0, len(same), at_once):
                    some = batch.take(pa.array(same[at : at + at_once]))
                    gray = np.stack([np.frombuffer(v, np.uint8).reshape(height, width) for v in some.column(3).to_pylist()])
                    heat = np.stack([v.values.to_numpy(zero_copy_only=False).reshape(height, width) for v in some.column(4)])
                    made = pa.array([encode(v) for v in blend(gray, heat, alpha)], pa.binary())
                    yield pa.RecordBatch.from_arrays([some.column(0), made], ["image_id", "png"])

    if maps is not None:
        images = images.select("image_id", "height", "width", "data").join(maps.hint("merge"), "image_id")  # heatmaps are larger than estimated, too large to be broadcast
    name = images.schema["image_id"].dataType.simpleString()
    rows = images.select("image_id", "height", "width", "data", "heatmap").mapInArrow(run, f"image_id {name}, png binary")
    return rows.select("image_id", base64_text(F.col("png")).alias("png_base64"))


#: Values of the network's inputs that are made at a time, unless one image has more.
INPUT_VALUES = 1 << 20


def network_input(images: DataFrame, size: int = 224) -> DataFrame:
    """(image_id, input): each image (height, width, data) as a network takes it, three channels of size x size values, one after the other.

    Images of one shape are resized together, so many at a time that a task's memory doesn't follow the batch.
    """
    ship(images.sparkSession)
    name = images.schema["image_id"].dataType.simpleString()
    at_once = max(1, INPUT_VALUES // (3 * size * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.operators.imaging import normalised_input

        for batch in batches:
            heights, widths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for height, width in sorted(set(zip(heights.tolist(), widths.tolist(), strict=True))):
                same = np.flatnonzero((heights == height) & (widths == width))
                for at in range(0, len(same), at_once):
                    some = batch.take(pa.array(same[at : at + at_once]))
                    gray = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8).reshape(-1, height, width)
                    made = normalised_input(gray, size).reshape(len(gray), -1)
                    ends = pa.array(np.arange(len(gray) + 1, dtype=np.int32) * made.shape[1])
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], ["image_id", "input"])

    return images.select("image_id", "height", "width", "data").mapInArrow(run, f"image_id {name}, input array<float>")


#: What every log line has, in this order, and how a record gives it (none: the line goes without).
LINE = {
    "timestamp": lambda r: datetime.fromtimestamp(r.created, UTC).isoformat(),
    "level": lambda r: r.levelname,
    "logger": lambda r: r.name,
    "message": logging.LogRecord.getMessage,
    "exception": lambda r: logging.Formatter().formatException(r.exc_info) if r.exc_info else None,
}
_STANDARD = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """A record as one JSON object: the fields of LINE, then whatever else the caller gave, under names that are still free."""

    def format(self, record: logging.LogRecord) -> str:
        line = {name: value for name, give in LINE.items() if (value := give(record)) is not None}
        for name in record.__dict__.keys() - _STANDARD:
            line.setdefault(name, record.__dict__[name])
        return json.dumps(line, default=str)


def log_json(level: int = logging.INFO) -> None:
    """Logging as JSON lines on standard output; calling it again changes the level only."""
    root = logging.getLogger()
    root.setLevel(level)
    if not any(isinstance(h.formatter, JsonLines) for h in root.handlers):
        out = logging.StreamHandler(sys.stdout)
        out.setFormatter(JsonLines())
        root.addHandler(out)
