"""Frames of videos: sampling, and the worst case over a video's frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import fixed, joined, sample_interval


def sample_frames(frames: DataFrame, asked: Column | None = None, target_per_second: float = 2.0) -> DataFrame:
    """Every n-th frame of each video, with the interval and the time in seconds (0 without a frame rate).

    A plain filter and projection: frames (video_id, frame_index, fps, ...) are neither shuffled nor decoded before it.
    """
    interval = sample_interval(F.col("fps"), target_per_second, asked)
    rows = frames.withColumn("interval", interval).where(F.col("frame_index") % F.col("interval") == 0)
    at = F.when(F.col("fps") > 0, F.try_divide(F.col("frame_index"), F.col("fps"))).otherwise(F.lit(0.0))
    return rows.withColumn("timestamp_sec", at)


def worst_case(verdicts: DataFrame, key: str = "video_id") -> DataFrame:
    """For each video: frames, GO and NO_GO frames, the union of failed checks in order, and NO_GO if there are any.

    One aggregation, so what comes before it runs once.  Sets of check names are few, so collect_set holds a few arrays for each
    video however many frames it has.
    """
    checks = F.array_compact(F.flatten(F.collect_set("failed_checks")))
    out = verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(F.size("failed_checks") == 0).alias("n_go"),
        F.count_if(F.size("failed_checks") > 0).alias("n_no_go"),
        F.array_sort(F.array_distinct(checks)).alias("failed_checks"),
    )
    return out.withColumn("verdict", F.when(F.size("failed_checks") > 0, "NO_GO").otherwise("GO"))


def annotation_lines(rows: DataFrame) -> DataFrame:
    """rows with the overlay's text lines: verdict, score, diameter, pitch (0 shows as n/a), frame rate, failed checks."""
    d, p = F.col("major_diameter_mm"), F.col("pitch_mm")
    lines = F.array_compact(
        F.array(
            F.col("verdict"),
            F.concat(F.lit("anomaly "), fixed(F.col("score"), 2), F.lit(" / "), fixed(F.col("threshold"), 2)),
            F.concat(F.lit("diameter "), F.coalesce(F.concat(fixed(d, 2), F.lit("mm")), F.lit("n/a"))),
            F.concat(F.lit("pitch "), F.coalesce(F.when(p != 0, F.concat(fixed(p, 2), F.lit("mm"))), F.lit("n/a"))),
            F.concat(fixed(F.col("display_fps"), 1), F.lit(" fps")),
            F.when(F.size("failed_checks") > 0, F.concat(F.lit("failed: "), joined(F.col("failed_checks")))),
        )
    )
    return rows.withColumn("lines", lines)


def playback_rate(fps: Column, interval: Column) -> Column:
    return F.when(fps > 0, F.try_divide(fps, interval)).otherwise(F.lit(2.0))
