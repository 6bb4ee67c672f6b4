"""The worst case over a video's frames, kept up to date while frames arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_worst_case(verdicts: DataFrame, at: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(video_id, n_frames, n_no_go, failed_checks, verdict) of a stream, for update or complete mode.

    verdicts: (video_id, failed_checks ARRAY<STRING>).  The state of a video is two counts and the few names of checks.
    at: a time column; with it, frames later than `late` are dropped and a video's hourly state can be let go.
    A time without zone is taken as UTC, since watermarks need one.
    """
    keys = ["video_id"]
    rows = verdicts
    if at is not None:
        rows = verdicts.withColumn("at_", F.col(at).cast("timestamp")).withWatermark("at_", late)
        keys = ["video_id", F.window("at_", "1 hour")]
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(F.size("failed_checks") > 0).alias("n_no_go"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("failed_checks")))).alias("failed_checks"),
    )
    return out.withColumn("verdict", F.when(F.size("failed_checks") > 0, "NO_GO").otherwise("GO"))
