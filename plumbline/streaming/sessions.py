"""A video's worst case as state that ends: one result when a video has been quiet for a while, and its state is let go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.session import ship

RESULT = "video_id string, n_frames long, n_no_go long, failed_checks array<string>, verdict string, last_at timestamp"
#: RocksDB keeps this kind of state; the session must name it before the query starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WorstCase(StatefulProcessor):
    """Per video: the frames seen, failed checks and the last time.  A timer of event time ends it."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "frame_index long", "no_go boolean")
        self.checks = handle.getMapState("checks", "name string", "n long")
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        last = self.last.get()[0] if self.last.exists() else None
        newest = last
        for pdf in rows:
            for index, failed, ms in zip(pdf["frame_index"], pdf["failed_checks"], pdf["at_ms"], strict=True):
                if self.seen.containsKey((int(index),)):
                    continue  # a frame that comes again changes nothing
                self.seen.updateValue((int(index),), (len(failed) > 0,))
                for name in failed:
                    self.checks.updateValue((name,), (1 + (self.checks.getValue((name,))[0] if self.checks.containsKey((name,)) else 0),))
                newest = int(ms) if newest is None else max(newest, int(ms))
        if newest != last:
            if last is not None:
                self.handle.deleteTimer(last + self.quiet_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.quiet_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        no_go = [v[0] for v in self.seen.values()]
        failed = sorted(k[0] for k in self.checks.keys())
        row = (key[0], len(no_go), sum(no_go), failed, "NO_GO" if failed else "GO", pd.Timestamp(self.last.get()[0], unit="ms"))
        for state in (self.seen, self.checks, self.last):
            state.clear()
        yield pd.DataFrame([row], columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def worst_case_of_ended_videos(verdicts: DataFrame, at: str, late: str = "10 minutes", quiet_ms: int = 600_000) -> DataFrame:
    """(video_id, n_frames, n_no_go, failed_checks, verdict, last_at) of each video once it has been quiet for quiet_ms of event time; append mode.

    verdicts: a stream of (video_id, frame_index, failed_checks ARRAY<STRING>) with a time.  A frame that comes twice counts once; frames later
    than `late` behind the newest are dropped.  A video's state, its frames' numbers and checks' names, goes with its result; frames
    that come after that begin the video anew.
    """
    ship(verdicts.sparkSession)
    rows = verdicts.withColumn("at_", F.col(at).cast("timestamp")).withWatermark("at_", late)
    rows = rows.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index"), "failed_checks", F.unix_millis("at_").alias("at_ms"), "at_")
    return rows.groupBy("video_id").transformWithStateInPandas(WorstCase(quiet_ms), RESULT, "Append", "EventTime")
