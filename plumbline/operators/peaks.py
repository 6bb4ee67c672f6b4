"""Peaks with a least distance and prominence, and the pitch estimate from their spacing, without Python.

A signal table is long: (signal_id, i, v) with i from 0 without gaps.

Distance.  Peaks are never neighbours, so with a least distance of 3 only peaks two apart compete.  Along a chain of such peaks the higher of
two stays, of equals the later; from each peak that nothing beats, every second one on either side stays.

Prominence.  A peak's prominence is below a limit if and only if it is taken away by this: while a peak stands beside a higher one, or
beside an end of the signal, and the lowest value between them is less than the limit below it, it goes, and the values on its two sides become
one valley.  Taking one away never changes what is to come of another, so all that can go, go in one round; rounds end when none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import spacing_confidence
from plumbline.session import cut

PROMINENCE_SHARE = 0.15


def runs(signal: DataFrame) -> DataFrame:
    """(signal_id, run, a, b, v): runs of equal values, from a to b."""
    own = Window.partitionBy("signal_id").orderBy("i")
    new = F.coalesce((F.col("v") != F.lag("v").over(own)).cast("long"), F.lit(1))
    rows = signal.select("signal_id", "i", "v", new.alias("new")).withColumn("run", F.sum("new").over(own))
    return rows.groupBy("signal_id", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.first("v").alias("v"))


def maxima(signal: DataFrame) -> DataFrame:
    """(signal_id, peak, v, left_low, right_low): runs that are higher than both runs beside them, a plateau at its middle rounded down.

    left_low and right_low: the least value back to the peak before, or the signal's begin, and on to the next one, or the end.
    """
    own = Window.partitionBy("signal_id").orderBy("run")
    rows = runs(signal).withColumn("before", F.lag("v").over(own)).withColumn("after", F.lead("v").over(own))
    rows = rows.withColumn("is_peak", F.coalesce((F.col("v") > F.col("before")) & (F.col("v") > F.col("after")), F.lit(False)))
    # a stretch is a peak and what follows it up to the next one; the first one has no peak
    rows = rows.withColumn("stretch", F.sum(F.col("is_peak").cast("long")).over(own))
    peak = F.when(F.col("is_peak"), F.floor((F.col("a") + F.col("b")) / 2))
    parts = rows.groupBy("signal_id", "stretch").agg(F.max(peak).alias("peak"), F.max(F.when(F.col("is_peak"), F.col("v"))).alias("v"), F.min("v").alias("low"))
    by = Window.partitionBy("signal_id").orderBy("stretch")
    parts = parts.withColumn("left_low", F.lag("low").over(by))
    return parts.where("peak IS NOT NULL").select("signal_id", "peak", "v", "left_low", F.col("low").alias("right_low"))


def apart(peaks: DataFrame) -> DataFrame:
    """The peaks that stay under a least distance of 3: of peaks two apart the higher one, of equals the later."""
    own = Window.partitionBy("signal_id").orderBy("peak")
    beaten_left = F.coalesce((F.col("peak") - F.lag("peak").over(own) < 3) & (F.lag("v").over(own) > F.col("v")), F.lit(False))
    beaten_right = F.coalesce((F.lead("peak").over(own) - F.col("peak") < 3) & (F.lead("v").over(own) >= F.col("v")), F.lit(False))
    rows = peaks.withColumn("n", F.row_number().over(own)).withColumn("bl", beaten_left).withColumn("br", beaten_right)
    # steps from the nearest peak on either side that nothing on that side beats; only an even number of steps keeps a peak
    back = Window.partitionBy("signal_id").orderBy(F.col("peak").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    from_left = F.col("n") - F.max(F.when(~F.col("bl"), F.col("n"))).over(upto)
    from_right = F.min(F.when(~F.col("br"), F.col("n"))).over(back) - F.col("n")
    rows = rows.withColumn("l", from_left).withColumn("r", from_right)
    return rows.where("l % 2 = 0 AND r % 2 = 0").drop("n", "bl", "br", "l", "r")


def prominent(peaks: DataFrame, least: Column) -> DataFrame:
    """(signal_id, peak) of the maxima whose prominence is at least that; `least` is a column of peaks, the same in all rows of a signal."""
    now = cut(peaks.select("signal_id", "peak", "v", "left_low", "right_low", least.alias("least")))
    own = Window.partitionBy("signal_id").orderBy("peak")
    while True:
        left, right = F.lag("v").over(own), F.lead("v").over(own)
        lost_left = (left.isNull() | (left > F.col("v"))) & (F.col("v") - F.col("left_low") < F.col("least"))
        lost_right = (right.isNull() | (right > F.col("v"))) & (F.col("v") - F.col("right_low") < F.col("least"))
        judged = cut(now.withColumn("lost", lost_left | lost_right))
        if not judged.where("lost").limit(1).count():
            return now.select("signal_id", "peak")
        # what is taken away gives its valleys to the next peak that stays, on either side
        back = Window.partitionBy("signal_id").orderBy(F.col("peak").desc())
        stays = F.when(~F.col("lost"), 1).otherwise(0)
        groups = judged.withColumn("after", F.coalesce(F.sum(stays).over(back.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        groups = groups.withColumn("upto", F.coalesce(F.sum(stays).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        lows = groups.withColumn("ll", F.min(F.least("left_low", F.when(F.col("lost"), F.col("right_low")))).over(Window.partitionBy("signal_id", "after")))
        lows = lows.withColumn("rl", F.min(F.least("right_low", F.when(F.col("lost"), F.col("left_low")))).over(Window.partitionBy("signal_id", "upto")))
        now = lows.where(~F.col("lost")).select("signal_id", "peak", "v", F.col("ll").alias("left_low"), F.col("rl").alias("right_low"), "least")


def find_peaks(signal: DataFrame, prominence: float | None = None) -> DataFrame:
    """(signal_id, peak) with a least distance of 3 and that prominence; None: a share of the signal's range, or of 1 where it is flat."""
    reach = signal.groupBy("signal_id").agg((F.max("v") - F.min("v")).alias("reach"))
    least = F.lit(float(prominence)) if prominence is not None else F.lit(PROMINENCE_SHARE) * F.when(F.col("reach") > 0, F.col("reach")).otherwise(1.0)
    found = cut(maxima(signal))
    high = prominent(found.join(reach, "signal_id"), least)
    return apart(found).join(high, ["signal_id", "peak"], "left_semi").select("signal_id", "peak")


def peak_estimates(signal: DataFrame, prominence: float | None = None) -> DataFrame:
    """(signal_id, pitch_px, confidence, method, notes): the median spacing of peaks, for every signal; none below 3 peaks or 5 values."""
    sizes = signal.groupBy("signal_id").agg(F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy("signal_id").orderBy("peak")
    peaks = cut(find_peaks(signal, prominence)).withColumn("gap", (F.col("peak") - F.lag("peak").over(own)).cast("double"))
    # the median's buffer holds a count for each different spacing, of which there are few
    stats = peaks.groupBy("signal_id").agg(F.count("peak").alias("n"), F.percentile("gap", 0.5).alias("middle"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("spread"))
    rows = sizes.join(stats, "signal_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short, few = F.col("size") < 5, F.col("n") < 3
    found = ~short & ~few
    note = F.when(short, "signal too short to estimate pitch").when(few, F.concat(F.lit("found only "), F.col("n").cast("string"), F.lit(" thread-crest peaks; need >= 3")))
    note = note.when(F.col("n") < 5, F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" peaks found; pitch estimate may be unstable")))
    return rows.select(
        "signal_id", F.when(found, F.col("middle")).alias("pitch_px"), F.when(found, spacing_confidence(F.col("mean"), F.col("spread"), F.col("n"))).otherwise(0.0).alias("confidence"),
        F.lit("peak_spacing").alias("method"), F.array_compact(F.array(note)).alias("notes"),
    )
