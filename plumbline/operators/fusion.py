"""Verdicts from an anomaly score and a measured diameter, with the checks that failed and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import exceeds, fixed
from plumbline.operators.tolerance import matched_size, within

#: Texts of the reasons.
DISCLAIMER = (
    "The tolerance table is used to demonstrate standards-aware decision logic "
    "and does not constitute certified dimensional inspection or complete "
    "ISO 965 compliance verification."
)
SKIPPED = "dimensional check skipped: measurement pipeline did not produce a result for this image"


def join_measurements(scores: DataFrame, measurements: DataFrame, key: str) -> DataFrame:
    """Every score, with its item's measurement where there is one."""
    return scores.join(measurements, key, "left")


def failed_checks(anomalous: Column, outside: Column) -> Column:
    return F.array_compact(F.array(F.when(anomalous, F.lit("anomaly_score")), F.when(outside, F.lit("major_diameter"))))


def fuse_verdict(
    items: DataFrame,
    score: str = "score",
    threshold: str = "threshold",
    diameter: str = "major_diameter_mm",
    designation: str | None = None,
    reasons: bool = True,
) -> DataFrame:
    """items with verdict, failed_checks, matched_designation, in_tolerance and reasoning.

    An item fails if its score exceeds the threshold (NaN never does) or its diameter is outside its
    size's limits.  A null diameter is a measurement that failed: its check is skipped, not failed.
    Other measurement columns (pitch_mm, confidence, calibrated, calibration_source) pass through;
    calibrated = false adds a reason.  reasons=False leaves the texts out.
    """
    d = F.col(diameter)
    rows = items.withColumn("size_", matched_size(d, F.col(designation) if designation else None))
    anomalous = exceeds(F.col(score), F.col(threshold))
    inside = F.when(d.isNotNull(), within(d, F.col("size_")))
    rows = rows.withColumn("in_tolerance", inside).withColumn("failed_checks", failed_checks(anomalous, ~F.col("in_tolerance")))
    rows = rows.withColumn("verdict", F.when(F.size("failed_checks") > 0, "NO_GO").otherwise("GO"))
    rows = rows.withColumn("matched_designation", F.col("size_.designation"))
    if reasons:
        said = F.when(anomalous, " exceeds threshold ").otherwise(" within threshold ")
        first = F.concat(F.lit("anomaly score "), fixed(F.col(score), 3), said, fixed(F.col(threshold), 3))
        where = F.when(F.col("in_tolerance"), "mm within ").otherwise("mm outside ")
        checked = F.concat(F.lit("major diameter "), fixed(d, 3), where, F.col("matched_designation"), F.lit(" "), F.col("size_.limits"))
        second = F.when(d.isNull(), F.lit(SKIPPED)).otherwise(checked)
        third = F.lit(None).cast("string")
        if "calibrated" in items.columns:
            source = F.col("calibration_source") if "calibration_source" in items.columns else F.lit("n/a")
            note = F.concat(F.lit("dimensional check used calibration source '"), source, F.lit("', which is not dimensionally validated: illustrative, not certified"))
            third = F.when(d.isNotNull() & ~F.col("calibrated"), note)
        rows = rows.withColumn("reasoning", F.array_compact(F.array(first, second, third, F.lit(DISCLAIMER))))
    return rows.drop("size_")


def measurement_map(diameter: Column, pitch: Column) -> Column:
    """The measured values by name; their values may be null."""
    return F.create_map(F.lit("major_diameter_mm"), diameter.cast("double"), F.lit("pitch_mm"), pitch.cast("double"))
