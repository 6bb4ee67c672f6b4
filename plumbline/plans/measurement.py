"""From images to measurements, and the validation sweep against synthetic ground truth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import absolute_error, percent_error, px_to_mm, scale_from_reference
from plumbline.operators import imaging, signal
from plumbline.session import ship
from plumbline.sources import synthetic

MEASURED = "image_id string, estimator string, major_diameter_px double, pitch_px double, confidence double, method string, notes array<string>, error string"


def measure_images(images: DataFrame, estimators: tuple[str, ...] = ("peak",), margin: float = imaging.HEAD_MARGIN) -> DataFrame:
    """A row for each image (image_id, height, width, data) and estimator, in pixels.

    An image that can't be measured has nulls and the reason in error; its caller raises, or counts
    the check as skipped.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                empty = {"major_diameter_px": None, "pitch_px": None, "confidence": None, "method": None, "notes": []}
                try:
                    gray = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width)
                    v = imaging.widths(gray)
                    a, b = imaging.thread_rows(v, margin)
                except (imaging.MeasurementError, TypeError, ValueError) as e:
                    rows += [{"image_id": r.image_id, "estimator": name, **empty, "error": str(e)} for name in estimators]
                    continue
                for name in estimators:
                    pitch, confidence, method, notes = signal.ESTIMATORS[name](v[a:b])
                    if pitch is None:
                        notes = [*notes, "pitch could not be reliably estimated for this image"]
                    rows.append({"image_id": r.image_id, "estimator": name, "major_diameter_px": float(v[a:b].max()), "pitch_px": pitch, "confidence": confidence, "method": method, "notes": notes, "error": None})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")])

    return images.select("image_id", "height", "width", "data").mapInPandas(run, MEASURED)


def calibrated(measured: DataFrame, px_per_mm: Column, source: str, validated: bool) -> DataFrame:
    """measured with millimetres, the scale and its source; a scale that isn't validated adds a note."""
    note = f"calibration source '{source}' is a demonstration reference, not a dimensionally validated scale: mm values are illustrative"
    rows = measured.withColumn("scale_px_per_mm", px_per_mm).withColumn("calibration_source", F.lit(source)).withColumn("calibrated", F.lit(validated))
    rows = rows.withColumn("major_diameter_mm", px_to_mm(F.col("major_diameter_px"), F.col("scale_px_per_mm")))
    rows = rows.withColumn("pitch_mm", px_to_mm(F.col("pitch_px"), F.col("scale_px_per_mm")))
    return rows if validated else rows.withColumn("notes", F.array_append("notes", F.lit(note)))


def sweep(parts: DataFrame, conditions: Sequence[str], estimators: Sequence[str] = ("peak", "fft")) -> DataFrame:
    """parts with a row for each condition and estimator."""
    cells = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(e).alias("estimator")) for c in conditions for e in estimators])
    return parts.withColumn("cell_", F.explode(cells)).select("*", "cell_.*").drop("cell_")


def validate(parameters: DataFrame, estimators: tuple[str, ...] = ("peak", "fft")) -> DataFrame:
    """A row of errors for each drawn sample and estimator; parameters: image_id (text, its own for each row), designation, condition, px_per_mm, and the dimensions.

    An image that can't be measured has null measurements and errors.
    """
    measured = measure_images(synthetic.draw(parameters), estimators)
    scale = scale_from_reference(F.lit(synthetic.BAR_MM) * F.col("px_per_mm"), F.lit(synthetic.BAR_MM))
    rows = measured.join(parameters.hint("merge"), "image_id")  # as many as there are images: not for the driver
    rows = rows.withColumn("measured_diameter_mm", px_to_mm(F.col("major_diameter_px"), scale)).withColumn("measured_pitch_mm", px_to_mm(F.col("pitch_px"), scale))
    return rows.select(
        "image_id", "designation", "condition", "estimator", F.col("major_mm").alias("true_diameter_mm"), "measured_diameter_mm",
        absolute_error(F.col("measured_diameter_mm"), F.col("major_mm")).alias("diameter_abs_error"),
        percent_error(F.col("measured_diameter_mm"), F.col("major_mm")).alias("diameter_pct_error"),
        F.col("pitch_mm").alias("true_pitch_mm"), "measured_pitch_mm",
        absolute_error(F.col("measured_pitch_mm"), F.col("pitch_mm")).alias("pitch_abs_error"),
        percent_error(F.col("measured_pitch_mm"), F.col("pitch_mm")).alias("pitch_pct_error"), "confidence",
    )


def validation_records(spark: SparkSession, designations: list[str], conditions: list[str], px_per_mm: float = 20.0) -> DataFrame:
    """A row of errors for each size, condition and estimator."""
    table = synthetic.parameter_table(spark, designations, conditions, px_per_mm)
    return validate(table.withColumn("image_id", F.concat_ws("/", "designation", "condition"))).drop("image_id")
