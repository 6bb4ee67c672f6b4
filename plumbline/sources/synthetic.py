"""Deterministic images of threads of known size, drawn in parallel from a table of their parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators import imaging
from plumbline.operators.tolerance import size_of
from plumbline.session import ship, spread

#: The rest of a sample's dimensions in mm, and the canvas in pixels.
SHANK_MM, HEAD_MM, HEAD_LENGTH_MM, BAR_MM = 20.0, 12.0, 4.0, 10.0
HEIGHT, WIDTH = 500, 700
#: Images that are drawn at a time, and that a task draws: what reads them next may take all rows of a task in one batch.
AT_ONCE, IN_TASK = 32, 128
#: A thread's depth in pitches: the minor diameter is so much less than the major one.
DEPTH = 1.2
DRAWN = "bar_px double, bar_mm double, height int, width int, data binary"


def half_widths(major: float, minor: float, pitch: float, px_per_mm: float) -> np.ndarray:
    """Half the part's width in pixels at each row of the canvas; minus infinity where there is none."""
    y = np.arange(HEIGHT)
    top = int(0.08 * HEIGHT)
    below_head = top + HEAD_LENGTH_MM * px_per_mm
    depth = y - int(below_head)
    swing = (major + minor + (major - minor) * np.sin(2 * np.pi * depth / (pitch * px_per_mm))) * px_per_mm / 4
    head = np.where((y >= top) & (y <= below_head), HEAD_MM * px_per_mm / 2, -np.inf)
    shank = np.where((depth >= 0) & (depth < int(SHANK_MM * px_per_mm)), swing, -np.inf)
    return np.maximum(head, shank)


def draw_thread(major: float, minor: float, pitch: float, px_per_mm: float = 20.0, condition: str = "clean", turn: float = 20.0, blur: int = 7) -> np.ndarray:
    """A head, a shank whose width swings between the diameters at the pitch, and a bar of known length, white on black.

    The part stands in the middle of the left half, the bar in the right one; both ends of a row
    are cut down to whole pixels and belong to it.  A part or a bar that doesn't fit is an error.
    """
    finish = {"clean": lambda x: x, "blur": lambda x: imaging.smooth(x, blur), "rotated": lambda x: imaging.rotate(x, (WIDTH / 2, HEIGHT / 2), turn, (HEIGHT, WIDTH))}
    if condition not in finish:
        raise ValueError(f"unknown condition: {condition!r}")
    half, middle = half_widths(major, minor, pitch, px_per_mm)[:, None], WIDTH / 4
    bar = int(0.6 * WIDTH), int(int(0.6 * WIDTH) + BAR_MM * px_per_mm)
    if max(half.max(), major * px_per_mm / 2) >= middle or bar[1] >= WIDTH:
        raise ValueError("the canvas is too narrow")
    y, x = np.ogrid[0:HEIGHT, 0:WIDTH]
    part = (x >= np.floor(middle - half)) & (x <= np.floor(middle + half))
    part |= (abs(y - HEIGHT // 2) <= 1) & (x >= bar[0]) & (x <= bar[1])
    return finish[condition](part.astype(np.uint8) * 255)


def dimensions(samples: DataFrame) -> DataFrame:
    """samples with major_mm, minor_mm and pitch_mm of their designation; an unknown one is an error."""
    size = size_of(F.col("designation"))
    return samples.withColumns({"major_mm": size["basic_mm"], "minor_mm": size["basic_mm"] - DEPTH * size["pitch_mm"], "pitch_mm": size["pitch_mm"]})


def parameter_table(spark: SparkSession, designations: list[str], conditions: list[str], px_per_mm: float = 20.0) -> DataFrame:
    """A row for each size and condition."""
    rows = [(d, c, px_per_mm) for d in designations for c in conditions]
    return dimensions(spark.createDataFrame(rows, "designation string, condition string, px_per_mm double"))


def draw(parameters: DataFrame) -> DataFrame:
    """parameters (designation, condition, px_per_mm, the three dimensions, and what else a row has) with the drawn images and their bar."""
    ship(parameters.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b.iloc[at : at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            images = [draw_thread(r.major_mm, r.minor_mm, r.pitch_mm, r.px_per_mm, r.condition) for r in pdf.itertuples()]
            yield pdf.assign(
                bar_px=BAR_MM * pdf["px_per_mm"], bar_mm=BAR_MM, height=[i.shape[0] for i in images], width=[i.shape[1] for i in images], data=[i.tobytes() for i in images]
            )

    return spread(parameters, rows=IN_TASK).mapInPandas(run, StructType([*parameters.schema, *StructType.fromDDL(DRAWN)]))
