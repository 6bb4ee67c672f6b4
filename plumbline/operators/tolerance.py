"""Nearest nominal size and the check against its diameter limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.nearest_key import nearest_key

#: Fixed values, in order: designation, pitch, basic, largest and smallest major diameter in mm.
SIZES = (
    ("M1.6", 0.35, 1.600, 1.581, 1.496),
    ("M2", 0.40, 2.000, 1.981, 1.886),
    ("M2.5", 0.45, 2.500, 2.480, 2.380),
    ("M3", 0.50, 3.000, 2.980, 2.874),
    ("M4", 0.70, 4.000, 3.978, 3.838),
    ("M5", 0.80, 5.000, 4.976, 4.826),
    ("M6", 1.00, 6.000, 5.974, 5.794),
    ("M8", 1.25, 8.000, 7.972, 7.760),
    ("M10", 1.50, 10.000, 9.968, 9.732),
    ("M12", 1.75, 12.000, 11.966, 11.701),
)
TOLERANCE_CLASS = "6g"
SCHEMA = "ordinal int, designation string, pitch_mm double, basic_mm double, max_mm double, min_mm double"


def size_table(spark: SparkSession) -> DataFrame:
    """The ten sizes as rows; ordinal keeps their order, which decides ties."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SIZES)], SCHEMA)


def _entry(i: int) -> Column:
    name, pitch, basic, most, least = SIZES[i]
    return F.struct(
        F.lit(name).alias("designation"), F.lit(pitch).alias("pitch_mm"), F.lit(basic).alias("basic_mm"), F.lit(most).alias("max_mm"), F.lit(least).alias("min_mm"),
        F.lit(f"class-{TOLERANCE_CLASS} limits [{least:.3f}, {most:.3f}]mm").alias("limits"),
    )


def nearest_size(diameter_mm: Column) -> Column:
    """The size whose basic diameter is nearest; of two equally near, the first of the table.

    The table is fixed and small, so it is part of the expression: no join, no shuffle.
    """
    options = [
        F.struct(F.abs(F.lit(s[2]) - diameter_mm).alias("gap"), F.lit(i).alias("ordinal"), _entry(i).alias("size")) for i, s in enumerate(SIZES)
    ]
    return F.when(diameter_mm.isNotNull(), F.array_min(F.array(*options))["size"])


def size_of(designation: Column) -> Column:
    """The size of that name; an unknown name is an error, null stays null."""
    known = F.create_map(*[x for i, s in enumerate(SIZES) for x in (F.lit(s[0]), _entry(i))])
    found = F.try_element_at(known, F.coalesce(designation, F.lit("")))
    names = ", ".join(sorted(s[0] for s in SIZES))
    wrong = F.raise_error(F.concat(F.lit("unknown designation "), designation, F.lit(f"; known: {names}")))
    return F.when(designation.isNull(), F.lit(None)).when(found.isNotNull(), found).otherwise(
        F.struct(wrong.cast("string").alias("designation"), *[F.lit(0.0).alias(c) for c in ("pitch_mm", "basic_mm", "max_mm", "min_mm")], F.lit("").alias("limits"))
    )


def matched_size(diameter_mm: Column, designation: Column | None = None) -> Column:
    """The named size, or the nearest one where no name is given ('' is none)."""
    if designation is None:
        return nearest_size(diameter_mm)
    name = F.nullif(designation, F.lit(""))
    return F.when(diameter_mm.isNull(), F.lit(None)).when(name.isNull(), nearest_size(diameter_mm)).otherwise(size_of(name))


def within(diameter_mm: Column, size: Column) -> Column:
    """Inside the limits, both inclusive; NaN isn't."""
    return (diameter_mm >= size["min_mm"]) & (diameter_mm <= size["max_mm"])


def with_size(df: DataFrame, sizes: DataFrame, diameter: str) -> DataFrame:
    """df with size, the nearest row of a size table given as a DataFrame of any number of rows; ties by ordinal."""
    return nearest_key(df, diameter, sizes, "basic_mm", "ordinal", "size")
