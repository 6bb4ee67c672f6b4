"""Sample manifests: nested JSON of samples with split, category, defect and an optional mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "samples array<struct<filepath:string,split:string,category:struct<label:string>,"
    "defect:struct<label:string>,defect_mask:struct<mask_path:string>>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sample of the manifest file."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path).select(F.explode("samples").alias("s")).select("s.*")


def samples(manifest: DataFrame, category: str) -> DataFrame:
    """(image_path, split, defect_label, mask_path, is_defective) of a category; mask_path may be null."""
    rows = manifest.where(F.col("category.label") == category)
    rows = rows.select(
        F.col("filepath").alias("image_path"), "split", F.col("defect.label").alias("defect_label"), F.col("defect_mask.mask_path").alias("mask_path")
    )
    return rows.withColumn("is_defective", is_defective(F.col("defect_label")))


def is_defective(label: Column) -> Column:
    return label != "good"


def train_normal(df: DataFrame) -> DataFrame:
    return df.where((F.col("split") == "train") & ~F.col("is_defective"))


def test_samples(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test")


def first_images(samples: DataFrame, n: int) -> DataFrame:
    """The first n paths in their order; the limit is the feature."""
    return samples.select("image_path").orderBy("image_path").limit(n)


def image_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("is_defective").cast("int"))


def needed_files(df: DataFrame) -> DataFrame:
    """The distinct image and mask paths, in order."""
    both = df.select(F.col("image_path").alias("path")).union(df.where("mask_path is not null").select("mask_path"))
    return both.distinct().orderBy("path")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def verify_counts(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """df, if its splits have just these counts; else an error."""
    found = {r["split"]: r["n"] for r in split_counts(df).collect()}
    if found != expected:
        raise RuntimeError(f"split counts are {found}, expected {expected}")
    return df
