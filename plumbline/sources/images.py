"""Image and frame sources: folders of PNG files, decoded images, and those that can't be decoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship
from plumbline.sources.png import decode_colour, decode_gray

DECODED = "struct<height:int,width:int,data:binary,error:string>"


def image_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(image_id, content): the files of a folder and its subfolders, each its own row; the path is the id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("image_id"), "content")


def decode(images: DataFrame, content: str = "content", colour: bool = False) -> DataFrame:
    """images with height, width, data (grey levels or RGB, row-major) and error, in place of the content.

    What can't be decoded stays, with a null image and the reason: the caller chooses to raise or to set it aside.
    """
    ship(images.sparkSession)
    read = decode_colour if colour else decode_gray

    @F.arrow_udf(DECODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for value in batch:
                try:
                    g = read(value.as_py())
                    rows.append({"height": g.shape[0], "width": g.shape[1], "data": g.tobytes(), "error": None})
                except ValueError as e:
                    rows.append({"height": None, "width": None, "data": None, "error": str(e)})
            yield pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("error", pa.string())]))

    once = run.asNondeterministic()  # else a filter on what it gives would run it a second time, before any repartitioning
    return images.withColumn("image_", once(F.col(content))).drop(content).select("*", "image_.*").drop("image_")


def readable(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNull())


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNotNull())


def all_readable(decoded: DataFrame) -> DataFrame:
    """decoded, but a row that couldn't be decoded is an error once it is read."""
    return decoded.where(F.assert_true(F.col("error").isNull(), F.concat(F.lit("could not decode image "), F.col("image_id"))).isNull())


def frame_table(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """(video_id, frame_index, fps, content) from PNG frames in one folder for each video, numbered by their sorted names."""
    files = image_files(spark, path).withColumn("video_id", F.element_at(F.split("image_id", "/"), -2))
    number = F.regexp_extract("image_id", r"(\d+)\.png$", 1).cast("int")
    return files.select("video_id", number.alias("frame_index"), F.lit(float(fps)).alias("fps"), "content")
