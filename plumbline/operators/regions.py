"""Segmentation as relations: thresholds from histograms, and regions from runs; an image may have any size.

A pixel table is long: (image_id, y, x, level).  If the images are dealt to tasks by image_id before they become pixels, thresholds and runs need no
further shuffle.  Tables grow by these steps beyond what the planner estimates, so joins are by sorted keys and never by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import connected

#: Columns of an image that runs of two rows are compared in at a time.
TILE = 64


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, y, x, level) of images (image_id, height, width, data): rows first, then the pixels of each row."""
    rows = images.select("image_id", "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.select("image_id", "width", "y", F.hex(F.substring("data", F.col("y") * F.col("width") + 1, F.col("width"))).alias("line"))
    cells = rows.select("image_id", "y", "line", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return cells.select("image_id", "y", "x", F.conv(F.substring("line", F.col("x") * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("level"))


def otsu_levels(image_pixels: DataFrame) -> DataFrame:
    """(image_id, level, n_above, n): the grey level that best parts the pixels up to it from the rest (of equals the least), and how many are above.

    Pixels are counted by level before the shuffle, so what comes together of an image is its levels.
    """
    counts = image_pixels.groupBy("image_id", "level").agg(F.count(F.lit(1)).cast("double").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    mass = F.col("n") * F.col("level")
    rows = counts.select("image_id", "level", F.sum("n").over(upto).alias("below"), F.sum(mass).over(upto).alias("total"), F.sum("n").over(whole).alias("all_n"), F.sum(mass).over(whole).alias("all_total"))
    above = F.col("all_n") - F.col("below")
    gap = F.try_divide(F.col("total"), F.col("below")) - F.try_divide(F.col("all_total") - F.col("total"), above)
    rows = rows.withColumn("between", F.coalesce(F.col("below") * above * gap * gap, F.lit(0.0))).withColumn("above", above.cast("long"))
    best = rows.groupBy("image_id").agg(F.min(F.struct((-F.col("between")).alias("b"), "level", "above")).alias("s"), F.first("all_n").cast("long").alias("n"))
    return best.select("image_id", "s.level", F.col("s.above").alias("n_above"), "n")


def minority(image_pixels: DataFrame) -> DataFrame:
    """(image_id, y, x): the pixels above the image's threshold, or the others where these are more than half."""
    levels = otsu_levels(image_pixels).select("image_id", F.col("level").alias("cut"), (F.col("n_above") > F.floor(F.col("n") / 2)).alias("flip"))
    return image_pixels.join(levels.hint("merge"), "image_id").where((F.col("level") > F.col("cut")) != F.col("flip")).select("image_id", "y", "x")


def runs(mask: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1): runs of pixels of a row, both ends inclusive."""
    order = Window.partitionBy("image_id", "y").orderBy("x")
    placed = mask.withColumn("island", F.col("x") - F.row_number().over(order))
    return placed.groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def regions(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(image_id, label, area, x, y, width, height) of the connected regions of mask (image_id, y, x); label: its first row, then column.

    Runs of neighbouring rows that touch are linked; they are compared inside tiles of columns, so a row may have any number of runs.
    """
    reach = 1 if diagonal else 0
    node = F.struct(F.col("y").alias("y"), F.col("x0").alias("x"))
    lines = runs(mask).withColumn("v", node)
    tiled = lines.withColumn("tile", F.explode(F.sequence(F.expr(f"(x0 - {reach}) div {TILE}"), F.expr(f"(x1 + {reach}) div {TILE}"))))
    upper = tiled.select("image_id", (F.col("y") + 1).alias("y"), "tile", F.col("v").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    lower = tiled.select("image_id", "y", "tile", F.col("v").alias("b"), "x0", "x1")
    links = upper.join(lower.hint("merge"), ["image_id", "y", "tile"]).where((F.col("a0") <= F.col("x1") + reach) & (F.col("x0") <= F.col("a1") + reach)).select("image_id", "a", "b")
    labels = connected(lines.select("image_id", "v"), links, "image_id")
    every = lines.join(labels.hint("merge"), ["image_id", "v"]).groupBy("image_id", "label").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height")
    )
    return every


def largest_region(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """The largest region of each image, of equals the first, with n_regions."""
    rows = regions(mask, diagonal)
    best = F.min(F.struct((-F.col("area")).alias("k"), "label", "area", "x", "y", "width", "height")).alias("s")
    out = rows.groupBy("image_id").agg(best, F.count(F.lit(1)).alias("n_regions"))
    return out.select("image_id", "n_regions", "s.area", "s.x", "s.y", "s.width", "s.height")
