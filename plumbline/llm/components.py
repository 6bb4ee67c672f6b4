"""Connected components of a graph given as edges, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for every id in the edges (a, b): root is the least id of its component.

    Alternates large-star and small-star: each vertex links its larger neighbours, then its smaller ones,
    to the least vertex near it.  The edges never become more than they were, hubs are combined before the
    shuffle by taking minima, and the number of rounds grows with the logarithm of the
    component's size.  Each round's edges are written to the shared checkpoint folder.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["v"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = large.join(down, large["a"] == down["v"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = cut(small.union(down.select(F.col("v").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
