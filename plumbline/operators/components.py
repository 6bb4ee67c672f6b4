"""Connected components inside many graphs at once, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut


def connected(nodes: DataFrame, edges: DataFrame, graph: str, most_rounds: int = 100) -> DataFrame:
    """(graph, v, label): the least node of each node's component; nodes (graph, v), edges (graph, a, b) inside a graph.

    Every round takes, for each node, the least grandparent among its neighbours, offers it to the node and to its parent, and lets
    every node skip to its grandparent; the number of rounds grows with the logarithm of a component's diameter.  All of it is joins by
    key and minima that are combined before the shuffle; each round is written to the shared folder.  The joins are by sorted keys: estimates from
    before nodes and edges were made of fewer rows would have them broadcast through the driver.
    """
    both = cut(edges.select(graph, "a", "b").unionByName(edges.select(graph, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(nodes.select(graph, "v", F.col("v").alias("p")))
    for _ in range(most_rounds):
        up = state.select(graph, F.col("v").alias("p"), F.col("p").alias("above"))
        placed = state.join(up.hint("merge"), [graph, "p"]).select(graph, "v", "p", "above")
        beside = both.join(placed.select(graph, F.col("v").alias("b"), "above").hint("merge"), [graph, "b"]).groupBy(graph, F.col("a").alias("v")).agg(F.min("above").alias("least"))
        met = placed.join(beside.hint("merge"), [graph, "v"], "left").withColumn("least", F.least("least", "above"))
        offers = met.select(graph, F.explode(F.array(F.struct("v", F.least("p", "least").alias("p"), F.col("p").alias("was")), F.struct(F.col("p").alias("v"), F.col("least").alias("p"), F.lit(None).cast(dict(nodes.dtypes)["v"]).alias("was")))).alias("o"))
        state = cut(offers.groupBy(graph, "o.v").agg(F.min("o.p").alias("p"), F.max("o.was").alias("was")))
        moved = not state.where("p <> was").isEmpty()
        state = state.select(graph, "v", "p")
        if not moved:
            return state.withColumnRenamed("p", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
