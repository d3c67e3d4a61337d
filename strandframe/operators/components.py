"""Connected components in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.scratch import Scratch


def component_of(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component for the nodes of edges (a, b) that aren't loops: the smallest node that is reachable.

    A node points to a smaller one of its component. A round lets every node
    and what it points to take the least pointer among their neighbours, and
    then skips one pointer, so chains are halved and rounds grow with the
    logarithm of the longest one. Minima are pre-aggregated, so a hub is no
    large group.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = scratch.save(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    points = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "points")
    while True:
        near = both.join(points.select(F.col("node").alias("b"), "to"), "b").groupBy(F.col("a").alias("node")).agg(F.min("to").alias("near"))
        own = points.join(near, "node").select("node", "to", F.least("to", "near").alias("least"))
        # what a node learns is told to the node it points to as well
        told = own.select("node", F.col("least").alias("to")).unionByName(own.select(F.col("to").alias("node"), F.col("least").alias("to")))
        hooked = scratch.save(told.groupBy("node").agg(F.min("to").alias("to")), "hooked")
        after = scratch.save(hooked.join(hooked.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")), "points")
        moved = not after.join(points.withColumnRenamed("to", "was"), "node").where("to <> was").isEmpty()
        for old in (points, hooked):
            scratch.free(old)
        points = after
        if not moved:
            scratch.free(both)
            return points.select("node", F.col("to").alias("component"))
