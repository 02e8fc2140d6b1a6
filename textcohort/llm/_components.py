"""Connected components of a link table by repeated contraction.

In each round every vertex points to the neighbour that comes first in a random order, if
that comes before itself, and the links are redrawn between the vertices pointed at.  The
random order makes a constant share of vertices vanish each round, also on long chains.
Nothing is gathered per vertex: neighbours meet in a minimum, which is formed before the
shuffle, and links meet the pointers in joins whose hot keys Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links: a, b (long).  Returns id, component (the least id that links reach) for all linked ids."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = scratch.write(links.where("a <> b").select(low.alias("a"), high.alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("f")
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        points = scratch.write(both.groupBy("a").agg(first).select(F.col("a").alias("id"), F.least("f", own)["v"].alias("to")))
        left, right = points.select(F.col("id").alias("a"), F.col("to").alias("x")), points.select(F.col("id").alias("b"), F.col("to").alias("y"))
        redrawn = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        before, edges = edges, scratch.write(redrawn)
        scratch.drop(before)
        if labels is None:
            labels = points
        else:
            step = points.select(F.col("id").alias("to"), F.col("to").alias("next"))
            labels = scratch.write(labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("to").agg(F.min("id").alias("component"))
    least = least.select("to", F.least("to", "component").alias("component"))
    return labels.join(least, "to").select("id", "component")
