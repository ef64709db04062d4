"""Connected components on DataFrames, by alternating star contraction.

Each round points every node's larger neighbours at its smallest neighbour and
then its smaller ones too, so trees flatten in about log(n) rounds.  All steps
are joins and partially aggregated minima: a hub with a third of all edges is
combined before the shuffle and split by adaptive skew joins after it.  Edges
are written to the shared folder in every round; none reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """Per node u the least of u and its neighbours, beside each neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """``edges`` (a, b) of any orderable type -> (node, component), the least node reachable.

    Self-loops and repeats are ignored, nulls too.  Only nodes with an edge to another node are returned.
    """
    now = scratch.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    size = -1, None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        stars = _least(large)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        after = scratch.put(small.where("u <> v").distinct())
        # The same number of edges with the same order-free sum of hashes: nothing changed.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if tuple(state) == size:
            break
        size = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
