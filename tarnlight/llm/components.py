"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.staging import Workspace


def connected_components(space: Workspace, edges: DataFrame) -> DataFrame:
    """node, label for every node of edges(a, b): label is the smallest node of its component.

    Alternating large-star and small-star steps: each node hands its neighbours its smallest neighbour,
    first those above it, then those below, until every component is a star. Loops and repeated edges
    are allowed; edges with a null are ignored; no edges give no rows. The number of steps grows as
    the logarithm of the size of the largest component; every step is staged.
    """
    current = space.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # sums by node are staged: the joins then read plain shuffles on both sides, which can be split at a node with very many edges
        least = space.stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
        large = space.stage(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b").distinct(), "large")
        lower = space.stage(large.groupBy("a").agg(F.min("b").alias("least")), "lower")
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b")
        reached = space.stage(small.unionByName(lower.select("a", F.col("least").alias("b"))).distinct(), "edges")
        space.drop(least, large, lower)
        now = _state(reached)
        if now == before:
            break
        space.drop(current)
        current, before = reached, now
    return reached.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(reached.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The number of edges and two checksums that no order changes."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
