"""Recursion to a fixpoint, without a limit on its depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tarnlight.scratch import Scratch

#: Tables of what has been reached, at most; beyond this the small ones become one.
COMPACT = 6
#: A round that adds at most THIN nodes a step is followed by one of twice the steps, up to STEPS: long thin paths would else cost a job for each edge.
THIN = 1000
STEPS = 16


def reachable(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """node, hops: every node that seeds(node) or a path along edges(src, dst) from them reaches, with the least number of edges; seeds have 0.

    Semi-naive rounds: only the nodes that the last round added last are joined with the edges; what is new among them is written as the
    next delta, so lineage and plans stay short however many rounds there are. A round takes one step along the edges, or several while few nodes are added. One that adds nothing ends it: cycles, loops, repeated edges and nulls
    (which reach nothing) do no harm. Edges are dealt to buckets by their source and what has been reached by node, once each, so a round shuffles no more than what it has found.
    What has been reached is kept in a few tables; small ones are put together with those not much larger, so a node is written anew a few times, not every few rounds.
    """
    spark = seeds.sparkSession
    scratch = Scratch(spark, "fixpoint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        graph = scratch.deal(edges.filter("src is not null and dst is not null and src != dst").select("src", "dst").repartition(parts, "src").distinct(), "edges", "src", parts)
        known: list[tuple[str, int]] = []  # names and rows of what has been reached
        dealt: dict[str, DataFrame] = {}

        def staged(frame: DataFrame, name: str) -> int:
            seen = Observation()
            dealt[name] = scratch.deal(frame.observe(seen, F.count(F.lit(1)).alias("n")), name, "node", parts)
            known.append((name, seen.get["n"]))
            return known[-1][1]

        n = staged(seeds.filter("node is not null").select("node", F.lit(0).cast("long").alias("hops")).repartition(parts, "node").distinct(), "delta-0")
        delta, hops, steps = dealt["delta-0"], 0, 1
        while n:
            found = delta
            for step in range(steps):
                found = _step(found, graph, hops, step > 0)
                hops += 1
            for name, _ in known:
                found = found.join(dealt[name].select("node"), "node", "left_anti")
            n_new = staged(found, f"delta-{hops}")
            delta = dealt[f"delta-{hops}"].filter(F.col("hops") == hops)  # all others have been followed within the round
            n = n_new if steps == 1 else delta.count()
            steps = min(2 * steps, STEPS) if n_new <= THIN * steps else 1
            if len(known) > COMPACT:
                small = [known.pop()]
                while known and known[-1][1] <= 2 * sum(size for _, size in small):
                    small.append(known.pop())
                staged(_union([dealt[name] for name, _ in small]), f"known-{hops}")
        schema = dealt[known[0][0]].schema
        return _union([spark.read.schema(schema).parquet(f"{scratch.path}/{name}") for name, _ in known])
    finally:
        scratch.forget()


def _step(found: DataFrame, graph: DataFrame, hops: int, keep: bool) -> DataFrame:
    """The nodes an edge away from those of found(node, hops) at that number of hops, each once with its least number; with keep those of found too."""
    led = found.join(graph, (F.col("node") == F.col("src")) & (F.col("hops") == hops), "left" if keep else "inner")
    new = F.struct(F.col("dst").alias("node"), F.lit(hops + 1).cast("long").alias("hops"))
    both = F.array(F.struct("node", "hops"), new) if keep else F.array(new)
    return led.select(F.explode(both).alias("x")).select("x.*").filter("node is not null").groupBy("node").agg(F.min("hops").alias("hops"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
