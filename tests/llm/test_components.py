"""Components with a node that most edges meet at."""

import random

from pyspark.sql import functions as F

from tarnlight.llm.components import connected_components
from tarnlight.llm.staging import Workspace


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {x: root(x) for x in parent}


def test_components_equal_a_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)] + [(5, 5), (None, 1), (2, None), (1000, 1001)]
    edges += [(5000, i) for i in range(5001, 5600)] + [(4999, 5300)]
    found = connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "a long, b long"))
    rows = found.collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.label for r in rows} == plain(edges)
    assert connected_components(Workspace(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_join_at_a_hub_is_split(spark):
    """The join of edges with the least neighbours, as the components make it, where nine of ten edges meet at one node."""
    space = Workspace(spark, "hub")
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        edges = space.stage(spark.range(200_000).select(F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id")).alias("a"), F.xxhash64("id").alias("b")).repartition(8), "edges")
        least = space.stage(edges.groupBy("a").agg(F.min("b").alias("least")), "least")
        joined = edges.join(least, "a").select("b", "least").distinct()
        assert len(joined.collect()) == 200_000
        assert "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
