"""Operator 5 [native]: exact dedup with a heavy-hitter split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.staging import Workspace, broadcast_below

TRACKED = 4096
FAN = 64
BROADCAST_ROWS = 100_000


def heavy_candidates(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """64-bit hashes (column mark) that may be frequent, by mergeable Misra-Gries summaries.

    Spark's approx_top_k sketches are Misra-Gries counters of at most a fixed number of items: every
    item with over 7 / (2 ^ ceil(log2(tracked / 0.75))) of the rows is among those returned. Summaries
    are made for each partition, combined in FAN groups, then in one, so no task reads all of them.
    """
    marks = digests.select(F.xxhash64("digest").alias("mark"), F.spark_partition_id().alias("part"))
    parts = marks.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(mark, {tracked})").alias("summary"))
    some = parts.groupBy((F.col("part") % FAN).alias("part")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    # by a key of one value: an aggregate without a key would also serialise the empty summaries of tasks without rows
    whole = some.groupBy((F.col("part") % 1).alias("part")).agg(F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
    top = whole.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {tracked})")).alias("top"))
    return top.select(F.col("top.item").alias("mark")).filter("mark is not null")


def exact_dedup(docs: DataFrame, normalise=None, tracked: int = TRACKED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256 after normalise (a function of a column; default none) is
    equal; a null counts as empty. Of equal texts the largest doc_id stays. Nulls sort below all
    ids: a group has a null keep_id, and keeps its rows, only if all its ids are null. Rows that repeat
    both doc_id and text are one document: all of them count in group_size and share the verdict.
    Other columns are ignored; an empty table gives no rows.

    Misra-Gries summaries find candidates for frequent digests, whose exact counts are then taken.
    Those winners, at most `tracked`, are broadcast and settle their rows on the map side without a shuffle;
    all other digests, none of them frequent, are shuffled as usual, counted on the map side first. Only the
    groups of several rows are joined back, by broadcast if they number at most broadcast_rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "exact-dedup")
    body = F.coalesce("text", F.lit(""))
    digests = space.stage(docs.select("doc_id", F.unhex(F.sha2(normalise(body) if normalise else body, 256)).alias("digest")), "digests")
    candidates = F.broadcast(space.stage(heavy_candidates(digests, tracked), "candidates"))
    winners = digests.join(candidates, F.xxhash64("digest") == F.col("mark"), "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = F.broadcast(space.stage(winners.filter("group_size > 1"), "winners"))
    heavy = digests.join(winners, "digest").select("doc_id", "digest", "keep_id", "group_size")
    rest = digests.join(winners.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = space.stage(groups, "groups")  # so the join reads plain shuffles, which can be split where they are skewed
    alone = F.col("group_size").isNull()
    light = rest.join(broadcast_below(groups, groups.count(), broadcast_rows), "digest", "left").select(
        "doc_id", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    )
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return exact_dedup(docs.select("doc_id", "text"))


SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256 from d join g using (text_sha256)
"""
