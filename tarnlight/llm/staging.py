"""Intermediate tables in the folder that the driver and all executors share.

A staged table cuts the lineage: when an executor is lost, later stages read the
table again instead of recomputing what came before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.session import shared_root

def application_folder(spark: SparkSession) -> str:
    """Where this application stages its tables."""
    return f"{shared_root(spark)}/tarnlight/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reads; one that isn't there is left out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged. Frames that operators have returned can't be read afterwards."""
    delete(spark, application_folder(spark))


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it none of the frame's columns."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


class Workspace:
    """A folder of its own for the staged tables of one operator call."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.path = f"{application_folder(spark)}/{operator}-{uuid.uuid4().hex}"
        self._names: dict[str, int] = {}

    def stage(self, frame: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write the frame once and return a reader of what was written."""
        at = self._names[name] = self._names.get(name, 0) + 1
        path = f"{self.path}/{name}-{at}"
        writer = frame.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete staged tables that no later plan reads."""
        for frame in frames:
            for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
                if self.path.rsplit("/", 1)[1] in folder.split("/"):
                    delete(self.spark, folder)


def text_mark(text: Column) -> Column:
    """A 64-bit hash that tells rows of one doc_id but other texts apart; a null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def named(docs: DataFrame, rows: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, Column, list[str]]:
    """rows(doc_id, text_mark, extra) under names that docs doesn't have, the condition that joins both (null ids are equal) and extra's new names."""
    own, mark, *more = unused(docs, "of_doc", "of_mark", *extra)
    renamed = rows.select(F.col("doc_id").alias(own), F.col("text_mark").alias(mark), *[F.col(c).alias(n) for c, n in zip(extra, more, strict=True)])
    return renamed, docs["doc_id"].eqNullSafe(F.col(own)) & (text_mark(docs["text"]) == F.col(mark)), more


def without(docs: DataFrame, gone: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """docs less the rows whose doc_id (nulls are equal) and text stand in gone(doc_id, text_mark), a staged table.

    Those that go are usually the fewer: they are broadcast if they number at most broadcast_rows, so
    the texts aren't shuffled, and are merged with the texts by key otherwise.
    """
    keys, same, _ = named(docs, gone.distinct())
    return docs.join(broadcast_below(keys, gone.count(), broadcast_rows), same, "left_anti")


def once(rows: DataFrame, kinds: DataFrame, n_kinds: int, limit: int = 500_000) -> DataFrame:
    """rows(doc_id, text) and n: those in kinds(doc_id, text_mark, n), counted as n_kinds, stand once with their n, all others with 1."""
    keys, same, (n,) = named(rows, kinds, ("n",))
    if not n_kinds:
        return rows.withColumn("n", F.lit(1).cast("long"))
    keys = broadcast_below(keys, n_kinds, limit)
    again = rows.join(keys, same).select("doc_id", "text", n, text_mark(F.col("text")).alias("text_mark"))
    again = again.groupBy("doc_id", "text_mark").agg(F.first("text").alias("text"), F.max(n).alias("n"))
    return rows.join(keys, same, "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(again.select("doc_id", "text", "n"))


def repeated(frame: DataFrame, times: str, lot: int = 1_000) -> DataFrame:
    """The rows, each as often as its column `times` says (never, if that is below 1), without that column.

    Rows that are repeated more than `lot` times are dealt to several tasks, lot by lot.
    """
    at, i = unused(frame, "at", "i")
    columns = [c for c in frame.columns if c != times]
    few = frame.filter(F.col(times).between(1, lot)).withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    many = frame.filter(F.col(times) > lot).withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"), F.lit(lot).cast("long"))))
    many = many.repartition(at, *columns).withColumn(i, F.explode(F.sequence(F.col(at), F.least(F.col(at) + lot - 1, F.col(times).cast("long")))))
    return few.select(*columns).unionByName(many.select(*columns))


def broadcast_below(frame: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast the frame if its counted rows are within the limit, else join it by sort and merge."""
    return frame.hint("broadcast") if rows <= limit else frame.hint("merge")
