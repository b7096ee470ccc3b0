"""Intermediate tables and indexes in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnlight.session import shared_root


class Scratch:
    """A folder of one call. What is written there cuts the lineage: a lost executor costs only its own tasks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.tables: list[str] = []
        self.path = f"{shared_root(spark)}/tarnlight/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        """Write the frame once as Parquet and return a reader of what was written."""
        path = f"{self.path}/{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def deal(self, frame: DataFrame, name: str, by: str, parts: int, folder: str = "", order: list[str] = ()) -> DataFrame:
        """Write the frame once as a table in so many buckets of `by`: joins and groups by it read what is returned without a shuffle. The files are as of write()."""
        table = f"tarnlight_{uuid.uuid4().hex}"
        self.tables.append(table)
        writer = frame.write.format("parquet").bucketBy(parts, by)
        writer = writer.sortBy(*order) if order else writer
        writer.mode("overwrite").option("path", f"{folder or self.path}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def dealt(self, path: str, columns: str, by: str, parts: int) -> DataFrame:
        """What deal() wrote under a path, in the same buckets; its columns are named as there may be no rows."""
        table = f"tarnlight_{uuid.uuid4().hex}"
        self.tables.append(table)
        self.spark.sql(f"create table {table} ({columns}) using parquet clustered by ({by}) into {parts} buckets location '{path}'")
        return self.spark.table(table)

    def forget(self) -> None:
        """Take the dealt tables' names out of the catalog; their files stay."""
        while self.tables:
            self.spark.sql(f"drop table if exists {self.tables.pop()}")
