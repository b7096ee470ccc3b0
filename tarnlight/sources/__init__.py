"""Readers for the tables that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, a file or a folder of part files, read through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
