"""Streams of events: windowed counts with late data, deduplication, joins of two streams, by event time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tarnlight.session import shared_root


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, with ts as a timestamp that a watermark can follow."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Events and, about, users (a sketch of fixed size) of each hour and type. Rows later than the lateness are left out; a window is given out once it is past."""
    hours = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("hour"), "event_type")
    return hours.agg(F.count("*").alias("n_events"), F.approx_count_distinct("user_id").alias("about_n_users")).select(F.col("hour.start").alias("hour"), "event_type", "n_events", "about_n_users")


def deduplicated(events: DataFrame, key: str = "event_id", lateness: str = "10 minutes") -> DataFrame:
    """The first row of each key among those that arrive within the lateness of each other; state stays bounded."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def joined_within(left: DataFrame, right: DataFrame, by: str, within: str, lateness: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of two streams with equal `by` where right_ts lies in the time `within` up to and with left's ts (its start left out).

    left has ts, right has right_ts, and no other name is in both but `by`. Both watermarks and the interval bound the state; with how = "leftOuter" a left row
    without a partner is given out once none can come any more. A null key finds nothing.
    """
    ours = left.withWatermark("ts", lateness)
    theirs = right.withColumnRenamed(by, "right_key").withWatermark("right_ts", lateness)
    near = F.expr(f"{by} = right_key and right_ts <= ts and right_ts > ts - interval {within}")
    return ours.join(theirs, near, how).drop("right_key")


def idle_keys(events: DataFrame, by: str, idle: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """by, n_events, last_ts for each run of a key's events, once the watermark is `idle` past its latest event (state with a timeout by event time).

    A key's state is two numbers. Late rows are left out; a null key is a key of its own.
    """
    gap = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = events.schema[by].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({by: [key[0]], "n_events": [n], "last_ts": [pd.Timestamp(last, unit="us")]})
            return
        n, last = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            last = max(last, int(batch["micros"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last // 1000 + gap, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", lateness).select(by, "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n_events long, last_ts timestamp", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(stream: DataFrame, mode: str = "append", state_store: str | None = None) -> DataFrame:
    """Run over what is there, into Parquet files below the shared folder, and return a reader of them. A state store other than the session's holds for this run alone."""
    spark = stream.sparkSession
    path = f"{shared_root(spark)}/tarnlight/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    try:
        if state_store:
            spark.conf.set(setting, state_store)
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
