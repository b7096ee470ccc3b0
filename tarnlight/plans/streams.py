"""Streaming queries, run over all events that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.scratch import Scratch
from tarnlight.sources import table
from tarnlight.streaming import deduplicated, event_stream, hourly_counts, joined_within, run_to_files
from tarnlight.streaming.timers import STATE_STORE, visits
from tarnlight.streaming.upserts import UpsertTable


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    return event_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)


def stream_event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type in append mode: the hours that the watermark, ten minutes behind the latest event, has passed."""
    counts = run_to_files(hourly_counts(_events(spark, sf_dir)))
    return counts.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n_events")


def stream_view_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the views of their user in the hour before (join of two streams)."""
    bought = _events(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = _events(spark, sf_dir).filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("right_ts"))
    return run_to_files(joined_within(bought, viewed, "user_id", "1 hour").select("event_id", "view_id"))


def stream_user_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' visits that the watermark has closed, with their number and the purchases so far (list and map state, event-time timers)."""
    found = run_to_files(visits(_events(spark, sf_dir), "user_id", "event_type = 'purchase'"), state_store=STATE_STORE)
    return found.select("user_id", "visit", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n_events", "n_goals", "goals_so_far")


def stream_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, by upserts of a stream's batches into a table."""
    folder = Scratch(spark, "latest-events").path
    latest = UpsertTable(spark, f"{folder}/table", ["user_id"], ["ts", "event_id"], buckets=8)
    latest.follow(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value"), f"{folder}/state")
    return latest.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each, however often they arrive within the lateness (deduplication by key)."""
    return run_to_files(deduplicated(_events(spark, sf_dir)).select("event_id", "user_id", "event_type"))


QUERIES = {
    "stream_user_visits": (
        stream_user_visits,
        """with g as (select *, case when ts <= lag(ts) over w + interval 2 hour then 0 else 1 end as starts from events window w as (partition by user_id order by ts)),
        n as (select *, sum(starts) over (partition by user_id order by ts) as visit from g),
        s as (select user_id, cast(visit as bigint) as visit, min(ts) as started, max(ts) as ended, count(*) as n_events, count(*) filter (where event_type = 'purchase') as n_goals from n group by 1, 2)
        select *, cast(sum(n_goals) over (partition by user_id order by visit) as bigint) as goals_so_far from s where ended + interval 2 hour <= (select max(ts) - interval 10 minute from events)""",
    ),
    "stream_latest_events": (
        stream_latest_events,
        "select user_id, ts, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place = 1",
    ),
    "stream_first_events": (stream_first_events, "select distinct event_id, user_id, event_type from events"),
    "stream_event_hours": (
        stream_event_hours,
        """select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n_events from events group by 1, 2
        having time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) - interval 10 minute from events)""",
    ),
    "stream_view_purchases": (
        stream_view_purchases,
        """select p.event_id, v.event_id as view_id from events p join events v on p.user_id = v.user_id and v.ts <= p.ts and v.ts > p.ts - interval 1 hour
        where p.event_type = 'purchase' and v.event_type = 'view'""",
    ),
}
