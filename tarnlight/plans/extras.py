"""Clustered tables, stored sketches, table functions, recursion and variants."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.sketches import DISTINCT_ERROR, RANK_ERROR, combined, hourly_states
from tarnlight.functions.tables import link_order, page_links
from tarnlight.functions.variants import with_fields
from tarnlight.operators.fixpoint import reachable
from tarnlight.scratch import Scratch
from tarnlight.sources import table
from tarnlight.sources.layout import ClusteredTable


def clustered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped in the spring of 1997 at prices from 20,000 to 30,000, out of a table clustered on both (files are skipped by their statistics)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    clustered = ClusteredTable.write(lines, f"{Scratch(spark, 'clustered').path}/table", ["l_shipdate", "l_extendedprice"], 32)
    return clustered.read({"l_shipdate": (datetime(1997, 3, 1), datetime(1997, 5, 31)), "l_extendedprice": (20_000.0, 30_000.0)})


def sketched_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every run of 1, 3 and 7 days: events by stored hourly states, and whether the states' quartiles and users lie within the stated errors of the exact ones."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    states = Scratch(spark, "sketches").write(hourly_states(events, "ts", "value", "user_id"), "states")
    days = events.select(F.to_date("ts").alias("day")).distinct()
    ranges = days.withColumn("n_days", F.explode(F.array(*map(F.lit, (1, 3, 7))))).select(F.struct("day", "n_days").alias("range_id"), F.col("day").cast("timestamp").alias("low"), F.date_add("day", F.col("n_days")).cast("timestamp").alias("high"))
    shares = [0.25, 0.5, 0.75]
    about = combined(states, ranges, shares)
    # exact places of the estimates: events of each range by the days they are of
    wide = days.withColumn("n_days", F.explode(F.array(*map(F.lit, (1, 3, 7))))).withColumn("back", F.explode(F.sequence(F.lit(0), F.col("n_days") - 1)))
    of_range = events.withColumn("of_day", F.to_date("ts")).join(wide.select(F.struct("day", "n_days").alias("range_id"), F.date_add("day", F.col("back")).alias("of_day")), "of_day")
    judged = of_range.join(about, "range_id").groupBy("range_id", "n_rows", "about_n_keys", "quantiles").agg(
        F.count("*").alias("n"),
        F.countDistinct("user_id").alias("users"),
        *[F.count_if(F.col("value") < F.col("quantiles")[i]).alias(f"below_{i}") for i in range(3)],
        *[F.count_if(F.col("value") <= F.col("quantiles")[i]).alias(f"upto_{i}") for i in range(3)],
    )
    near = [(F.col(f"below_{i}") <= (q + RANK_ERROR) * F.col("n") + 1) & (F.col(f"upto_{i}") >= (q - RANK_ERROR) * F.col("n") - 1) for i, q in enumerate(shares)]
    close = F.abs(F.col("about_n_keys") - F.col("users")) <= DISTINCT_ERROR * F.col("users") + 1
    return judged.select(F.col("range_id.day").alias("first_day"), F.col("range_id.n_days").cast("long").alias("n_days"), F.col("n_rows").alias("n_events"), (near[0] & near[1] & near[2]).alias("quartiles_near"), close.alias("users_near"))


def html_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page in order (a table function through a lateral join)."""
    return page_links(table(spark, sf_dir, "pages")).select("page_id", F.col("place").cast("long").alias("place"), "href")


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that have each link, numbered (a table function over partitions of a table)."""
    return link_order(page_links(table(spark, sf_dir, "pages")))


def after_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that follow an error of their user through steps of at most two days, and in how many steps (recursion to a fixpoint)."""
    events = table(spark, sf_dir, "events")
    steps = spark.sql("select event_id as src, lead(event_id) over w as dst, (lead(ts) over w) - ts as gap from {events} window w as (partition by user_id order by ts, event_id)", events=events)
    seeds = events.filter("event_type = 'error'").select(F.col("event_id").alias("node"))
    return reachable(seeds, steps.filter("gap <= interval 2 days")).select(F.col("node").alias("event_id"), "hops")


def event_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their JSON properties, as a number and as text (variant paths)."""
    fields = with_fields(table(spark, sf_dir, "events"), "props", {"k": ("$.k", "bigint"), "k_text": ("$.k", "string"), "missing": ("$.none[0]", "string")})
    return fields.groupBy("k", "k_text").agg(F.count("*").alias("n_events"), F.count("missing").alias("n_missing"), F.count_if("is_malformed").alias("n_malformed"))


_LINKS = r"""l as (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<a\s[^>]*?href="([^"]*)"', 1)) as href,
        generate_subscripts(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<a\s[^>]*?href="([^"]*)"', 1), 1) - 1 as place from pages)"""

QUERIES = {
    "clustered_lines": (
        clustered_lines,
        """select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice from lineitem
        where l_shipdate between timestamp '1997-03-01' and timestamp '1997-05-31' and l_extendedprice between 20000 and 30000""",
    ),
    "sketched_ranges": (
        sketched_ranges,
        """with d as (select distinct cast(ts as date) as first_day from events), r as (select first_day, cast(n as bigint) as n_days from d, (values (1), (3), (7)) v(n))
        select first_day, n_days, count(*) as n_events, true as quartiles_near, true as users_near from r join events on cast(ts as date) >= first_day and cast(ts as date) < first_day + cast(n_days as int) group by 1, 2""",
    ),
    "html_page_links": (html_page_links, f"with {_LINKS} select page_id, place, href from l"),
    "link_pages": (link_pages, f"with {_LINKS} select href, page_id, row_number() over (partition by href order by page_id) - 1 as n_before from (select distinct href, page_id from l)"),
    "after_errors": (
        after_errors,
        """with recursive s as (select event_id, event_type, ts, lead(event_id) over w as after, lead(ts) over w as after_ts from events window w as (partition by user_id order by ts, event_id)),
        r(event_id, hops) as (select event_id, cast(0 as bigint) from s where event_type = 'error'
        union all select s.after, r.hops + 1 from r join s on s.event_id = r.event_id where s.after_ts - s.ts <= interval 2 day)
        select event_id, min(hops) as hops from r group by 1""",
    ),
    "event_variants": (
        event_variants,
        """select cast(props->>'$.k' as bigint) as k, props->>'$.k' as k_text, count(*) as n_events, cast(0 as bigint) as n_missing, cast(0 as bigint) as n_malformed from events group by 1, 2""",
    ),
}
