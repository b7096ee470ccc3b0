"""Searches by index, overlaps of intervals, and patterns over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators import sessions
from tarnlight.operators.intervals import overlap_join, overlap_totals
from tarnlight.operators.patterns import match_rows
from tarnlight.operators.ranking import TextIndex
from tarnlight.operators.vectors import VectorIndex
from tarnlight.plans.texts import QUERIES as TEXTS
from tarnlight.scratch import Scratch
from tarnlight.sources import table


def _neighbours(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(rows, f"{Scratch(spark, 'nearest').path}/index")
    queries = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search(queries, exact=exact).select("query_id", "vec_id", "product")


def nearest_vectors_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50, the other one with the largest dot product: by the inverted file, with every cell that may hold a better one."""
    return _neighbours(spark, sf_dir, True)


def nearest_vectors_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from half of the cells alone: some of the nearest are missed (recall is tested, at least 0.9)."""
    return _neighbours(spark, sf_dir, False)


def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of one customer of which the second was placed before the last line of the first was shipped, or the other way round."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    spans = table(spark, sf_dir, "orders").join(lines, F.expr("o_orderkey = l_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "shipped")
    others = spans.select("o_custkey", F.col("o_orderkey").alias("other_orderkey"), F.col("o_orderdate").alias("other_date"), F.col("shipped").alias("other_shipped"))
    pairs = overlap_join(spans, others, ("o_orderdate", "shipped"), ("other_date", "other_shipped"), ["o_custkey"]).filter("o_orderkey < other_orderkey")
    return pairs.select("o_custkey", "o_orderkey", "other_orderkey", F.least("shipped", "other_shipped").alias("until"))


def concurrent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user's time between two errors, of minutes or weeks, the sessions of other users in it and their events (intervals of all lengths without a key; no pair is made)."""
    events = table(spark, sf_dir, "events")
    found = sessions(events, "user_id", "ts", "2 hours").select(F.col("user_id").alias("session_user"), "started", (F.col("ended") + F.expr("interval 1 minute")).alias("left"), F.col("n_events").alias("session_events"))
    errors = spark.sql("select event_id, user_id, ts as failed, lead(ts) over (partition by user_id order by ts, event_id) as failed_again from {events} where event_type = 'error'", events=events)
    errors = errors.filter("user_id is not null")  # a null user is not known to be another
    scratch = Scratch(spark, "concurrent")
    found, errors = scratch.write(found, "sessions"), scratch.write(errors, "errors")
    spans = ("failed", "failed_again"), ("started", "left")
    everyone = overlap_totals(errors, found, *spans, ["event_id"], ["session_events"])
    # the user's own sessions are taken off; a key's slot is long, as one user has few rows in an hour
    own = overlap_totals(errors, found.withColumnRenamed("session_user", "user_id"), *spans, ["event_id"], ["session_events"], ["user_id"], 7 * 86_400_000_000)
    both = everyone.unionByName(own.select("event_id", (-F.col("n")).alias("n"), (-F.col("session_events")).alias("session_events")))
    return both.groupBy("event_id").agg(F.sum("n").alias("n_sessions"), F.sum("session_events").alias("n_events")).filter("n_sessions > 0")


def passage_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark passage (BM25 by an inverted index)."""
    index = TextIndex.build(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'ranking').path}/index")
    return index.search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))).withColumnRenamed("query_id", "item_id")


def _kinds() -> dict:
    return {"v": F.col("event_type") == "view", "c": F.col("event_type") == "click", "p": F.col("event_type") == "purchase"}


def purchase_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, then clicks, then a purchase of one user within two hours, with no other event between (a row pattern)."""
    return match_rows(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", _kinds(), "v+c+p", 2 * 3600)


def browsing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks that end in a purchase or in nothing else, three rows or more, within two days (a pattern with alternatives)."""
    return match_rows(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", _kinds(), "(v|c){2,}(p|[^vc])", 48 * 3600)


def _pattern_sql(pattern: str, hours: int) -> str:
    return f"""with e as (select *, case event_type when 'view' then 'v' when 'click' then 'c' when 'purchase' then 'p' else '_' end as letter,
        row_number() over (partition by user_id order by ts, event_id) as i,
        count(*) over (partition by user_id order by ts range between unbounded preceding and interval {hours} hour following) as upto from events),
        s as (select user_id, string_agg(letter, '' order by i) as letters from e group by 1),
        m as (select e.user_id, e.event_id, e.ts, e.i, len(regexp_extract(substr(letters, cast(i as int), cast(upto - i + 1 as int)), '^({pattern})')) as n_rows from e join s using (user_id))
        select m.user_id, m.event_id as first_id, l.event_id as last_id, m.ts as started, l.ts as ended, n_rows from m join e l on l.user_id = m.user_id and l.i = m.i + n_rows - 1 where n_rows > 0"""


QUERIES = {
    "nearest_vectors_indexed": (nearest_vectors_indexed, TEXTS["nearest_vectors"][1]),
    "nearest_vectors_probed": (nearest_vectors_probed, None),
    "overlapping_orders": (
        overlapping_orders,
        """with s as (select o_custkey, o_orderkey, o_orderdate, max(l_shipdate) as shipped from orders join lineitem on l_orderkey = o_orderkey group by all)
        select a.o_custkey, a.o_orderkey, b.o_orderkey as other_orderkey, least(a.shipped, b.shipped) as until from s a join s b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey
        and a.o_orderdate < b.shipped and b.o_orderdate < a.shipped and a.o_orderdate < a.shipped and b.o_orderdate < b.shipped""",
    ),
    "concurrent_sessions": (
        concurrent_sessions,
        """with g as (select user_id, ts, case when ts <= lag(ts) over w + interval 2 hour then 0 else 1 end as starts from events window w as (partition by user_id order by ts)),
        n as (select user_id, ts, sum(starts) over (partition by user_id order by ts) as session_no from g),
        s as (select user_id, min(ts) as started, max(ts) + interval 1 minute as ended, count(*) as n_events from n group by user_id, session_no),
        f as (select event_id, user_id, ts as failed, lead(ts) over (partition by user_id order by ts, event_id) as failed_again from events where event_type = 'error')
        select event_id, count(*) as n_sessions, cast(sum(n_events) as bigint) as n_events from f join s on f.user_id != s.user_id and failed < failed_again and failed < ended and started < failed_again group by 1""",
    ),
    "passage_ranking": (
        passage_ranking,
        r"""with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) as term from documents),
        p as (select doc_id, term, count(*) as tf from t group by all), l as (select doc_id, sum(tf) as length from p group by 1), d as (select term, count(*) as df from p group by 1),
        n as (select (select count(distinct doc_id) from documents) as n_docs, (select sum(tf) from p) as total),
        q as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from benchmark),
        s as (select item_id, doc_id, cast(sum(cast(round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total / n_docs))), 9) as decimal(18, 9))) as double) as score
        from q join p using (term) join l using (doc_id) join d using (term), n group by all)
        select item_id, place, doc_id, round(score, 6) as score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from s) where place <= 10""",
    ),
    "purchase_paths": (purchase_paths, _pattern_sql("v+c+p", 2)),
    "browsing_days": (browsing_days, _pattern_sql("(v|c){2,}(p|[^vc])", 48)),
}
