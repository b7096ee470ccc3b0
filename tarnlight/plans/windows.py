"""Window functions: ranking, frames by rows and by time, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.operators import sessions, top_per_group
from tarnlight.sources import table


def top_customers_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three customers of each nation with the highest balance, by key on ties."""
    top = top_per_group(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    return top.select("c_nationkey", "c_custkey", "c_acctbal", F.col("place").cast("bigint").alias("place"))


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the mean total of the customer's last three orders (row frame)."""
    last = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.avg("o_totalprice").over(last), 4).alias("mean_total"))


def trailing_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the number of its user's events in the hour up to it (time-range frame)."""
    return spark.sql(
        "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n_recent from {events}", events=table(spark, sf_dir, "events")
    )


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, dense rank and quarter of each customer's orders by total."""
    by_total = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ranked = {"place": F.rank(), "dense_place": F.dense_rank(), "quarter": F.ntile(4)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[f.over(by_total).cast("bigint").alias(n) for n, f in ranked.items()])


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from each order to the customer's order before it, null for the first (lag)."""
    in_time = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = F.lag("o_orderdate").over(in_time)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), before.cast("date")).cast("bigint").alias("days"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events at most two hours apart."""
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 hours")
    return found.select("user_id", "started", "n_events")


QUERIES = {
    "top_customers_of_nation": (
        top_customers_of_nation,
        """select c_nationkey, c_custkey, c_acctbal, place from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as place from customer) where place <= 3""",
    ),
    "moving_average": (
        moving_average,
        "select o_orderkey, o_custkey, round(avg(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), 4) as mean_total from orders",
    ),
    "trailing_hour": (trailing_hour, "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n_recent from events"),
    "order_ranks": (
        order_ranks,
        """select o_orderkey, rank() over w as place, dense_rank() over w as dense_place, ntile(4) over w as quarter from orders
        window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)""",
    ),
    "order_gaps": (
        order_gaps,
        "select o_orderkey, date_diff('day', cast(lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date), cast(o_orderdate as date)) as days from orders",
    ),
    "user_sessions": (
        user_sessions,
        """with g as (select user_id, ts, case when ts <= lag(ts) over w + interval 2 hour then 0 else 1 end as starts from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(starts) over (partition by user_id order by ts) as session_no from g)
        select user_id, min(ts) as started, count(*) as n_events from s group by user_id, session_no""",
    ),
}
