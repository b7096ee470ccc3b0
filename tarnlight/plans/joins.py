"""Joins: star, semi, anti, as-of, range and correlated subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions import money
from tarnlight.operators import asof_join, interval_join, not_in
from tarnlight.sources import table


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and line count by nation of region ASIA for orders of 1996."""
    orders = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'1996-01-01' and o_orderdate < timestamp_ntz'1997-01-01'")
    asian = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").filter("r_name = 'ASIA'"), F.expr("n_regionkey = r_regionkey"), "left_semi")
    buyers = table(spark, sf_dir, "customer").join(asian, F.expr("c_nationkey = n_nationkey")).select("c_custkey", "n_name")
    wanted = orders.join(buyers, F.expr("o_custkey = c_custkey")).select("o_orderkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").join(wanted, F.expr("l_orderkey = o_orderkey"))
    return lines.groupBy("n_name").agg(money(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"), F.count("*").alias("n_lines"))


def large_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order above 490,000 (correlated EXISTS, planned as a semi join)."""
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 490000")
    customers = table(spark, sf_dir, "customer")
    return customers.join(orders, F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey", "c_name")


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order above 400,000, by market segment (anti join)."""
    customers = table(spark, sf_dir, "customer")
    idle = customers.join(table(spark, sf_dir, "orders").filter("o_totalprice > 400000"), F.expr("c_custkey = o_custkey"), "left_anti")
    return idle.groupBy("c_mktsegment").agg(F.count("*").alias("n_customers"))


def top_order_of_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders at the customer's highest price (correlated scalar subquery)."""
    orders = table(spark, sf_dir, "orders")
    highest = orders.groupBy(F.col("o_custkey").alias("of_customer")).agg(F.max("o_totalprice").alias("highest"))
    return orders.join(highest, F.expr("o_custkey = of_customer and o_totalprice = highest")).select("o_custkey", "o_orderkey", "o_totalprice")


def parts_not_sold_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of parts that supplier 1 never shipped (NOT IN; a null part key would leave none)."""
    shipped = table(spark, sf_dir, "lineitem").filter("l_suppkey = 1").select("l_partkey")
    return not_in(table(spark, sf_dir, "part"), shipped, "p_partkey", "l_partkey").agg(F.count("*").alias("n_parts"))


def purchase_after_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, the user's latest click at or before it (as-of join)."""
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, clicks, "ts", ["user_id"], ["click_id", "click_ts"])


def views_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of each purchase's user in the 12 hours before it (interval join)."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"))
    near = interval_join(bought, viewed, "ts", "view_ts", ["user_id"], 12 * 3600)
    return near.groupBy("event_id").agg(F.count("*").alias("n_views"))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order, with the lower key on ties (lateral top 1), customers without orders included."""
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(last, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", "o_orderkey")


def full_outer_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with events in the first and in the last week, each side possibly missing (full outer join)."""
    events = table(spark, sf_dir, "events")
    early = events.filter("ts < timestamp_ntz'2024-01-08'").groupBy("user_id").agg(F.count("*").alias("n_early"))
    late = events.filter("ts >= timestamp_ntz'2024-01-24'").groupBy("user_id").agg(F.count("*").alias("n_late"))
    return early.join(late, "user_id", "full").select("user_id", F.coalesce("n_early", F.lit(0)).alias("n_early"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


QUERIES = {
    "nation_revenue": (
        nation_revenue,
        """select n_name, cast(round(sum(cast(l_extendedprice * (1 - l_discount) as decimal(24, 6))), 2) as double) as revenue, count(*) as n_lines
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' group by n_name""",
    ),
    "large_buyers": (large_buyers, "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 490000)"),
    "idle_customers": (idle_customers, "select c_mktsegment, count(*) as n_customers from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) group by 1"),
    "top_order_of_customer": (
        top_order_of_customer,
        "select o_custkey, o_orderkey, o_totalprice from orders o where o_totalprice = (select max(o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    ),
    "parts_not_sold_by": (parts_not_sold_by, "select count(*) as n_parts from part where p_partkey not in (select l_partkey from lineitem where l_suppkey = 1)"),
    "purchase_after_click": (
        purchase_after_click,
        """with e as (select event_id, user_id, ts from events where event_type = 'purchase'), c as (select event_id as click_id, user_id, ts as click_ts from events where event_type = 'click')
        select event_id, e.user_id, ts, click_id, click_ts from e asof left join c on e.user_id = c.user_id and e.ts >= c.click_ts""",
    ),
    "views_before_purchase": (
        views_before_purchase,
        """select p.event_id, count(*) as n_views from events p join events v on p.user_id = v.user_id and v.event_type = 'view' and v.ts <= p.ts and v.ts > p.ts - interval 12 hour
        where p.event_type = 'purchase' group by 1""",
    ),
    "latest_order": (
        latest_order,
        """select c_custkey, o_orderkey from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 1) on true""",
    ),
    "full_outer_activity": (
        full_outer_activity,
        """with a as (select user_id, count(*) as n_early from events where ts < timestamp '2024-01-08' group by 1), b as (select user_id, count(*) as n_late from events where ts >= timestamp '2024-01-24' group by 1)
        select user_id, coalesce(n_early, 0) as n_early, coalesce(n_late, 0) as n_late from a full join b using (user_id)""",
    ),
}
