"""Aggregations: grouped, conditional, distinct, grouping sets, pivots and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.functions import money
from tarnlight.scratch import Scratch
from tarnlight.sources import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means and counts of the lines shipped by September 1998, by return flag and status."""
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.col("l_quantity")).alias("sum_qty"),
        money(F.col("l_extendedprice")).alias("sum_base_price"),
        money(F.expr("l_extendedprice * (1 - l_discount)")).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("dev_qty"),
        F.count("*").alias("n_lines"),
    )


def orders_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by calendar month."""
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"))


def status_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and urgent orders by customer segment (filtered aggregates)."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return orders.groupBy("c_mktsegment").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), F.count("*").alias("n_orders")
    )


def flag_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by return flag and status with all subtotals (cube)."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("bigint").alias("all_flags"), F.grouping("l_linestatus").cast("bigint").alias("all_statuses"), money(F.col("l_quantity")).alias("quantity")
    )


def part_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and type with subtotals by brand (rollup)."""
    return table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n_parts"), F.max("p_size").alias("largest"))


def segment_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment, by nation and overall (grouping sets)."""
    customers = table(spark, sf_dir, "customer")
    return customers.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n_customers"), money(F.col("c_acctbal")).alias("balance"))


def events_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by type, a column each (pivot over fixed types)."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    counts = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1)))
    return counts.select("user_id", *[F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in kinds])


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of order totals by priority: one map of distinct totals for each group and task, merged after the shuffle."""
    found = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", [0.25, 0.5, 0.75]).alias("at"))
    return found.select("o_orderpriority", *[F.round(F.col("at")[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def price_quartiles_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quartiles without a group's values in one place (quantiles of data that outgrows memory).

    Totals are counted by value and put in order by range over all tasks; a value's place is what its range has before it and what the ranges
    before have, by group. Only the values at the places wanted, at most six for each group, are brought together.
    """
    values = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_totalprice").agg(F.count("*").alias("n"))
    ordered = values.repartitionByRange("o_orderpriority", "o_totalprice").withColumn("part", F.spark_partition_id())
    ordered = Scratch(spark, "quartiles").write(ordered, "ordered")  # both reads below then see one set of ranges
    ranges = ordered.groupBy("o_orderpriority", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("o_orderpriority").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("o_orderpriority")
    ranges = ranges.select("o_orderpriority", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(group).alias("total"))
    own = Window.partitionBy("o_orderpriority", "part").orderBy("o_totalprice")
    placed = ordered.withColumn("upto", F.sum("n").over(own)).join(ranges, ["o_orderpriority", "part"]).withColumn("last", F.col("before") + F.col("upto") - 1)
    first = F.col("last") - F.col("n") + 1
    found = []
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (F.col("total") - 1) * share
        low, high = F.floor(at), F.ceil(at)
        below, above = (F.max(F.when((first <= x) & (x <= F.col("last")), F.col("o_totalprice"))) for x in (low, high))
        part = F.max(at - low)
        found.append(F.round(below + (above - below) * part, 4).alias(name))
    return placed.groupBy("o_orderpriority").agg(*found)


def cheapest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest price of each supplier and a part that has it (extreme with its row)."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_suppkey").agg(F.min(F.struct("l_extendedprice", "l_partkey")).alias("least")).select("l_suppkey", "least.l_extendedprice", "least.l_partkey")


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by hour (tumbling window)."""
    hour = F.window(F.col("ts").cast("timestamp"), "1 hour")
    counts = table(spark, sf_dir, "events").groupBy(hour.alias("hour")).agg(F.count("*").alias("n_events"), money(F.col("value")).alias("total"))
    return counts.select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), "n_events", "total")


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their JSON properties."""
    key = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy(key.alias("k")).agg(F.count("*").alias("n_events"))


_MONEY = "cast(round(sum(cast({} as decimal(24, 6))), 2) as double)".format

QUERIES = {
    "pricing_summary": (
        pricing_summary,
        f"""select l_returnflag, l_linestatus, {_MONEY("l_quantity")} as sum_qty, {_MONEY("l_extendedprice")} as sum_base_price,
        {_MONEY("l_extendedprice * (1 - l_discount)")} as sum_disc_price, round(avg(l_discount), 6) as avg_disc, round(stddev_samp(l_quantity), 6) as dev_qty, count(*) as n_lines
        from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""",
    ),
    "orders_by_month": (orders_by_month, "select date_trunc('month', o_orderdate) as month, count(*) as n_orders, count(distinct o_custkey) as n_customers from orders group by 1"),
    "status_share": (
        status_share,
        """select c_mktsegment, count(*) filter (where o_orderstatus = 'F') as n_finished, count(*) filter (where o_orderpriority = '1-URGENT') as n_urgent, count(*) as n_orders
        from orders join customer on o_custkey = c_custkey group by 1""",
    ),
    "flag_cube": (
        flag_cube,
        f"""select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as bigint) as all_flags, cast(grouping(l_linestatus) as bigint) as all_statuses, {_MONEY("l_quantity")} as quantity
        from lineitem group by cube (l_returnflag, l_linestatus)""",
    ),
    "part_rollup": (
        part_rollup,
        "select p_brand, p_type, cast(grouping(p_brand, p_type) as bigint) as level, count(*) as n_parts, max(p_size) as largest from part group by rollup (p_brand, p_type)",
    ),
    "segment_sets": (
        segment_sets,
        f"select c_mktsegment, c_nationkey, count(*) as n_customers, {_MONEY('c_acctbal')} as balance from customer group by grouping sets ((c_mktsegment), (c_nationkey), ())",
    ),
    "events_pivot": (
        events_pivot,
        "select user_id, " + ", ".join(f"count(*) filter (where event_type = '{k}') as n_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
    ),
    "price_quantiles": (
        price_quantiles,
        "select o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) as {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " from orders group by 1",
    ),
    "price_quartiles_by_rank": (
        price_quartiles_by_rank,
        "select o_orderpriority, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) as {n}" for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " from orders group by 1",
    ),
    "cheapest_line": (
        cheapest_line,
        """select l_suppkey, l_extendedprice, l_partkey from (select *, row_number() over (partition by l_suppkey order by l_extendedprice, l_partkey) as place from lineitem) where place = 1""",
    ),
    "event_hours": (event_hours, f"select time_bucket(interval 1 hour, ts) as hour, count(*) as n_events, {_MONEY('value')} as total from events group by 1"),
    "event_json": (event_json, "select cast(props->>'$.k' as bigint) as k, count(*) as n_events from events group by 1"),
}
