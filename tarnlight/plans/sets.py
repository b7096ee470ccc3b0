"""Set operations, recursion and ordered limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.sources import table


def nation_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' key multiset of customers less that of suppliers (except all)."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return buyers.exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")))


def nation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' and suppliers' nations have in common, with repeats (intersect all)."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return buyers.intersectAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")))


def nations_with_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that have customers or suppliers, once each (union, distinct)."""
    buyers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    return buyers.union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))).distinct()


def calendar_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every year from the first to the last, years without orders included, however many they are."""
    counts = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("order_year")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("order_year").alias("low"), F.max("order_year").alias("high")).filter("low is not null")
    years = ends.select(F.explode(F.sequence("low", "high")).alias("order_year"))
    return years.join(counts, "order_year", "left").select("order_year", F.coalesce("n", F.lit(0)).alias("n_orders"))


def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest orders, by key on ties (top-k report: each task keeps ten rows)."""
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


QUERIES = {
    "nation_difference": (nation_difference, "select c_nationkey as nationkey from customer except all select s_nationkey from supplier"),
    "nation_overlap": (nation_overlap, "select c_nationkey as nationkey from customer intersect all select s_nationkey from supplier"),
    "nations_with_both": (nations_with_both, "select c_nationkey as nationkey from customer union select s_nationkey from supplier"),
    "calendar_years": (
        calendar_years,
        """with recursive ends as (select min(cast(year(o_orderdate) as bigint)) as low, max(cast(year(o_orderdate) as bigint)) as high from orders),
        years(y, high) as (select low, high from ends union all select y + 1, high from years where y < high)
        select y as order_year, count(o_orderkey) as n_orders from years left join orders on year(o_orderdate) = y group by 1""",
    ),
    "largest_orders": (largest_orders, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10"),
}
