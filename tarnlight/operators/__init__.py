"""Operators that Spark has no name for, composed of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.scratch import Scratch


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], slot_seconds: int = 86_400) -> DataFrame:
    """left with the values of right's latest row at or before left's `on`, among equal `by`; nulls where there is none.

    Time is cut into slots, and both sides are put into one table whose rows are ordered within key and slot: a window
    carries the last row of right forward there. What is found in no row of the own slot comes from the last slot before that has any,
    by a window over one row for each key and slot. So no pair is made, and a hot key's rows are dealt by
    slot. Of right rows at one time the one with the largest values counts. Left rows with a null key or a null `on` find nothing.
    """

    def slot(at: str) -> Column:
        return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (slot_seconds * 1_000_000)).alias("slot")

    rows = left.select(F.lit(1).alias("is_left"), F.col(on).alias("at"), slot(on), *by, F.struct(*left.columns).alias("own"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("found"))
    seen = right.filter(F.col(on).isNotNull()).select(F.lit(0).alias("is_left"), F.col(on).alias("at"), slot(on), *by, F.lit(None).cast(rows.schema["own"].dataType).alias("own"), F.struct(*values).alias("found"))
    both = rows.unionByName(seen)
    upto = Window.partitionBy(*by, "slot").orderBy("at", "is_left", "found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("last", F.last("found", ignorenulls=True).over(upto)).filter("is_left = 1")
    slots = both.groupBy(*by, "slot").agg(F.max(F.when(F.col("is_left") == 0, F.struct("at", "found")))["found"].alias("ends"))
    before = F.last("ends", ignorenulls=True).over(Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    carried = slots.select(*[F.col(k).alias(f"slot_{k}") for k in by], F.col("slot").alias("of_slot"), before.alias("before"))
    same = F.col("slot") == F.col("of_slot")
    for key in by:
        same = same & (F.col(key) == F.col(f"slot_{key}"))
    # a null key or time meets no slot, and is then in no window with rows of right that count
    found = F.when(F.col("of_slot").isNotNull(), F.coalesce("last", "before"))
    joined = last.join(carried, same, "left").withColumn("found", found)
    return joined.select(*[F.col("own").getField(c).alias(c) for c in left.columns], *[F.col("found").getField(c).alias(c) for c in values])


def not_in(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """left's rows whose key is NOT IN right's values, as SQL has it.

    No value at all lets every row through; a null among the values lets none through; a null key is let through only by no value at all. The right side is read once: its distinct values, a null among them, are
    written, and both the values and their number come from there.
    """
    wanted = Scratch(left.sparkSession, "not-in").write(right.select(F.col(values).alias("not_in_value")).distinct(), "values")
    n_values, n_nulls = wanted.agg(F.count("*"), F.count_if(F.col("not_in_value").isNull())).first()
    if not n_values:
        return left
    if n_nulls:
        return left.limit(0)
    return left.filter(F.col(key).isNotNull()).join(wanted, F.col(key) == F.col("not_in_value"), "left_anti")


def interval_join(left: DataFrame, right: DataFrame, on: str, right_on: str, by: list[str], seconds: int) -> DataFrame:
    """Pairs with equal `by` where right_on lies in the given seconds up to and with `on` (its start left out).

    Time is cut into slots as long as the interval; a left row meets the right rows of its own slot and
    the one before, so keys and slots are joined by equality and only neighbours are compared.
    """

    def slot(column: str) -> Column:
        return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")

    ours = left.withColumn("slot", F.explode(F.array(slot(on), slot(on) - 1)))
    theirs = right.withColumn("slot", slot(right_on))
    length = F.expr(f"make_dt_interval(0, 0, 0, {int(seconds)})")
    pairs = ours.join(theirs, [*by, "slot"])
    return pairs.filter((F.col(right_on) <= F.col(on)) & (F.col(right_on) > F.col(on) - length)).drop("slot")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their place from 1. Spark drops later rows before the shuffle (group limit)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def sessions(events: DataFrame, by: str, ts: str, gap: str, slot_seconds: int = 86_400) -> DataFrame:
    """by, started, ended, n_events for each run of events of one key that are at most `gap` apart.

    Time is cut into slots. Runs are found within key and slot, so a hot key is in as many tasks as it has slots; then the runs of each key, which
    are few beside its events, are put together at the slots' borders. Events with a null key or time are in no session.
    """
    length = F.expr(f"interval {gap}")
    timed = events.dropna(subset=[by, ts]).select(by, F.col(ts).alias("at"), F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slot_seconds * 1_000_000)).alias("slot"))
    in_slot = Window.partitionBy(by, "slot").orderBy("at")
    first = F.coalesce(F.lag("at").over(in_slot) + length < F.col("at"), F.lit(True))
    numbered = timed.withColumn("first", first).withColumn("run", F.sum(F.col("first").cast("long")).over(in_slot.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(by, "slot", "run").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n_events"))
    in_time = Window.partitionBy(by).orderBy("started")
    apart = F.coalesce(F.lag("ended").over(in_time) + length < F.col("started"), F.lit(True))
    joined = runs.withColumn("apart", apart).withColumn("session", F.sum(F.col("apart").cast("long")).over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(by, "session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n_events").alias("n_events")).drop("session")
