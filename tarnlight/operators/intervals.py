"""Overlap join of two tables of intervals, and totals of what overlaps without the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, TimestampNTZType, TimestampType


def _whole(frame: DataFrame, name: str) -> Column:
    """A time or whole number as a long that keeps the order and all digits."""
    kind = frame.schema[name].dataType
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, IntegralType):
        return F.col(name).cast("long")
    raise TypeError(f"{name} is {kind.simpleString()}; intervals are of timestamps, dates or whole numbers")


def overlap_join(left: DataFrame, right: DataFrame, span: tuple[str, str], right_span: tuple[str, str], by: list[str] = (), finest: int = 0) -> DataFrame:
    """Pairs with equal `by` whose intervals [start, end) have a point in common; right's columns other than `by` must have names of their own.

    An interval lives on the level at which it is no longer than a bin (bins have lengths of powers of two), so it touches two bins there at most. Rows
    of one level meet the rows of that level and of all shorter ones in their bins, by equality of key, level and bin; a pair is
    given out in the bin in which the later of both starts lies, hence once. So long intervals are in few bins, short ones are compared with
    what is near them, and no pair is made of rows that are further apart than the longer of both. Levels below `finest` are one. Where a key or bin is
    hot, the join reads plain shuffles, which adaptive execution can split.

    Intervals that are empty, reversed or have a null end overlap nothing; neither does a row with a null key. Repeated rows pair each.
    """
    by = list(by)

    def prepared(frame: DataFrame, ends: tuple[str, str], own: str) -> DataFrame:
        rows = frame.select(*by, F.struct(*frame.columns).alias(own), _whole(frame, ends[0]).alias(f"{own}_low"), _whole(frame, ends[1]).alias(f"{own}_high")).filter(F.col(f"{own}_low") < F.col(f"{own}_high"))
        bits = F.length(F.bin(F.col(f"{own}_high") - F.col(f"{own}_low") - 1))  # a length of 1 has the same level as one of 2
        return rows.withColumn(f"{own}_level", F.greatest(bits, F.lit(finest)))

    def binned(rows: DataFrame, own: str, levels: Column) -> DataFrame:
        at = rows.withColumn("level", F.explode(levels))
        return at.withColumn("bin", F.explode(F.expr(f"sequence(shiftright({own}_low, level), shiftright({own}_high - 1, level))")))

    ours, theirs = prepared(left, span, "ours"), prepared(right, right_span, "theirs")

    def met(home: DataFrame, name: str, guests: DataFrame, guest: str, alike: bool) -> DataFrame:
        levels = [r[0] for r in home.select(f"{name}_level").distinct().collect()]  # 64 at most
        above = F.filter(F.array(*[F.lit(level).cast("int") for level in levels]).cast("array<int>"), lambda x: (x >= F.col(f"{guest}_level")) if alike else (x > F.col(f"{guest}_level")))
        pairs = binned(home, name, F.array(f"{name}_level")).join(binned(guests, guest, above), [*by, "level", "bin"])
        return pairs.filter((F.col("ours_low") < F.col("theirs_high")) & (F.col("theirs_low") < F.col("ours_high")) & (F.expr("shiftright(greatest(ours_low, theirs_low), level)") == F.col("bin"))).select("ours", "theirs")

    pairs = met(ours, "ours", theirs, "theirs", True).unionByName(met(theirs, "theirs", ours, "ours", False))
    return pairs.select(*[F.col("ours").getField(c).alias(c) for c in left.columns], *[F.col("theirs").getField(c).alias(c) for c in right.columns if c not in by])


def overlap_totals(left: DataFrame, right: DataFrame, span: tuple[str, str], right_span: tuple[str, str], of: list[str], values: list[str], by: list[str] = (), slot: int = 3_600_000_000) -> DataFrame:
    """of, n and the sums of right's whole-number `values` over the right rows with equal `by` whose intervals [start, end) have a point in common with left's, by left's columns `of`; no row where there are none.

    What overlaps [a, b) has started before b, less what has ended by a. So starts and ends are put into one order of time with the questions, and a running sum
    answers each: no pair is made, and the work grows as the rows, however many overlap. Time is cut into slots (in microseconds, days or numbers, as the intervals are), so
    running sums are of a slot; what earlier slots add is a row for each slot. Empty, reversed or null intervals overlap nothing, nor does a row with a null key.
    """
    by, of = list(by), list(of)
    sums = ["n", *values]

    def good(frame: DataFrame, ends: tuple[str, str]) -> DataFrame:
        spans = frame.withColumns({"low_": _whole(frame, ends[0]), "high_": _whole(frame, ends[1])}).filter("low_ < high_")
        return spans.dropna(subset=by) if by else spans

    ours, theirs = good(left, span), good(right, right_span)
    # at one point of time ends come first, then the questions, then starts
    asks = F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(at).alias("at"), F.lit(1).alias("turn"), F.lit(sign).cast("long").alias("sign")) for side, at, sign in ((0, "high_", 1), (1, "low_", -1))]))
    says = F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(at).alias("at"), F.lit(turn).alias("turn"), F.lit(None).cast("long").alias("sign")) for side, at, turn in ((0, "low_", 2), (1, "high_", 0))]))
    questions = ours.select(*by, F.struct(*of).alias("of"), *[F.lit(0).cast("long").alias(c) for c in sums], asks)
    changes = theirs.select(*by, F.lit(None).cast(questions.schema["of"].dataType).alias("of"), F.lit(1).cast("long").alias("n"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in values], says)
    line = questions.unionByName(changes).withColumn("slot", F.expr(f"div(at, {int(slot)})") - F.when(F.col("at") < 0, 1).otherwise(0))
    key = [*by, "side"]
    inside = Window.partitionBy(*key, "slot").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = line.select("*", *[F.sum(c).over(inside).alias(f"upto_{c}") for c in sums]).filter("sign is not null")
    before = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = line.groupBy(*key, "slot").agg(*[F.sum(c).alias(f"slot_{c}") for c in sums]).select(*key, "slot", *[F.coalesce(F.sum(f"slot_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in sums])
    totals = answers.join(slots, [*key, "slot"]).groupBy("of").agg(*[F.sum(F.col("sign") * (F.col(f"upto_{c}") + F.col(f"before_{c}"))).alias(c) for c in sums])
    return totals.filter("n > 0").select("of.*", *sums)
