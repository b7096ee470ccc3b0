"""Operator 8: mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.staging import Workspace, broadcast_below, repeated, text_mark, unused

#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
BUCKET_ROWS = 500
BROADCAST_ROWS = 100_000
#: Size classes for each doubling of a document's words; the documents of one are of nearly one size.
CLASSES = 16
#: A word: no space and none of the characters U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
CLASS = ["of_source", "of_class"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """source, source_size, target for sizes(source, source_size), one row for each source.

    Sources are ordered by code point with null last and weigh `weights` in turn. Together they get
    share of all sizes by weight; a target stops at max_repeats times its source's size and what is over
    is shared again by weight among the others, until none is above. That is min(cap, level * weight) with
    one level for all. No task holds more than a range of the sources.
    """
    space = Workspace(sizes.sparkSession, "source-targets")
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last()).select("source", "source_size", F.spark_partition_id().alias("part"))
    ordered = space.stage(ordered, "ordered")
    # a source's place: within its range of sources, after the sources of the ranges before (one row for each range)
    ranges = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    rows = ordered.join(F.broadcast(ranges.select("part", before.alias("before"))), "part")
    turn = F.pmod(place, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = space.stage(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_repeats)).alias("cap")), "weighed")
    level = _common_level(space, rows, share)
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _common_level(space: Workspace, rows: DataFrame, share: float) -> float:
    """The level at which the targets min(cap, level * weight) add up to share of all sizes, infinite if all are capped.

    In order of cap / weight, the level is where the caps of the sources before and the level's part of the others
    reach that sum. The sums of ranges, as many as the shuffle has partitions, show in which range that is; only
    that range is ordered source by source.
    """
    words = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    ranged = rows.select("cap", "weight", (F.col("cap") / F.col("weight")).alias("full_at")).repartitionByRange("full_at")
    ranged = space.stage(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"), F.max("full_at").alias("full_at")).orderBy("part").collect()
    capped, free = 0.0, sum(r["weight"] for r in sums)
    for r in sums:
        if capped + r["cap"] + r["full_at"] * (free - r["weight"]) >= words:
            break
        capped, free = capped + r["cap"], free - r["weight"]
    else:
        return math.inf
    upto = Window.partitionBy("part").orderBy("full_at", "weight").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.filter(F.col("part") == r["part"]).select(
        "full_at", (F.lit(capped) + F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).alias("capped"), (F.lit(free) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("free")
    )
    reached = own.filter(F.col("capped") + F.col("full_at") * F.col("free") >= words).orderBy("full_at", F.col("free").desc()).first()
    return r["full_at"] if reached is None else (words - reached["capped"]) / reached["free"]


def _uniform(*values) -> Column:
    """A number between 0 and 1 that follows from the values alone."""
    return (F.xxhash64(*values).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def _class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * CLASSES).cast("int")).otherwise(-1)


def _counted(classes: DataFrame, seed: int) -> DataFrame:
    """of_source, of_class and due: how many documents of each size class are drawn.

    classes has a row for each class: n documents of `mean` words on average, and the words `wanted` of the source. A
    document's chance is in proportion to its words, up to 1: the classes at and above that are certain and what is then left is shared again
    among the others. A class's expected number is rounded at random, up with the chance of its fraction, after the words that larger classes
    gave too much or too little are made up for, which changes no expectation. So a source's words miss `wanted` by
    little more than a document of its smallest class, and the chances stay.
    """
    larger = Window.partitionBy("of_source").orderBy(F.col("of_class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("of_source").orderBy(F.col("of_class").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    some = classes.filter("of_class >= 0 and wanted > 0")
    factor = (F.col("wanted") - F.coalesce(F.sum(F.col("n") * F.col("mean")).over(larger), F.lit(0.0))) / F.sum(F.col("n") * F.col("mean") * F.col("mean")).over(rest)
    some = some.withColumn("factor", factor).withColumn("fits", F.col("factor") * F.col("mean") <= 1 + 1e-9)
    factors = some.groupBy("of_source").agg(
        F.max_by(F.when(F.col("fits"), F.col("factor")), F.when(F.col("fits"), F.col("of_class"))).alias("factor"),
        F.sort_array(F.collect_list(F.struct("of_class", "n", "mean", _uniform(F.lit(seed), "of_source", "of_class").alias("u"))), asc=False).alias("classes"),
    )
    # at most CLASSES classes for each doubling, so an array holds some hundreds
    expected = "x.n * least(1D, factor * x.mean)"
    number = f"greatest(0L, least(x.n, floor({expected} + a.owed / x.mean + x.u)))"
    fold = f"""aggregate(classes, named_struct('owed', 0D, 'due', cast(array() as array<struct<of_class: int, due: bigint>>)),
        (a, x) -> named_struct('owed', a.owed + ({expected} - {number}) * x.mean, 'due', concat(a.due, array(named_struct('of_class', x.of_class, 'due', {number})))), a -> a.due)"""
    return factors.select("of_source", F.explode(F.expr(fold)).alias("made")).select("of_source", "made.of_class", "made.due")


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows that are joined with their class's plan, with the Pareto rank, its bucket and place: random odds over the odds of the document's chance in its class."""
    chance = F.least(F.col("due") * F.col("size") / F.col("words"), F.lit(1 - 1e-9))
    rank = F.when((F.col("due") > 0) & (F.col("size") > 0), F.col("uniform") / (1 - F.col("uniform")) * (1 - chance) / chance)
    ranked = rows.withColumn("rank", rank)
    # rank / (1 + rank) spreads over the buckets, and evenly about 1/2, where the line is
    return ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")).cast("int")).withColumn("place", F.struct("rank", "doc_id", "text_mark"))


def _same_class(rows: DataFrame, plan: DataFrame) -> Column:
    return rows["source"].eqNullSafe(plan["of_source"]) & (rows["size_class"] == plan["of_class"])


def _planned(space: Workspace, runs: DataFrame, seed: int, weights: tuple[float, ...], max_repeats: int, bucket_rows: int, broadcast_rows: int) -> tuple[DataFrame, int]:
    """A row for each size class of each source: whole copies for all, and the line up to which documents get one more; and the number of these rows.

    runs(doc_id, text_mark, source, size, size_class, uniform, n) are the documents, repeated rows counted.
    """
    targets = source_targets(runs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_repeats)
    targets = space.stage(targets, "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of_source = targets.select(F.col("source").alias("of_source"), "source_size", "target", F.floor(ratio + 1e-12).alias("whole"))
    of_source = of_source.withColumn("wanted", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    classes = runs.groupBy(F.col("source").alias("source"), F.col("size_class").alias("of_class")).agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("words"))
    n_sources = targets.count()
    classes = classes.join(broadcast_below(of_source, n_sources, broadcast_rows), F.col("source").eqNullSafe(F.col("of_source"))).drop("source")
    classes = space.stage(classes.withColumn("mean", F.col("words") / F.col("n")).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows))), "classes")
    n_classes = classes.count()
    due = _counted(classes, seed).select(F.col("of_source").alias("due_source"), F.col("of_class").alias("due_class"), "due")
    plan = classes.join(broadcast_below(due, n_classes, broadcast_rows), F.col("of_source").eqNullSafe(F.col("due_source")) & (F.col("of_class") == F.col("due_class")), "left")
    plan = space.stage(plan.withColumn("due", F.coalesce("due", F.lit(0))).select(*CLASS, "source_size", "target", "whole", "words", "n", "buckets", "due").withColumnRenamed("n", "of"), "plan")

    open_ = broadcast_below(plan.filter("due > 0 and due < of"), n_classes, broadcast_rows)
    ranked = _ranked(runs.join(open_, _same_class(runs, open_)))
    sums = ranked.groupBy(*CLASS, "bucket").agg(F.sum("n").alias("n"), F.first("due").alias("due"))
    upto = F.sum("n").over(Window.partitionBy(*CLASS).orderBy("bucket"))
    line = sums.withColumn("upto", upto).filter("upto >= due").groupBy(*CLASS).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("line"))
    line = space.stage(line.select(F.col("of_source").alias("line_source"), F.col("of_class").alias("line_class"), F.col("line.bucket").alias("line_bucket"), F.col("line.before").alias("before")), "lines")
    own_line = F.col("of_source").eqNullSafe(F.col("line_source")) & (F.col("of_class") == F.col("line_class"))
    edge = ranked.join(broadcast_below(line, n_classes, broadcast_rows), own_line & (F.col("bucket") == F.col("line_bucket")))
    reach = F.sum("n").over(Window.partitionBy(*CLASS).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    # the run that reaches the line, and how many of its rows are before it
    last = edge.withColumn("reach", reach).filter("reach >= due").groupBy(*CLASS).agg(F.min_by(F.struct("place", (F.col("due") - F.col("reach") + F.col("n")).alias("last_due"), F.col("n").alias("last_n")), "place").alias("last"))
    last = last.select(F.col("of_source").alias("last_source"), F.col("of_class").alias("last_class"), F.col("last.place").alias("last"), F.col("last.last_due").alias("last_due"), F.col("last.last_n").alias("last_n"))
    plan = plan.join(broadcast_below(line, n_classes, broadcast_rows), own_line, "left").join(
        broadcast_below(space.stage(last, "last"), n_classes, broadcast_rows), F.col("of_source").eqNullSafe(F.col("last_source")) & (F.col("of_class") == F.col("last_class")), "left"
    )
    return space.stage(plan.select(*CLASS, "source_size", "target", "whole", "words", "buckets", "due", "of", "line_bucket", "last", "last_due", "last_n"), "plan"), n_classes


def _runs(space: Workspace, docs: DataFrame, seed: int) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select("doc_id", text_mark(F.col("text")).alias("text_mark"), "source", size.alias("size"))
    runs = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return space.stage(runs.withColumn("size_class", _class(F.col("size"))).withColumn("uniform", _uniform(F.lit(seed), "doc_id", "text_mark")), "runs")


#: Whether a ranked document lies before its class's line: all rows of a run, or those of the run at the line up to last_due.
_BEFORE = "due >= of and of > 0 and size > 0 or due > 0 and size > 0 and (bucket < line_bucket or bucket = line_bucket and place < last)"
_AT_LINE = "due > 0 and due < of and size > 0 and place = last"


def mixed_sizes(
    docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, bucket_rows: int = BUCKET_ROWS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """doc_id, size, source_size, target and copies for each row of docs(doc_id, text, source): pareto_mix without other columns, from one scan of the texts."""
    space = Workspace(docs.sparkSession, "mixing")
    runs = _runs(space, docs, seed)
    plan, n_classes = _planned(space, runs, seed, weights, max_repeats, bucket_rows, broadcast_rows)
    plan = broadcast_below(plan, n_classes, broadcast_rows)
    ranked = _ranked(runs.join(plan, _same_class(runs, plan)))
    extra = F.when(F.expr(_BEFORE), F.col("n")).when(F.expr(_AT_LINE), F.col("last_due")).otherwise(0)
    ranked = ranked.withColumn("extra", extra)
    parts = F.array(F.struct((F.col("whole") + 1).cast("int").alias("copies"), F.col("extra").alias("rows")), F.struct(F.col("whole").cast("int").alias("copies"), (F.col("n") - F.col("extra")).alias("rows")))
    return repeated(ranked.select("doc_id", "size", "source_size", "target", F.inline(parts)), "rows")


def pareto_mix(
    docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, bucket_rows: int = BUCKET_ROWS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """docs with source_size, target, size (words) and copies: how many times the mix takes each row.

    A source that has to give target / source_size copies of each document gives the whole part for certain. The words that are then
    wanted come from a Pareto order sample: a document's chance is in proportion to its words, those at or above 1 are certain and the
    others' chances are worked out again; size classes of nearly equal documents get a fixed number each (see _counted), and in its class a
    document is ranked by random odds u / (1 - u) over the odds of its chance; the first of that number get one copy more. So
    long documents are repeated sooner than short ones, and a source's words still come within about a document of their target.

    u is a hash of seed, doc_id and text, so reruns agree. Rows that repeat doc_id, text and source are drawn together, except
    those at the line, of which as many as are due are taken, in any order. Documents without words (null, empty or blank) have size 0 and only their
    certain copies. doc_id may be null. Columns of docs stay, except those named like new ones, which are replaced. An empty table
    gives no rows.

    No source is gathered in one task: documents are counted in buckets of rank, as many as the rows
    need, and only the bucket that holds a class's line is ordered row by row.
    """
    space = Workspace(docs.sparkSession, "mixing")
    plan, n_classes = _planned(space, _runs(space, docs, seed), seed, weights, max_repeats, bucket_rows, broadcast_rows)
    made = ("size", "source_size", "target", "copies")
    own = [c for c in docs.columns if c.lower() not in made]
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    # exploded, as the optimiser would else count the words anew wherever the size is used
    rows = docs.select(F.struct(*own).alias("own"), "doc_id", text_mark(F.col("text")).alias("text_mark"), "source", F.explode(F.array(size)).alias("size"))
    rows = rows.withColumn("size_class", _class(F.col("size"))).withColumn("uniform", _uniform(F.lit(seed), "doc_id", "text_mark"))
    plan = broadcast_below(plan, n_classes, broadcast_rows)
    ranked = _ranked(rows.join(plan, _same_class(rows, plan)))
    # the rows of a run that is taken in part are told apart by where they were written
    parted = F.coalesce(F.expr(f"({_AT_LINE}) and last_due < last_n"), F.lit(False))
    # exploded as well: a caller's filter on copies would else become the join's condition, with the rank spelled out in it a dozen times
    whole = ranked.withColumn("drawn", F.explode(F.array(F.coalesce(F.expr(f"({_BEFORE}) or ({_AT_LINE})"), F.lit(False)))))
    out = [*[F.col("own").getField(c).alias(c) for c in own], "size", "source_size", "target", (F.col("whole") + F.col("drawn").cast("long")).cast("int").alias("copies")]
    if plan.filter("last_due < last_n").isEmpty():
        return whole.select(*out)
    whole = whole.filter(~parted)
    some = space.stage(ranked.filter(parted).withColumn("part", F.spark_partition_id()), "parted")
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*CLASS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = some.groupBy(*CLASS, "part").agg(F.count("*").alias("rows")).select(F.col("of_source").alias("part_source"), F.col("of_class").alias("part_class"), F.col("part").alias("part_no"), before.alias("before"))
    number = F.row_number().over(Window.partitionBy(*CLASS, "part").orderBy(F.lit(0)))
    same = F.col("of_source").eqNullSafe(F.col("part_source")) & (F.col("of_class") == F.col("part_class")) & (F.col("part") == F.col("part_no"))
    some = some.withColumn("number", number).join(parts, same).withColumn("drawn", F.col("before") + F.col("number") <= F.col("last_due"))
    return whole.select(*out).unionByName(some.select(*out))


def op8_pareto_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    mixed = mixed_sizes(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
