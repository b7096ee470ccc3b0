"""Operator 1 [native]: line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.staging import Workspace, broadcast_below, delete, text_mark

#: The white space that is stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES = 4
FANOUT = 2
BROADCAST_ROWS = 500_000
#: At most so many bits, 32 MB, for the filter of documents that lose lines.
FILTER_BITS = 1 << 28
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, with A-Z (and no other letters) in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> list[Column]:
    """128 bits of a key as two longs: xxHash64 with its usual seed, and chained after a constant."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("tarnlight"), key).alias("h2")]


class RunStore:
    """Sorted runs of (line hash, number of documents) in levels, as in a log-structured merge tree.

    A new batch is merge-anti-joined with the lines that a run already holds as frequent; the rest is
    added as a sorted run of level 0. Whenever a level has `fanout` runs they are merged into one
    of the next level, which adds up the counts of equal lines. So each line hash is rewritten
    at most log(batches) times, and a batch costs what it brings, not what the store holds.

    A run is a table of Parquet files bucketed and sorted by line hash, with the same number of buckets on all levels:
    runs are joined with batches and with each other bucket by bucket, without moving or sorting what they hold. The files and a
    manifest of the levels lie below `path`, so a store outlives the session: open() finds the last manifest that was
    written whole. The tables are external ones of the session's catalog, dropped by close(), which leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, frequent: int, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.frequent, self.fanout = spark, path.rstrip("/"), frequent, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RunStore:
        """The store as its last absorb left it."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifest")
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*/_SUCCESS"))
        last = max(int(status.getPath().getParent().getName()) for status in found)
        state = json.loads(spark.read.text(f"{folder}/{last:09d}").first()[0])
        store = cls(spark, path, state["frequent"], state["fanout"], state["buckets"])
        store.levels, store.version = state["levels"], last
        for name in store._names():
            spark.sql(f"create table if not exists {name} (h1 bigint, h2 bigint, n_docs bigint) using parquet clustered by (h1, h2) sorted by (h1, h2) into {store.buckets} buckets location '{store.path}/{name}'")
        return store

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self._names()]

    def unknown(self, counts: DataFrame) -> DataFrame:
        """The rows of a batch's counts whose lines no run holds as frequent."""
        for run in self.runs():
            counts = counts.join(run.filter(F.col("n_docs") >= self.frequent).select(*KEY).hint("merge"), KEY, "left_anti")
        return counts

    def absorb(self, counts: DataFrame) -> None:
        """Add a batch's (h1, h2, n_docs), one row for each hash. Each batch must be absorbed once."""
        with sorted_buckets(self.spark):
            self.levels[0].append(self._write(self.unknown(counts).select(*KEY, "n_docs")))
            old = []
            for depth in range(len(self.levels)):
                if len(self.levels[depth]) >= self.fanout:
                    merged = self._write(_merged([self.spark.table(name) for name in self.levels[depth]]))
                    old += self.levels[depth]
                    self.levels[depth] = []
                    if depth + 1 == len(self.levels):
                        self.levels.append([])
                    self.levels[depth + 1].append(merged)
        self.version += 1
        state = json.dumps({"frequent": self.frequent, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels})
        self.spark.range(0, 1, 1, 1).select(F.lit(state)).write.text(f"{self.path}/manifest/{self.version:09d}")
        for name in old:  # no manifest names them any more
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, f"{self.path}/{name}")

    def _write(self, run: DataFrame) -> str:
        name = f"tarnlight_run_{uuid.uuid4().hex}"
        run.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def frequent_lines(self) -> DataFrame:
        """Hashes of the lines that all batches together have in at least `frequent` documents."""
        return _merged(self.runs()).filter(F.col("n_docs") >= self.frequent).select(*KEY)

    def close(self) -> None:
        """Take the tables out of the catalog; plans that read the runs can't be executed afterwards."""
        for name in self._names():
            self.spark.sql(f"drop table if exists {name}")


def _merged(runs: list[DataFrame]) -> DataFrame:
    """The runs as one, two at a time by a merge of their sorted buckets, with the counts of equal lines added up."""
    whole = runs[0]
    for run in runs[1:]:
        more = run.withColumnRenamed("n_docs", "more")
        whole = whole.join(more.hint("merge"), KEY, "full").select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))
    return whole


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Within, Spark takes a bucket of one file as sorted, as the runs' are; afterwards the setting is as before."""
    setting = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def line_dedup(
    docs: DataFrame, min_docs: int = 10, min_length: int = 1, batches: int = BATCHES, fanout: int = FANOUT, broadcast_rows: int = BROADCAST_ROWS, store: RunStore | None = None
) -> DataFrame:
    """Drop lines that stand in at least min_docs documents from every document.

    Lines are split at \\n and compared by line_key; keys shorter than min_length code points are
    never dropped. A document is a row: a line that a row repeats counts once, and repeated rows
    count each. A null or empty text is one empty line. Returns docs' columns (text is what stays,
    joined by \\n; it is null for a null text with nothing dropped) and n_lines and n_dropped (long).
    Columns of docs with these names are replaced. doc_id may be null or repeated: rows are told
    apart by doc_id and text. An empty table gives no rows.

    With a store, its runs count too: lines are dropped that stand in as many documents (the store's `frequent`) of docs
    and all batches that it has absorbed, and docs are absorbed into it. Without one, docs alone count.

    One scan writes the line hashes (a few per cent of the text), the runs are built from those,
    and one join by document brings each its dropped lines' places. The frequent lines, and the places, are broadcast
    only if they number at most broadcast_rows; else a Bloom filter of the documents that lose lines keeps
    most texts of the others out of the shuffle.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "line-dedup")
    body = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(F.split(body, "\n", -1), line_key)
    hashed = docs.select(
        F.pmod(F.xxhash64("doc_id", body), F.lit(batches)).cast("int").alias("batch"), F.col("doc_id"), F.xxhash64(body).alias("text_hash"), keys.alias("keys")
    ).select(
        "batch", "doc_id", "text_hash",
        F.transform("keys", lambda k: F.when(F.char_length(k) >= min_length, F.struct(*key_hash(k)))).alias("lines"),
        F.transform(F.array_distinct(F.filter("keys", lambda k: F.char_length(k) >= min_length)), lambda k: F.struct(*key_hash(k))).alias("own"),
    )
    hashed = space.stage(hashed, "lines", ("batch",))

    runs = store or RunStore(spark, f"{space.path}/store", min_docs, fanout)
    for batch in range(batches):
        lines = hashed.filter(F.col("batch") == batch).select(F.inline("own"))
        runs.absorb(lines.groupBy(*KEY).agg(F.count("*").alias("n_docs")))
    with sorted_buckets(spark):
        frequent = space.stage(runs.frequent_lines(), "frequent")
    if store is None:
        runs.close()
        delete(spark, runs.path)
    frequent = broadcast_below(frequent, frequent.count(), broadcast_rows)

    placed = hashed.select("doc_id", "text_hash", F.posexplode("lines").alias("place", "line")).filter("line is not null")
    placed = placed.select("doc_id", "text_hash", "place", "line.h1", "line.h2").join(frequent, KEY, "left_semi")
    # a set, as repeated rows bring the same places
    dropped = placed.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("place")).alias("places"))
    return _without(docs, space.stage(dropped, "dropped"), broadcast_rows)


def _without(docs: DataFrame, dropped: DataFrame, broadcast_rows: int) -> DataFrame:
    """docs without the lines at the sorted places: the slices between them are joined again."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*own).alias("own"), F.col("doc_id").alias("of_doc"), text_mark(F.col("text")).alias("of_text"))
    same = F.col("of_doc").eqNullSafe(F.col("doc_id")) & (F.col("of_text") == F.col("text_hash"))
    n_docs, n_places = dropped.agg(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    nothing = F.array().cast("array<int>")
    if n_docs + n_places <= broadcast_rows:
        joined = rows.join(F.broadcast(dropped), same, "left").select("own", F.coalesce("places", nothing).alias("places"))
    else:
        marked = _marked(rows, dropped, n_docs)
        joined = marked.filter("maybe").join(dropped.hint("merge"), same, "left").select("own", F.coalesce("places", nothing).alias("places"))
        joined = joined.unionByName(marked.filter("not maybe").select("own", nothing.alias("places")))
    joined = joined.withColumn("lines", F.split(F.coalesce("own.text", F.lit("")), "\n", -1))
    ends = F.concat(F.array(F.lit(-1)), "places", F.array(F.size("lines")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("places")), lambda i: F.slice("lines", F.get("ends", i) + 2, F.get("ends", i + 1) - F.get("ends", i) - 1))
    joined = joined.withColumn("ends", ends)
    text = F.when(F.size("places") == 0, F.col("own.text")).otherwise(F.concat_ws("\n", F.flatten(gaps)))
    return joined.select(
        *[(text if c.lower() == "text" else F.col("own").getField(c)).alias(c) for c in own],
        F.size("lines").cast("long").alias("n_lines"),
        F.size("places").cast("long").alias("n_dropped"),
    )


def _marked(rows: DataFrame, dropped: DataFrame, n_docs: int) -> DataFrame:
    """rows with maybe, false only if dropped doesn't hold their key.

    A Bloom filter of eight bits or more for each key, up to FILTER_BITS in all, in bitmaps of 4 KB that are broadcast.
    """
    bits = min(FILTER_BITS, 1 << (8 * n_docs).bit_length())
    at = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(bits))
    bitmaps = dropped.groupBy(F.bitmap_bucket_number(at).alias("bitmap_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    own = F.pmod(F.xxhash64("of_doc", "of_text"), F.lit(bits))
    bit = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (bit % 8).cast("int")) == 1
    return rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(own) == F.col("bitmap_no"), "left").select(*rows.columns, F.coalesce(held, F.lit(False)).alias("maybe"))


def op1_line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    kept = line_dedup(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with d as (select row_number() over () as row_no, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select row_no, doc_id, lines, unnest(lines) as line, generate_subscripts(lines, 1) as place from d),
k as (select row_no, doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct row_no) >= 10),
m as (select k.*, f.key is not null as hit from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, cast(sum(cast(hit as int)) as bigint) as n_dropped,
sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not hit), '')) as kept_sha256
from m group by row_no, doc_id
"""
