"""Operator 4: near-duplicates by banded MinHash, odd sketches and a check on the full sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, raw_texts
from tarnlight.llm.components import connected_components
from tarnlight.llm.shipping import remote
from tarnlight.llm.staging import Workspace, broadcast_below, named, once, text_mark, unused, without
from tarnlight.llm.word_hashes import mix, windows, word_hashes

#: Bands of rows: texts of similarity 0.8 share none of 32 bands of 5 with a chance of 3 in a million, of 0.85 with 7 in a billion.
BANDS, ROWS = 32, 5
#: Bins of the one-permutation samples (a power of two) that are folded into an odd sketch, and its bits.
BINS, BITS = 4096, 2048
#: Deviations by which a pair's odd sketches may miss the threshold and still go to the full check. The formula overstates them: these are 4.6 or more of the deviations measured at any set size.
DEVIATIONS = 3.4
#: A chunk of texts that are checked against one: at most about so many, and so many bytes unless one text has more.
CHUNK, CHUNK_BYTES = 64, 16 << 20
#: Members of a bucket whose pairs one task compares with all other members.
SPLIT = 1_024
BROADCAST_ROWS = 500_000
_STEP = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
_FACTORS = mix(_STEP * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OFFSETS = mix(_STEP * np.uint64(0xC2B2AE3D27D4EB4F))
_BAND_FACTORS = mix(_STEP * np.uint64(0x165667B19E3779F9)).reshape(BANDS, ROWS) | np.uint64(1)


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words the whole sequence is one; none without words."""
    hashes = word_hashes(data.lower())  # of bytes, this lowers A-Z alone
    if 0 < len(hashes) < words:
        return windows(hashes, len(hashes)) + np.uint64(len(hashes))
    return np.unique(windows(hashes, words))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values, each the set's minimum under a hash function of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):  # blocks bound the memory
        np.minimum(least, (_FACTORS[:, None] * shingles[at : at + 2048] + _OFFSETS[:, None]).min(axis=1), out=least)
    folded = (least.reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return mix(folded + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def bin_samples(shingles: np.ndarray) -> np.ndarray:
    """The least hash in each of BINS bins that has any: MinHash samples from one permutation, whose high bits are the bin."""
    hashed = np.sort(mix(shingles + np.uint64(0x94D049BB133111EB)))
    bins = hashed >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    return hashed[first]


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The parities of how many samples fall on each of BITS bits, as 64-bit integers."""
    bits = (mix(samples) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def sketch_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_mark", "n_shingles", "n_bytes", "s1", "s2", "n_samples", "bands", "odd"]
    for batch in batches:
        sizes, lengths, digests, counts, bands, odds = [], [], [], [], [], []
        for data in raw_texts(batch):
            shingles = shingle_set(data, words)
            sizes.append(len(shingles))
            lengths.append(len(data))
            digests.append(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64))
            bands.append(band_keys(shingles))
            samples = bin_samples(shingles)
            counts.append(len(samples))
            odds.append(odd_sketch(samples))
        digest = np.array(digests, np.int64).reshape(-1, 2)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))) for x, n in ((bands, BANDS), (odds, BITS // 64))]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_mark"), pa.array(sizes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(counts, pa.int32()), *lists], names)


def _alike(percent: int) -> Column:
    """True where neither the sizes nor the odd sketches of a pair rule out the similarity.

    At the threshold t, sets of n_a and n_b shingles have a union of u = (n_a + n_b) / (1 + t). Its M
    filled bins follow from those of either set, and of M samples drawn from u about t * M are common. The
    bound on the XOR's population count is what DEVIATIONS below that leaves, after
    Mitzenmacher, Pagh and Pham: x differing samples leave B / 2 * (1 - exp(-2 x / B)) odd bits of B.
    """
    t = percent / 100
    union = (F.col("n_a") + F.col("n_b")) / (1 + t)

    def filled(side: str) -> Column:
        new = F.greatest(union - F.col(f"n_{side}"), F.lit(0.0))
        return F.col(f"k_{side}") + (BINS - F.col(f"k_{side}")) * (1 - F.exp(-new / BINS))

    bins = (filled("a") + filled("b")) / 2
    share = F.greatest("k_a", "k_b") / BINS
    spread = t * (1 - t) * bins * F.greatest(1 - bins / union, F.lit(0.0)) + t * t * F.greatest(union - F.least("n_a", "n_b"), F.lit(0.0)) * share * (1 - share)
    common = t * bins - 0.5
    apart = F.greatest(F.col("k_a") + F.col("k_b") - 2 * common, F.lit(0.0))
    faded = F.exp(-4 * apart / BITS)
    noise = BITS / 4 * (1 - faded) - apart * faded  # the variance of the count
    most = BITS / 2 * (1 - F.exp(-2 * apart / BITS)) + DEVIATIONS * F.sqrt(4 * spread * F.sqrt(faded) + F.greatest(noise, F.lit(0.0)))
    odd = F.bit_count(F.get("odd_a", F.lit(0)).bitwiseXOR(F.get("odd_b", F.lit(0))))
    for i in range(1, BITS // 64):
        odd = odd + F.bit_count(F.get("odd_a", F.lit(i)).bitwiseXOR(F.get("odd_b", F.lit(i))))
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (odd <= most)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Words are runs of other than space and U+0009 to U+000D, with A-Z in lower case; a text's set
    is its distinct shingles of that many words, or its whole sequence if it has fewer. Sets with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id that links reach, and
    kept says that it is the row's own. Texts without words are linked with nothing, nor are
    rows without a doc_id, whose component_id is null and which are kept. Rows that repeat a doc_id
    with the same text share one verdict; with other texts each is judged by its own. Other columns
    are ignored; an empty table gives no rows.

    Equal sets are one class from the start, however many rows they have. Classes in one band's
    bucket are candidates; odd sketches and set sizes rule out most, and the rest is checked
    on the full sets. First every class is checked against one leader of its buckets, which makes most components
    with few checks. Then, in buckets that still hold several components, all pairs across components are
    candidates. So no link between different components is lost to a limit on a bucket, and no bucket that is one
    component costs pairs.
    """
    return _judged(docs, words, percent).drop("text_mark")


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns: one document of each group.

    Of rows that repeat both doc_id and text one stays; rows without a doc_id all stay.
    """
    space = Workspace(docs.sparkSession, "near-duplicates")
    judged = space.stage(_judged(docs.select("doc_id", "text"), words, percent).select("doc_id", "text_mark", "kept"), "judged")
    kept = without(docs, judged.filter("not kept"))
    repeated = space.stage(judged.filter("kept and doc_id is not null").groupBy("doc_id", "text_mark").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    some, same, _ = named(kept, repeated)
    some = broadcast_below(some, repeated.count(), BROADCAST_ROWS)
    (mark,) = unused(kept, "mark")
    own = kept.join(some, same, "left_semi").withColumn(mark, text_mark(F.col("text"))).dropDuplicates(["doc_id", mark])
    return kept.join(some, same, "left_anti").unionByName(own.select(*docs.columns))


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    space = Workspace(spark, "near-duplicates")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = space.stage(
        rows.withColumn("text_mark", text_mark(F.col("text"))).mapInArrow(remote(__name__, "sketch_batches", words), "doc_id long, text_mark long, n_shingles long, n_bytes long, s1 long, s2 long, n_samples int, bands array<long>, odd array<long>"), "sketches"
    )
    kinds = space.stage(sketches.filter("doc_id is not null").groupBy("doc_id", "text_mark").agg(F.count("*").alias("n")).withColumn("n", F.col("n").cast("long")), "kinds")
    again = kinds.filter("n > 1")
    rows = once(rows, again, again.count(), BROADCAST_ROWS).select("doc_id", "text")
    twice = space.stage(kinds.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("id")), "twice")
    n_twice = twice.count()
    if not n_twice:
        return _linked(space, sketches.withColumn("node", F.col("doc_id")), rows.withColumnRenamed("doc_id", "node"), words, percent, made_ids=False)
    # such an id's texts are nodes of their own, by a number made from the id and the text
    several = broadcast_below(twice, n_twice, BROADCAST_ROWS)
    node = F.when(F.col("id").isNotNull(), F.xxhash64(F.lit("node"), "doc_id", "text_mark")).otherwise(F.col("doc_id")).alias("node")
    noded = space.stage(sketches.join(several, F.col("doc_id") == F.col("id"), "left").select(*sketches.columns, node), "named")
    texts = rows.withColumn("text_mark", text_mark(F.col("text"))).join(several, F.col("doc_id") == F.col("id"), "left").select(node, "text")
    return _linked(space, noded, texts, words, percent, made_ids=True)


def _linked(space: Workspace, sketches: DataFrame, rows: DataFrame, words: int, percent: int, made_ids: bool) -> DataFrame:
    """The verdicts of the sketched rows; rows(node, text) are the texts. A node, null without a doc_id, stands for one text of one doc_id; it is the doc_id itself unless made_ids."""
    sets = sketches.filter("n_shingles > 0 and node is not null")
    classes = space.stage(sets.groupBy("s1", "s2").agg(F.min("node").alias("rep"), F.min("doc_id").alias("low_id")), "classes")
    # a class's sketches come from its representative's row
    first_of = sets.withColumnRenamed("node", "rep").join(classes, ["s1", "s2", "rep"], "left_semi").dropDuplicates(["rep"])
    # what joins below is staged, so that they read plain shuffles on both sides, which can be split at a hot leader, bucket or text
    first_of = space.stage(first_of.select("rep", "n_shingles", "n_bytes", "n_samples", "odd", "bands"), "representatives")
    bands = first_of.select("rep", F.posexplode("bands").alias("band", "bucket"))
    odd = first_of.select("rep", F.col("n_shingles").alias("n"), F.col("n_bytes").alias("bytes"), F.col("n_samples").alias("k"), "odd", F.col("bands").alias("keys"))
    shared = space.stage(bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").select("bucket", "leader"), "shared")
    members = space.stage(bands.join(shared, "bucket").select("bucket", "band", "leader", "rep"), "members")

    star = members.filter("rep > leader").groupBy("leader", "rep").agg(F.count("*").alias("n"))
    star = star.groupBy("rep").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    side = {x: odd.select(*[F.col(c).alias(f"{c}_{x}" if c != "rep" else x) for c in ("rep", "n", "bytes", "k", "odd")]) for x in "ab"}
    pairs = star.select(F.col("leader").alias("a"), F.col("rep").alias("b")).join(side["a"], "a").join(side["b"], "b").filter(_alike(percent))
    pairs = pairs.select("a", "b", F.greatest("bytes_a", "bytes_b").alias("bytes"))
    first = connected_components(space, verify(space, pairs, rows, words, percent))
    first = space.stage(first, "first")

    held = members.select("bucket", "band", "rep").join(first, F.col("rep") == F.col("node"), "left").select("bucket", "band", "rep", F.coalesce("label", "rep").alias("part"))
    several = space.stage(held.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("bucket"), "several")
    held = mixed = space.stage(held.join(several, "bucket", "left_semi"), "mixed")
    main = held.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.ceil(F.sum("n") / SPLIT).cast("int").alias("splits"))
    main = space.stage(main, "main")
    held = held.join(broadcast_below(main, main.count(), BROADCAST_ROWS), "bucket").join(odd, "rep")
    left, right = (held.select(*[F.col(c).alias(f"{c}_{x}" if c != "rep" else x) for c in ("bucket", "band", "rep", "part", "n", "bytes", "k", "odd", "keys", "main", "splits")]) for x in "ab")
    # the members of a large bucket that aren't in its main part are dealt to splits, each of which meets all members
    left = left.filter("part_a != main_a").withColumn("split_a", F.pmod(F.xxhash64("a"), F.col("splits_a")).cast("int"))
    right = right.withColumn("split_b", F.explode(F.sequence(F.lit(0), F.col("splits_b") - 1)))
    # of the buckets that a pair shares, the first brings it
    first_band = F.array_position(F.zip_with("keys_a", "keys_b", lambda x, y: x == y), True) == F.col("band_a") + 1
    apart = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("split_a") == F.col("split_b")) & (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main_b")) | (F.col("a") < F.col("b")))
    cross = left.join(right, apart & _alike(percent) & first_band)
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("bytes_a", "bytes_b").alias("bytes")).distinct()
    links = verify(space, cross, rows, words, percent)
    space.drop(members, mixed)
    label = {x: first.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab"}
    links = links.join(label["a"], "a", "left").join(label["b"], "b", "left")
    second = connected_components(space, links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
    second = second.select(F.col("node").alias("first_label"), F.col("label").alias("last_label"))
    labels = classes.join(first, F.col("rep") == F.col("node"), "left").withColumn("first_label", F.coalesce("label", "rep"))
    labels = labels.join(second, "first_label", "left").select("s1", "s2", "low_id", F.coalesce("last_label", "first_label").alias("label"))
    if made_ids:
        labels = labels.join(labels.groupBy("label").agg(F.min("low_id").alias("component_id")), "label")
    else:  # the smallest node is the smallest doc_id
        labels = labels.withColumn("component_id", F.col("label"))
    labels = labels.select("s1", "s2", "component_id")

    out = sketches.select("doc_id", "text_mark", "n_shingles", "s1", "s2").join(labels, ["s1", "s2"], "left")
    out = out.select("doc_id", "text_mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def verify(space: Workspace, pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs(a, b, bytes of the longer text) whose full sets are similar enough, staged. rows(node, text) has each node once.

    Each a's partners are dealt to chunks of about CHUNK and CHUNK_BYTES, so no task gathers a group, and long texts are checked
    pair by pair; a text goes once to each chunk that needs it. The texts come from one pass over the rows; which are needed is broadcast
    only if that is a bounded number.
    """
    pairs = space.stage(pairs, "pairs")
    sizes = space.stage(pairs.groupBy("a").agg(F.count("*").alias("n"), F.max("bytes").alias("most")), "sizes")
    at_once = F.least(F.lit(CHUNK), F.floor(CHUNK_BYTES / F.greatest(F.col("most"), F.lit(1))))
    chunk = F.when(at_once <= 1, F.xxhash64("b")).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / at_once)))
    dealt = pairs.join(sizes, "a").select("a", chunk.alias("chunk"), "b")
    needed = dealt.select("a", "chunk", F.col("b").alias("id")).unionByName(dealt.select("a", "chunk", F.col("a").alias("id")).distinct())
    needed = space.stage(needed, "needed")
    texts = rows.join(broadcast_below(needed, needed.count(), BROADCAST_ROWS), F.col("node") == F.col("id")).select("a", "chunk", "id", "text")
    links = space.stage(texts.groupBy("a", "chunk").applyInArrow(remote(__name__, "check_chunk", words, percent), "a long, b long"), "links")
    space.drop(pairs, sizes, needed)
    return links


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """x, y: sorted distinct hashes."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 0 < both and 100 * both >= percent * (len(x) + len(y) - both)


def check_chunk(group: pa.Table, words: int, percent: int) -> pa.Table:
    own, ids = group["a"][0].as_py(), group["id"].to_pylist()
    texts = group["text"].cast(pa.binary())
    mine = shingle_set(texts[ids.index(own)].as_py() or b"", words)
    found = [b for i, b in enumerate(ids) if b != own and similar(mine, shingle_set(texts[i].as_py() or b"", words), percent)]
    return pa.table([pa.array([own] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])


def op4_minhash_near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), words=3, percent=85)
