"""Operator 12: phrase collocations by counting pairs, then growing contiguous patterns from projected occurrences of longer ones."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, raw_texts
from tarnlight.llm.shipping import remote
from tarnlight.llm.staging import Workspace
from tarnlight.llm.word_hashes import blocks, mix

NO_LANG = "und"
#: Words, and runs of what ends a piece, in a text whose A-Z are lower-cased.
_WORD = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+")
_WORD_OR_END = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]+")
_END = frozenset(b".,;:!?\n\x0b\x0c\r")
#: Distinct words, or occurrences, that a task holds before it hands them on.
HELD = 400_000
#: Codes of runs of words that a task holds before it counts them and hands them on.
HELD_CODES = 1_000_000
#: Words whose numbers a task keeps for each language, and the bytes of the longest of them.
CACHED_WORDS = 400_000
CACHED_LENGTH = 64
#: A filter of frequent codes has 64 bits a code, between these powers of two.
FILTER_BITS = (20, 28)
#: Occurrences that one task grows phrases from, about.
TASK_ROWS = 400_000
#: floor(1000 a n / (l r)), in whole numbers.
SCORE = "(cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"


def word_code(seed: int, lang: Column, word: Column) -> Column:
    """A 64-bit code of a word in a language; word_codes() makes the same in Python."""
    return F.xxhash64(F.lit(f"code {seed}"), lang, word)


def _start(seed: int, lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang, xxhash.xxh64_intdigest(f"code {seed}".encode(), 42))


class BitFilter:
    """The frequent 64-bit codes as bits: all of them are found, of others a share that is small while the filter has room."""

    def __init__(self, codes: DataFrame, n_codes: int):
        """codes(code), counted: the bits are put together on the executors in blocks of 4 KB, of which there are 8192 at most."""
        low, high = FILTER_BITS
        self.power = min(high, max(low, (64 * n_codes - 1).bit_length()))
        slot = F.col("code").bitwiseAND(F.lit((1 << self.power) - 1))
        part = codes.groupBy(F.shiftrightunsigned(slot, 15).alias("block")).agg(F.expr(f"bitmap_construct_agg((code & {(1 << 15) - 1}))").alias("bits"))
        self.bits = np.zeros((1 << self.power) // 8, np.uint8)
        for row in part.collect():
            self.bits[row.block * 4096 : (row.block + 1) * 4096] = np.frombuffer(row.bits, np.uint8)

    def has(self, codes: np.ndarray) -> np.ndarray:
        slots = codes & ((1 << self.power) - 1)
        return (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n, each word once or more."""
    held: dict[bytes, Counter] = {}
    for batch in batches:
        for lang, text in zip(raw_texts(batch, "lang"), raw_texts(batch), strict=True):
            counts = held.setdefault(lang, Counter())
            for block in blocks(text):
                counts.update(_WORD.findall(block.lower()))
                if sum(map(len, held.values())) > HELD:
                    yield from _words(held)
                    held = {lang: (counts := Counter())}
    yield from _words(held)


def _words(held: dict[bytes, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        if counts:
            words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.binary()).cast(pa.string()), words, pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])


class Numbers(dict):
    """The number of each word of a language; 0 for words that aren't frequent and for ends of pieces. A block's new words are looked up together."""

    def __init__(self, start: int, codes: np.ndarray):
        super().__init__()
        self.start, self.codes = start, codes
        self.asked: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        self.asked.append(token)
        self[token] = made = -len(self.asked)
        return made

    def of(self, block: bytes) -> np.ndarray:
        tokens = _WORD_OR_END.findall(block.lower())
        made = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.asked:
            codes = np.array([xxhash.xxh64_intdigest(t, self.start) for t in self.asked], np.uint64).view(np.int64)
            new = np.where([t[0] in _END for t in self.asked], 0, _places(self.codes, codes))
            made[made < 0] = new[-1 - made[made < 0]]
            self.update(zip(self.asked, new.tolist(), strict=True))
            for token in self.asked:
                if len(token) > CACHED_LENGTH:
                    del self[token]
            self.asked.clear()
            if len(self) > CACHED_WORDS:
                frequent = {t: n for t, n in self.items() if n}
                self.clear()
                if 2 * len(frequent) < CACHED_WORDS:
                    self.update(frequent)
        return made.astype(np.int32)


def _places(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted code is among sorted codes, from 1; 0 if it isn't."""
    if not len(codes):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at + 1, 0)


def number_words(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """The frequent words with their numbers as codes."""
    for batch in batches:
        made = _places(known.value, column(batch, "code").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in ("lang", "word", "n")], pa.array(made, pa.int64())], ["lang", "word", "n", "code"])


def encode_batches(batches: Iterator[pa.RecordBatch], seed: int, known) -> Iterator[pa.RecordBatch]:
    """A row of numbers for each text: those of frequent words in order, 0 for any other word and for the end of a piece or text."""
    langs: dict[bytes, Numbers] = {}
    for batch in batches:
        rows = []
        for lang, text in zip(raw_texts(batch, "lang"), raw_texts(batch), strict=True):
            if lang not in langs:
                if len(langs) >= 8:
                    langs.clear()
                langs[lang] = Numbers(_start(seed, lang), known.value)
            rows.append(np.concatenate([*map(langs[lang].of, blocks(text)), np.zeros(1, np.int32)]))
        lengths = np.cumsum([0, *map(len, rows)])
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.LargeListArray.from_arrays(pa.array(lengths, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int32()))], ["codes"])


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "codes").flatten().to_numpy(zero_copy_only=False)


def _pair_keys(numbers: np.ndarray) -> np.ndarray:
    """Both numbers of each pair of neighbours in one; 0 where either is 0."""
    first, second = numbers[:-1].astype(np.int64), numbers[1:].astype(np.int64)
    return np.where((first != 0) & (second != 0), first << 32 | second, 0)


def _marks(keys: np.ndarray) -> np.ndarray:
    """Keys with their bits spread; 0 stays 0."""
    return mix(keys.view(np.uint64)).view(np.int64)


def _grams(numbers: np.ndarray, known: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Places and codes of the runs of len(known) + 2 words whose shorter runs may all be frequent, and the places of these by length.

    The code of a pair is its key; a longer run's is made of the codes of the two runs in it, and two runs may share one.
    """
    keys = _pair_keys(numbers)
    at = np.flatnonzero(keys)
    codes = keys[at]
    passed = []
    for level, frequent in enumerate(known):
        marks = codes if level else _marks(codes)
        likely = frequent.value.has(marks)
        at, marks = at[likely], marks[likely].view(np.uint64)
        passed.append(at)
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, codes = at[both], mix(mix(marks[both]) * np.uint64(0xFF51AFD7ED558CCD) + marks[both + 1]).view(np.int64)
    return at, codes, passed


def count_grams(batches: Iterator[pa.RecordBatch], known: list) -> Iterator[pa.RecordBatch]:
    """code, n of the runs of len(known) + 2 words whose shorter runs may all be frequent, each code once or more."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(_grams(_flat(batch), known)[1])
        size += len(held[-1])
        if size > HELD_CODES:
            yield _counted(held)
            held, size = [], 0
    if size:
        yield _counted(held)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    codes, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["code", "n"])


def mark_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_marks(column(batch, "code").to_numpy(zero_copy_only=False)))], ["code"])


def project_batches(batches: Iterator[pa.RecordBatch], longest: int, known: list) -> Iterator[pa.RecordBatch]:
    """Every occurrence of 3 words that may be a frequent phrase, with what follows it up to `longest` words while the whole may be; equal ones are counted."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        numbers = _flat(batch)
        last, _, passed = _grams(numbers, known)
        starts, *longer = [*passed[1:], last]  # of 3 words, of 4, and so on: each within the one before
        window = np.zeros((len(starts), longest + 1), np.int64)
        for k in range(3):
            window[:, k] = numbers[starts + k]
        for k, at in enumerate(longer, 3):
            window[np.searchsorted(starts, at), k] = numbers[at + k]
        window[:, longest] = 1
        held.append(window)
        size += len(starts)
        if size > HELD:
            yield _projected(held, longest)
            held, size = [], 0
    if size:
        yield _projected(held, longest)


def _projected(held: list[np.ndarray], longest: int) -> pa.RecordBatch:
    rows = np.concatenate(held)
    marks = np.zeros(len(rows), np.uint64)
    for k in range(longest):
        marks = mix(marks * np.uint64(0xFF51AFD7ED558CCD) + rows[:, k].view(np.uint64))
    rows = rows[np.argsort(marks, kind="stable")]
    starts = np.flatnonzero(np.r_[True, (rows[1:, :longest] != rows[:-1, :longest]).any(axis=1)])
    n = np.add.reduceat(rows[:, longest], starts)
    return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(rows[starts, k])) for k in range(longest)], pa.array(n)], [*_columns(longest), "n"])


def _columns(longest: int) -> list[str]:
    return [f"w{k}" for k in range(1, longest + 1)]


def grow_batches(batches: Iterator[pa.RecordBatch], longest: int, least: int, held: int = TASK_ROWS) -> Iterator[pa.RecordBatch]:
    """codes, n of the phrases of 2 or more words in a task's ordered occurrences, which are taken `held` or more at once, so memory is bounded however many there are."""
    parts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        parts.append(np.column_stack([column(batch, c).to_numpy(zero_copy_only=False) for c in [*_columns(longest), "n"]]))
        size += len(parts[-1])
        if size >= held:
            yield _grown(np.concatenate(parts), longest, least)
            parts, size = [], 0
    if size:
        yield _grown(np.concatenate(parts), longest, least)


def _grown(rows: np.ndarray, longest: int, least: int) -> pa.RecordBatch:
    """The phrases of a slice of all occurrences in order.

    The occurrences of a prefix are a slice of it. Each frequent prefix is extended to the right, depth first, within its own slice. A prefix that reaches
    either end of the whole slice may go on in the next: it is given out with what it has here, whatever that is.
    """
    words, weights, size = [np.ascontiguousarray(rows[:, k]) for k in range(longest)], np.ascontiguousarray(rows[:, longest]), len(rows)
    found: list[list[int]] = []
    counts: list[int] = []

    def grow(prefix: list[int], low: int, high: int) -> None:
        own = words[len(prefix)][low:high]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        n = np.add.reduceat(weights[low:high], starts)
        ends = np.r_[starts[1:], high - low]
        for i in np.flatnonzero((own[starts] != 0) & ((n >= least) | (starts + low == 0) | (ends + low == size))):
            phrase = [*prefix, int(own[starts[i]])]
            if len(phrase) > 1:
                found.append(phrase)
                counts.append(int(n[i]))
            if len(phrase) < longest:
                grow(phrase, low + int(starts[i]), low + int(ends[i]))

    grow([], 0, size)
    return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["codes", "n"])


class Mined:
    """words(lang, word, n, code), frequent phrases(codes, a) of 2 or more words, and the number of words of each lang; staged."""

    def __init__(self, docs: DataFrame, least: int, longest: int):
        spark = docs.sparkSession
        bound_batches(spark)
        space = Workspace(spark, "phrases")
        rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
        counted = rows.mapInArrow(remote(__name__, "count_words"), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counted = space.stage(counted, "words")
        seed = 0
        while True:
            coded = counted.withColumn("code", word_code(seed, F.col("lang"), F.col("word")))
            clash = coded.groupBy("code").agg(F.count("*").alias("n_words"), F.sum("n").alias("n")).filter((F.col("n") >= least) & ((F.col("n_words") > 1) | (F.col("code") == 0)))
            if clash.isEmpty():
                break
            seed += 1  # two words with one code would be counted as one: take other codes
        self.totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        frequent = space.stage(coded.filter(F.col("n") >= least), "frequent")
        known = spark.sparkContext.broadcast(np.sort(frequent.select("code").toArrow().column("code").to_numpy()))
        self.words = space.stage(frequent.mapInArrow(remote(__name__, "number_words", known), "lang string, word string, n long, code long"), "numbered")
        encoded = space.stage(rows.mapInArrow(remote(__name__, "encode_batches", seed, known), "codes array<int>"), "codes")
        levels: list = []
        for size in range(2, max(longest, 3)):
            grams = encoded.mapInArrow(remote(__name__, "count_grams", [*levels]), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            grams = space.stage(grams, f"runs-{size}")
            n_grams = grams.count()
            if size == 2:
                pairs = grams.select(F.array(F.shiftright("code", 32), F.col("code").bitwiseAND(F.lit((1 << 32) - 1))).alias("codes"), F.col("n").alias("a"))
                grams = grams.mapInArrow(remote(__name__, "mark_pairs"), "code long")
            levels.append(spark.sparkContext.broadcast(BitFilter(grams.select("code"), n_grams)))
            if not n_grams:
                break
        found = pairs
        if longest > 2:
            columns = _columns(longest)
            windows = encoded.mapInArrow(remote(__name__, "project_batches", longest, levels), ", ".join(f"{c} long" for c in [*columns, "n"]))
            windows = space.stage(windows, "occurrences")
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows.count() // TASK_ROWS))
            grown = windows.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns).mapInArrow(remote(__name__, "grow_batches", longest, least), "codes array<long>, n long")
            grown = grown.filter(F.size("codes") > 2)  # a pair is projected only where a third word follows
            found = pairs.unionByName(grown.groupBy("codes").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
        self.phrases = space.stage(found, "phrases")
        space.drop(frequent, encoded)
        for sent in (known, *levels):
            sent.unpersist()


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, covered_percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of docs(text, lang).

    A-Z are lower-cased, texts cut into pieces at `.,;:!?` and U+000A to U+000D and these into words at spaces and tabs. n is the number of words of
    the language, a, l and r how often the phrase and the two parts of a cut stand within pieces. The score of a phrase is its least
    floor(1000 a n / (l r)) over all cuts, the first such cut counting; products are decimals of 38 digits. Phrases of 2 to `longest` words with a >= least
    are candidates; those within a longer one that stands covered_percent of a times or more are dropped.

    Words are counted and coded by 64-bit hashes, which are tried anew if two words clash. A frequent word's number is the place of its code among them all,
    and texts become arrays of numbers. Pairs are counted under both numbers, so exactly. Runs of 3 words and more are counted by hashes, length by length, only where
    both runs one shorter are in a filter of bits that all frequent ones are in; these counts only make the next filter, and its false hits cost rows, never results.
    What may be a frequent phrase of 3 words is projected with what follows while that may be one too, equal projections are counted before they move, and they are dealt by ranges of
    prefixes, so a frequent prefix is split over several tasks. Each task grows phrases depth first in slices of its sorted range; what reaches the end
    of a slice is added up over all. Through the driver go the filters' bits (at most 32 MB each) and 8 bytes for each frequent word.

    A null or empty text has no words, a null lang counts as `und`, repeated rows count each, other columns are ignored; an empty table gives no rows.
    """
    mined = Mined(docs, least, longest)
    size = F.size("codes")
    counts = mined.phrases.unionByName(mined.words.select(F.array("code").alias("codes"), F.col("n").alias("a")))
    langs = mined.words.select(F.col("code").alias("first_code"), "lang").join(mined.totals, "lang")
    phrases = mined.phrases.join(langs, F.col("codes")[0] == F.col("first_code")).select("lang", "codes", "a", "n")
    # f does not grow with length, so a longer phrase covers a phrase only if one longer by a word does
    ends = F.explode(F.array(F.slice("codes", 1, size - 1), F.slice("codes", 2, size - 1)))
    longer = mined.phrases.filter(size > 2).select(ends.alias("codes"), F.col("a").alias("covers")).groupBy("codes").agg(F.max("covers").alias("covers"))
    free = phrases.join(longer, "codes", "left").filter(F.col("covers").isNull() | (100 * F.col("covers") < covered_percent * F.col("a"))).drop("covers")
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("left", F.slice("codes", F.lit(1), F.col("k"))).withColumn("right", F.slice("codes", F.col("k") + 1, size - F.col("k")))
    for part, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select(F.col("codes").alias(part), F.col("a").alias(count)), part)
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "codes", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "codes", "a", "n", "cut.score", "cut.l", "cut.r")
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    first = best.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top).drop("place")  # their spelling decides only among ties
    spelled = first.select("*", F.posexplode("codes").alias("at", "code")).join(mined.words.select("code", "word"), "code")
    whole = spelled.groupBy("lang", "codes", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = whole.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))).filter(F.col("place") <= top)
    return ranked.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x != '') as words from pieces),
totals as (select lang, cast(sum(len(words)) as bigint) as n from w group by 1),
starts as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
grams as (select lang, k, words[i:i + k - 1] as gram from starts, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(words)),
f as (select lang, k, gram, count(*) as a from grams group by 1, 2, 3 having count(*) >= 100),
cuts as (select f.lang, f.gram, f.a, x.k as cut, f.gram[1:x.k] as part, f.gram[x.k + 1:f.k] as rest from f, (select unnest(range(1, 5)) as k) x where x.k < f.k),
scored as (
    select c.lang, c.gram, c.a, c.cut, p.a as l, q.a as r, t.n, cast((1000 * cast(c.a as hugeint) * t.n) // (cast(p.a as hugeint) * q.a) as bigint) as score
    from cuts c join f p on p.lang = c.lang and p.gram = c.part join f q on q.lang = c.lang and q.gram = c.rest join totals t on t.lang = c.lang),
best as (select * from (select *, row_number() over (partition by lang, gram order by score, cut) as place from scored) where place = 1),
free as (
    select b.* from best b where not exists (
        select 1 from f where f.lang = b.lang and f.k > len(b.gram) and 100 * f.a >= 100 * b.a
        and contains(' ' || array_to_string(f.gram, ' ') || ' ', ' ' || array_to_string(b.gram, ' ') || ' '))),
ranked as (select lang, array_to_string(gram, ' ') as phrase, a, l, r, n, score, row_number() over (partition by lang order by score desc, a desc, array_to_string(gram, ' ')) as rank from free)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""
