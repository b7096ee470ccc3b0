"""Operator 12 against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlight.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, least, longest, top, percent=100):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        kept = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n, -s) for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def awkward():
    rng = random.Random(12)
    words = "the of The OF lake été straße 日本 Éa x \x1c y'z - \x85".split(" ")
    passage = "a passage that stands in very many of the texts here"
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [f"{passage}, {t}" for t in texts[:60]] + [None, "", " ", "...", "\n\n", "a", "same same same " * 900, "x" * 5000, "the of " * 3000]
    rows = [(t, [None, "en", "de", "und"][i % 4]) for i, t in enumerate(texts)]
    return rows + rows[:3] * 4


@pytest.mark.parametrize(("least", "longest", "top", "percent"), [(5, 5, 2000, 100), (12, 3, 7, 60), (10_000_000, 5, 9, 100)])
def test_collocations_equal_plain_counts(spark, least, longest, top, percent):
    rows = awkward()
    docs = spark.createDataFrame([(t, g, 1, "x", None) for t, g in rows], "text string, lang string, n long, code string, word string").repartition(3)
    out = phrases.collocations(docs, least, longest, top, percent)
    assert tuple(out.columns) == COLUMNS
    assert Counter(map(tuple, out.collect())) == plain(rows, least, longest, top, percent)


def test_an_empty_table_gives_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_prefixes_split_over_tasks_are_added_up():
    """Sorted occurrences cut at every place: what the tasks give out adds up to the whole."""
    rng = random.Random(5)
    rows = sorted([*[rng.choice([1, 1, 1, 2]) for _ in range(2)], *[rng.choice([0, 1, 2]) for _ in range(2)]] for _ in range(60))
    rows = [[*r[:3], r[3] if r[2] else 0] for r in rows]
    rows.sort()
    expect = Counter(tuple(r[:k]) for r in rows for k in (2, 3, 4) if r[k - 1])
    expect = {p: n for p, n in expect.items() if n >= 4}

    def grown(part):
        columns = [pa.array(np.array(c, np.int64)) for c in zip(*part, strict=True)] + [pa.array([1] * len(part), pa.int64())]
        batch = pa.RecordBatch.from_arrays(columns, ["w1", "w2", "w3", "w4", "n"])
        return [(tuple(r["codes"]), r["n"]) for b in phrases.grow_batches(iter([batch]), 4, 4) for r in b.to_pylist()]

    def batches():
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in [*r, 1]], ["w1", "w2", "w3", "w4", "n"])

    total = Counter()
    for b in phrases.grow_batches(batches(), 4, 4, held=7):
        for r in b.to_pylist():
            total[tuple(r["codes"])] += r["n"]
    assert {p: n for p, n in total.items() if n >= 4} == expect
    for cuts in [(), (1,), (13, 14), (20, 40), tuple(range(1, 60))]:
        total = Counter()
        for low, high in zip((0, *cuts), (*cuts, 60), strict=True):
            for p, n in grown(rows[low:high]):
                total[p] += n
        assert {p: n for p, n in total.items() if n >= 4} == expect


def test_codes_are_the_same_in_both_languages(spark):
    words = ["the", "été", "日本", "\x85"]
    made = [r.code for r in spark.createDataFrame([("de", w) for w in words], "lang string, word string").select(phrases.word_code(3, F.col("lang"), F.col("word")).alias("code")).collect()]
    start = phrases._start(3, b"de")
    assert made == [int(np.array([phrases.xxhash.xxh64_intdigest(w.encode(), start)], np.uint64).view(np.int64)[0]) for w in words]


def test_filters_hold_all_their_codes(spark):
    codes = [r.code for r in spark.range(3000).select(F.xxhash64("id").alias("code")).collect()]
    some = phrases.BitFilter(spark.range(3000).select(F.xxhash64("id").alias("code")), 3000)
    others = np.array([r.code for r in spark.range(3000, 6000).select(F.xxhash64("id").alias("code")).collect()], np.int64)
    assert some.has(np.array(codes, np.int64)).all() and some.has(others).mean() < 0.05
    assert not phrases.BitFilter(spark.range(0).select(F.xxhash64("id").alias("code")), 0).has(others).any()


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = [(a := rng.randrange(100, 10**12), rng.randrange(a, 10**15), rng.randrange(a, 10**14), rng.randrange(a, 10**14)) for _ in range(200)]
    found = [r.score for r in spark.createDataFrame(rows, "a long, n long, l long, r long").coalesce(1).select(F.expr(phrases.SCORE).alias("score")).collect()]
    assert found == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_the_query_equals_its_sql_with_more_phrases(spark):
    """At a lower least count than the contract's, so that the supplied table has phrases of all lengths."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    sql = phrases.SQL.replace(">= 100)", ">= 20)")
    assert sql != phrases.SQL
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    ours = Counter(map(tuple, phrases.collocations(docs, 20).select(*names).collect()))
    assert ours == Counter(theirs.fetchall()) and sum(ours.values()) > 500


def test_places_without_a_frequent_run_of_three_are_not_projected(spark, monkeypatch):
    """All pairs are frequent and few longer runs are: those few are projected, not every place with its tail."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(" ".join(rng.choices(words, k=300)) + (". one phrase of six words here" if i % 2 else ""), "en") for i in range(100)]
    staged, stage = {}, phrases.Workspace.stage

    def counted(self, frame, name, *args):
        made = stage(self, frame, name, *args)
        staged[name] = made.count()
        return made

    monkeypatch.setattr(phrases.Workspace, "stage", counted)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    out = phrases.collocations(docs, 50)
    assert Counter(map(tuple, out.collect())) == plain(rows, 50, 5, 2000)
    assert 0 < staged["occurrences"] <= 2 * 4


def test_numbers_are_the_same_however_little_is_kept(monkeypatch):
    """Words are numbered alike when all are forgotten, only frequent ones are kept, or none is."""
    text = b"The lake. the LAKE, of lake;; " + b"y" * 80 + b" of rare the " + b"y" * 80
    start = phrases._start(0, b"en")
    of = {w: np.array([phrases.xxhash.xxh64_intdigest(w, start)], np.uint64).view(np.int64)[0] for w in (b"the", b"lake", b"y" * 80)}
    codes = np.sort(np.array([*of.values()]))
    the, lake, long = (int(np.searchsorted(codes, of[w])) + 1 for w in of)
    for kept in (0, 3, 4, 400_000):
        monkeypatch.setattr(phrases, "CACHED_WORDS", kept)
        numbers = phrases.Numbers(start, codes)
        for _ in range(3):
            assert numbers.of(text).tolist() == [the, lake, 0, the, lake, 0, 0, lake, 0, long, 0, 0, the, long]
    assert phrases.Numbers(start, codes[:0]).of(text).tolist() == [0] * 14


def test_pairs_and_longer_runs_are_counted_where_all_their_parts_are_frequent(spark):
    """Against plain counting, with numbers beyond 16 bits and texts over several batches."""
    rng = random.Random(8)
    texts = [[rng.choice([0, 1, 2, 70_000, 2**31 - 1]) for _ in range(200)] + [0] for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.int32()))], ["codes"]) for part in (texts[:7], texts[7:])]
    runs = {k: Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1) if all(t[i : i + k])) for k in (2, 3, 4)}
    pairs = {(c >> 32, c & 0xFFFFFFFF): n for b in phrases.count_grams(iter(batches), []) for c, n in zip(b["code"].to_pylist(), b["n"].to_pylist(), strict=True)}
    assert pairs == runs[2]
    likely = [p for p, n in pairs.items() if n >= 320]
    assert 0 < len(likely) < len(pairs)
    marks = phrases._marks(np.array([a << 32 | b for a, b in likely]))
    found = phrases.BitFilter(spark.createDataFrame([(int(m),) for m in marks], "code long"), len(likely))
    known = [type("Sent", (), {"value": found})]
    triples = sorted(n for b in phrases.count_grams(iter(batches), known) for n in b["n"].to_pylist())
    assert triples == sorted(n for r, n in runs[3].items() if found.has(phrases._marks(np.array([r[0] << 32 | r[1]])))[0] and found.has(phrases._marks(np.array([r[1] << 32 | r[2]])))[0])
