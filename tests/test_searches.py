"""Vector index, overlap join, text ranking and row patterns against plain computations, on what the supplied tables don't have."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tarnlight.operators import patterns, ranking, vectors
from tarnlight.operators.intervals import overlap_join, overlap_totals
from tarnlight.operators.patterns import match_rows
from tarnlight.operators.ranking import TextIndex
from tarnlight.operators.vectors import VectorIndex, nearest
from tarnlight.plans.searches import QUERIES
from tarnlight.plans.texts import QUERIES as TEXTS

T0 = datetime(2024, 1, 1)
LARGE = "/root/testdata/sf0.1"


def plain_nearest(rows, queries, k):
    found = Counter()
    for q, x in queries:
        scores = sorted((-round(float(np.dot(x, v)), 6), i) for i, v in rows if i != q)
        found.update((q, i, -s + 0.0, place) for place, (s, i) in enumerate(scores[:k], 1))
    return found


def vector_rows():
    """A vector that a third of the rows have, ties, and rows that nothing is near."""
    rng = np.random.default_rng(3)
    hot = np.round(rng.normal(size=8), 2).tolist()
    rows = [(i, hot) for i in range(0, 600, 3)] + [(i, np.round(rng.normal(size=8) + 3 * (i % 4), 2).tolist()) for i in range(1, 600, 3)]
    rows += [(1000 + i, [0.0] * 8) for i in range(5)]
    bad = [(None, hot), (2000, None), (2001, [1.0]), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [])]
    return rows, bad


def test_vector_search_equals_all_products(spark, tmp_path, monkeypatch):
    rows, bad = vector_rows()
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4)
    index = VectorIndex.build(table, str(tmp_path / "index"), cells=12, copies=6)
    assert index.sizes.sum() == 202 and len(index.centres) == 12
    assert sum(len(r.ids) for r in spark.read.parquet(str(tmp_path / "index/rows")).collect()) == 6 + 200 + 5
    queries = [(i, v) for i, v in rows if i % 7 == 0] + [(-1, rows[0][1])]
    asked = spark.createDataFrame([*queries, (-2, None), (-3, [1.0]), (None, rows[0][1])], "query_id long, query array<double>")
    for block in (4096, 16):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
        monkeypatch.setattr(vectors, "BLOCK_QUERIES", block)
        for k in (1, 5):
            found = VectorIndex.open(spark, str(tmp_path / "index")).search(asked, k, probes=2, exact=True)
            assert Counter(map(tuple, found.collect())) == plain_nearest(rows, queries, k)
    with pytest.raises(ValueError, match="keeps 6 ids"):
        index.search(asked, 6)


def test_comparing_all_vectors_makes_no_row_of_a_pair(spark, tmp_path, monkeypatch):
    rows, bad = vector_rows()
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4)
    queries = [(i, v) for i, v in rows if i % 7 == 0] + [(-1, rows[0][1])]
    asked = spark.createDataFrame([*queries, (-2, None), (-3, [1.0, 2.0]), (None, rows[0][1])], "query_id long, query array<double>")
    for part, block in ((16_384, 4096), (50, 16)):
        for name, size in (("PART_ROWS", part), ("PART_QUERIES", part), ("BLOCK_ROWS", block), ("BLOCK_QUERIES", block)):
            monkeypatch.setattr(vectors, name, size)
        want = Counter((q, i, s) for q, i, s, _ in plain_nearest(rows, queries, 1))
        assert Counter(map(tuple, nearest(table, asked).collect())) == want
    assert nearest(table.limit(0), asked).count() == 0 and nearest(table, asked.limit(0)).count() == 0
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = TEXTS["nearest_vectors"][0](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() and "NestedLoop" not in plan and "Cartesian" not in plan


def test_vector_index_of_no_rows_and_of_one(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")
    assert VectorIndex.build(spark.createDataFrame([], schema), str(tmp_path / "none")).search(asked).count() == 0
    one = VectorIndex.build(spark.createDataFrame([(1, [1.0])], schema), str(tmp_path / "one"))
    assert one.search(asked, exact=True).count() == 0
    assert one.search(asked.limit(0)).count() == 0


@pytest.mark.skipif(not Path(LARGE).exists(), reason="needs the supplied tables")
def test_probing_half_of_the_cells_finds_nine_of_ten(spark, tmp_path):
    rows = spark.read.parquet(f"{LARGE}/embeddings.parquet")
    index = VectorIndex.build(rows, str(tmp_path / "index"))
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near, exact = index.search(asked, 3), index.search(asked, 3, exact=True)
    pairs = {(r.query_id, r.vec_id) for r in near.collect()}
    truth = {(r.query_id, r.vec_id) for r in exact.collect()}
    some = [(r.vec_id, np.array(r.embedding, np.float64)) for r in rows.collect()]
    brute = plain_nearest(some, [x for x in some if x[0] % 50 == 0], 3)
    assert {(q, i) for q, i in truth if q % 50 == 0} == {(q, i) for q, i, _, _ in brute}
    recall = len(pairs & truth) / len(truth)
    print(f"recall {recall:.3f}")
    assert recall >= 0.9
    plan = exact._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_probing_few_cells_is_enough_with_clusters(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 4
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(table, str(tmp_path / "index"))
    queries = [r for r in rows if r[0] % 10 == 0]
    asked = spark.createDataFrame(queries, "query_id long, query array<double>")
    found = {(r.query_id, r.vec_id) for r in index.search(asked, 1, probes=len(index.centres) // 8).collect()}
    truth = {(q, i) for q, i, _, _ in plain_nearest(rows, queries, 1)}
    assert len(found & truth) >= 0.95 * len(truth)


def plain_overlaps(left, right):
    return Counter((a[0], b[0]) for a in left for b in right if a[1] is not None and a[1] == b[1] and None not in (*a[2:], *b[2:]) and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])


@pytest.mark.parametrize("finest", [0, 12])
def test_overlaps_of_all_lengths(spark, finest):
    rng = random.Random(finest)

    def side(n):
        out = []
        for i in range(n):
            low = rng.randrange(-(2**20), 2**20)
            out.append((i, rng.choice(["hot", "hot", "b", None]), low, low + rng.choice([0, 1, 2, 3, 7, 64, 1000, 2**15, 2**20, 2**40, -5])))
        return [*out, (n, "hot", None, 5), (n + 1, "hot", 5, None), (0, "hot", -3, 3), (0, "hot", -3, 3), (n + 2, "b", -(2**60), 2**60)]

    left, right = side(150), side(170)
    ours = spark.createDataFrame(left, "i long, k string, s long, e long").repartition(3)
    theirs = spark.createDataFrame(right, "j long, k string, rs long, re long").repartition(3)
    found = overlap_join(ours, theirs, ("s", "e"), ("rs", "re"), ["k"], finest)
    assert found.columns == ["i", "k", "s", "e", "j", "rs", "re"]
    assert Counter((r.i, r.j) for r in found.collect()) == plain_overlaps(left, right)
    alone = overlap_join(ours.drop("k"), theirs.drop("k"), ("s", "e"), ("rs", "re"), (), finest)
    assert Counter((r.i, r.j) for r in alone.collect()) == plain_overlaps([(i, 1, s, e) for i, _, s, e in left], [(i, 1, s, e) for i, _, s, e in right])
    assert overlap_join(ours.limit(0), theirs, ("s", "e"), ("rs", "re"), ["k"]).count() == 0
    assert overlap_join(ours, theirs.limit(0), ("s", "e"), ("rs", "re"), ["k"]).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_of_dates_and_times(spark):
    days = spark.createDataFrame([(1, date(1950, 1, 1), date(2030, 1, 1)), (2, date(2024, 1, 1), date(2024, 1, 2))], "i int, s date, e date")
    other = spark.createDataFrame([(1, date(2024, 1, 2), date(2024, 1, 9)), (2, date(1949, 1, 1), date(1950, 1, 2))], "j int, rs date, re date")
    assert sorted((r.i, r.j) for r in overlap_join(days, other, ("s", "e"), ("rs", "re")).collect()) == [(1, 1), (1, 2)]
    times = spark.createDataFrame([(1, T0, T0 + timedelta(microseconds=1))], "i int, s timestamp_ntz, e timestamp_ntz")
    more = spark.createDataFrame([(1, T0 + timedelta(microseconds=1), T0 + timedelta(days=1)), (2, T0, T0 + timedelta(days=400))], "j int, rs timestamp, re timestamp")
    assert [(r.i, r.j) for r in overlap_join(times, more, ("s", "e"), ("rs", "re")).collect()] == [(1, 2)]
    with pytest.raises(TypeError, match="double"):
        overlap_join(spark.createDataFrame([(1.0, 2.0)], "s double, e double"), other, ("s", "e"), ("rs", "re"))


@pytest.mark.parametrize("slot", [1, 7, 1000])
def test_totals_of_overlaps_equal_the_sums_over_all_pairs(spark, slot):
    rng = random.Random(slot)

    def side(n):
        out = []
        for i in range(n):
            low = rng.choice([None, *range(-40, 60)])
            out.append((i % 90, rng.choice(["hot"] * 5 + ["b", None]), low, None if low is None or rng.random() < 0.05 else low + rng.choice([-3, 0, 1, 1, 2, 5, 50])))
        return out

    left, right = side(150), side(140)
    ours = spark.createDataFrame(left, "i int, k string, s long, e long").repartition(3)
    theirs = spark.createDataFrame(right, "j int, k string, rs long, re long").repartition(3)
    for by in ([], ["k"]):
        plain = defaultdict(lambda: [0, 0])
        for a in left:
            for b in right:
                if None not in (*a[2:], *b[2:]) and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3] and (not by or (a[1] is not None and a[1] == b[1])):
                    plain[a[0]] = [plain[a[0]][0] + 1, plain[a[0]][1] + b[0]]
        found = overlap_totals(ours, theirs, ("s", "e"), ("rs", "re"), ["i"], ["j"], by, slot)
        assert {r.i: [r.n, r.j] for r in found.collect()} == plain
    assert overlap_totals(ours.limit(0), theirs, ("s", "e"), ("rs", "re"), ["i"], ["j"]).count() == 0
    assert overlap_totals(ours, theirs.limit(0), ("s", "e"), ("rs", "re"), ["i"], ["j"]).count() == 0


def test_concurrent_sessions_are_counted_without_pairs(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=(i * 7) % 5000), i % 600, ("error", "view")[i % 3 % 2]) for i in range(4000)] + [(9000, T0, None, "error"), (9001, T0 + timedelta(days=1), None, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    query, sql = QUERIES["concurrent_sessions"]
    found = query(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright" not in plan  # the bins in which pairs are made
    duckdb.sql(f"create or replace temp view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = duckdb.sql(sql).fetchall()
    assert len(want) > 1000 and Counter(map(tuple, found.collect())) == Counter(want)


def plain_ranking(docs, queries, k):
    words = regex.compile(r"[\p{L}\p{N}]+")
    bodies = defaultdict(Counter)
    for i, t in docs:
        if i is not None:
            bodies[i].update(words.findall((t or "").lower()))
    mean = max(1, sum(map(Counter.total, bodies.values()))) / max(1, len(bodies))
    df = Counter(t for c in bodies.values() for t in c)
    asked = defaultdict(set)
    for q, t in queries:
        if q is not None:
            asked[q] |= set(words.findall((t or "").lower()))
    out = Counter()
    for q, ts in asked.items():
        scores = []
        for i, c in bodies.items():
            parts = [math.log(1 + (len(bodies) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t in ts if t in c]
            if parts:
                scores.append((-round(sum(round(p, 9) for p in parts), 9), i))
        out.update((q, place, i, round(-s, 6)) for place, (s, i) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_ranking_equals_plain_scores(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", limit)
    rng = random.Random(8)
    bag = ["the"] * 6 + "of Lake été STRASSE 日本 x1 a_b don't river green stone road under quiet".split(" ")
    docs = [(i, " ".join(rng.choice(bag) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs += [(3, "the repeated row"), (3, "the repeated row"), (200, None), (201, ""), (202, "  ?! "), (None, "lake"), (203, docs[0][1]), (204, "zebra " * 3000)]
    queries = [(1, "lake of the Lake"), (2, "zebra"), (3, "unheard"), (4, None), (5, "été x1 日本"), (5, "quiet"), (None, "the"), (6, "THE")]
    index = TextIndex.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), str(tmp_path / "index"))
    asked = spark.createDataFrame(queries, "query_id long, query string")
    for k in (1, 7, 1000):
        assert Counter(map(tuple, index.search(asked, k).collect())) == plain_ranking(docs, queries, k)
    none = TextIndex.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert none.search(asked).count() == 0 and index.search(asked.limit(0)).count() == 0


def test_ranking_reads_the_postings_of_its_terms_alone(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([(i, f"common word{i}") for i in range(50)], "doc_id long, text string"), str(tmp_path / "index"))
    plan = index.search(spark.createDataFrame([(1, "word7")], "query_id long, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [term" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_are_added_up_where_postings_are(spark, tmp_path):
    """What is shuffled is the best of each bucket, not a row for each document of a query."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat('common word', id % 7, ' word', id) as text")
    index = TextIndex.build(docs, str(tmp_path / "index"))
    found = index.search(spark.createDataFrame([(1, "common word3"), (2, "common word5 word9")], "query_id long, query string"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "doc_id" not in plan[plan.index("Exchange hashpartitioning") :].split("\n")[0]
    assert found.count() == 6
    assert not [r for r in spark.sql("show tables").collect() if r.tableName.startswith("tarnlight_")]


def plain_runs(rows, pattern, within, overlapping):
    keys = defaultdict(list)
    for k, t, i, kind in rows:
        if None not in (k, t, i):
            keys[k].append((t, i, kind if kind in ("v", "c", "p") else "_"))
    out = Counter()
    for k, own in keys.items():
        own.sort()
        letters = "".join(x[2] for x in own)
        free = 0
        for at, (t, i, _) in enumerate(own):
            end = sum(x[0] <= t + timedelta(seconds=within) for x in own)
            m = re.compile(pattern).match(letters, at, end)
            if m and m.end() > at and (overlapping or at >= free):
                out[(k, i, own[m.end() - 1][1], t, own[m.end() - 1][0], m.end() - at)] += 1
                free = m.end()
    return out


@pytest.mark.parametrize("overlapping", [True, False])
@pytest.mark.parametrize("pattern", ["v+c+p", "(v|c)*p", "v.c", "[^p]{2,}p?", "p"])
def test_row_patterns_equal_a_plain_walk(spark, pattern, overlapping):
    rng = random.Random(hash(pattern) % 1000)
    rows = [(rng.choice(["hot"] * 4 + ["b", None]), T0 + timedelta(seconds=rng.choice([0, 1, 59, 60, 61]) + 60 * rng.randrange(300)), i, rng.choice(["v", "c", "p", "x", None])) for i in range(500)]
    rows += [("hot", None, 900, "v"), ("hot", T0, None, "v")]
    table = spark.createDataFrame(rows, "k string, at timestamp_ntz, i long, kind string").repartition(3)
    kinds = {x: F.col("kind") == x for x in "vcp"}
    for within, slot in ((60, None), (600, 600), (3600, 86_400), (0, 7)):
        found = match_rows(table, ["k"], "at", "i", kinds, pattern, within, overlapping, slot)
        assert Counter(map(tuple, found.collect())) == plain_runs(rows, pattern, within, overlapping), (within, slot)
    assert match_rows(table.limit(0), ["k"], "at", "i", kinds, pattern, 60, overlapping).count() == 0


def test_many_small_slots_cost_little_more_than_one_large(spark):
    kinds = {"v": F.col("kind") == "v"}
    seconds = []
    for key in ("0L", "id"):
        rows = spark.range(30_000, numPartitions=1).selectExpr(f"{key} as k", "timestamp_seconds(id % 3000) as at", "id as i", "'v' as kind").cache()
        assert rows.count() == 30_000
        for _ in range(2):
            began = time.perf_counter()
            found = match_rows(rows, ["k"], "at", "i", kinds, "v", 60, True, 86_400).agg(F.count("*"), F.sum("n_rows")).first()
            last = time.perf_counter() - began
        assert tuple(found) == (30_000, 30_000)
        seconds.append(last)
    assert seconds[1] < 3 * seconds[0] + 1


def test_kinds_are_letters(spark):
    with pytest.raises(ValueError, match="one letter"):
        match_rows(spark.range(1).selectExpr("id as k", "timestamp_seconds(id) as at", "id as i"), ["k"], "at", "i", {patterns.OTHER: F.lit(True)}, "v", 1)
