"""Clustered tables, sketches, table functions, recursion and variants on what the supplied tables don't have."""

import random
import time
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnlight.functions import sketches, tables, variants
from tarnlight.operators.fixpoint import reachable
from tarnlight.scratch import Scratch
from tarnlight.sources.layout import ClusteredTable, interleaved

T0 = datetime(2024, 1, 1)


def test_places_interleave_bits(spark):
    rows = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    found = {(r.a, r.b): r.z for r in rows.select("a", "b", interleaved([F.col("a"), F.col("b")], 2).alias("z")).collect()}
    assert found == {(a, b): (a >> 1) << 3 | (b >> 1) << 2 | (a & 1) << 1 | (b & 1) for a in range(4) for b in range(4)}


def clustered_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(1000)]), T0 + timedelta(hours=rng.randrange(5000)), rng.choice(["ash", "birch", "fir", "oak", None]), date(2024, 1, 1) + timedelta(days=i % 50)) for i in range(4000)]
    return rows + [(9999, 500, T0, "oak", date(2024, 1, 1))] * 500


def test_clustered_tables_read_few_files(spark, tmp_path):
    rows = clustered_rows()
    frame = spark.createDataFrame(rows, "id int, n int, at timestamp_ntz, tree string, day date").repartition(4)
    written = ClusteredTable.write(frame, str(tmp_path / "t"), ["n", "at"], 24)
    files = spark.read.parquet(str(tmp_path / "t/files")).count()
    assert files >= 20
    for ranges in ({"n": (100, 180), "at": (T0 + timedelta(days=20), T0 + timedelta(days=60))}, {"n": (500, 500)}, {"at": (None, T0 + timedelta(days=9))}, {"n": (2000, None)}, {}):
        read = ClusteredTable.open(spark, str(tmp_path / "t")).read(ranges)
        place = {"n": 1, "at": 2}
        expect = Counter(r for r in rows if all(r[place[c]] is not None and (low is None or r[place[c]] >= low) and (high is None or r[place[c]] <= high) for c, (low, high) in ranges.items()))
        assert Counter(map(tuple, read.collect())) == expect
        if len(ranges) == 2:
            assert 0 < len(read.inputFiles()) <= files / 3
        elif "n" in ranges and ranges["n"][0] == 2000:
            assert not read.inputFiles()
    with pytest.raises(ValueError, match="not one of"):
        written.read({"tree": ("a", "b")})
    other = ClusteredTable.write(frame, str(tmp_path / "u"), ["tree", "day"], 16)
    found = other.read({"tree": ("ash", "birch"), "day": (date(2024, 1, 5), date(2024, 1, 9))})
    assert Counter(map(tuple, found.collect())) == Counter(r for r in rows if r[3] in ("ash", "birch") and date(2024, 1, 5) <= r[4] <= date(2024, 1, 9))
    empty = ClusteredTable.write(frame.limit(0), str(tmp_path / "e"), ["n"], 4)
    assert empty.read({"n": (1, 2)}).count() == 0


def test_sketches_of_any_range_keep_their_bounds(spark):
    rng = random.Random(1)
    rows = [(T0 + timedelta(minutes=rng.randrange(60 * 24 * 6)), rng.choice([None, *[rng.gauss(0, 50) for _ in range(8)]]), rng.choice([None, rng.randrange(3000)])) for _ in range(30_000)] + [(None, 1.0, 1)]
    frame = spark.createDataFrame(rows, "ts timestamp, value double, user_id long")
    states = sketches.hourly_states(frame, "ts", "value", "user_id").cache()
    spans = [(i, T0 + timedelta(hours=low), T0 + timedelta(hours=low + n)) for i, (low, n) in enumerate([(0, 1), (5, 30), (0, 144), (100, 500), (23, 2), (3, 0), (900, 4)])]
    found = {r.range_id: r for r in sketches.combined(states, spark.createDataFrame(spans, "range_id int, low timestamp, high timestamp"), [0.1, 0.5, 0.99]).collect()}
    assert set(found) == {0, 1, 2, 3, 4}
    for i, low, high in spans[:5]:
        own = [r for r in rows if r[0] is not None and low <= r[0] < high]
        values = sorted(r[1] for r in own if r[1] is not None)
        assert found[i].n_rows == len(own)
        for q, value in zip((0.1, 0.5, 0.99), found[i].quantiles, strict=True):
            assert sum(v < value for v in values) <= (q + 2 * sketches.RANK_ERROR) * len(values) + 1
            assert sum(v <= value for v in values) >= (q - 2 * sketches.RANK_ERROR) * len(values) - 1
        users = len({r[2] for r in own if r[2] is not None})
        assert abs(found[i].about_n_keys - users) <= sketches.DISTINCT_ERROR * users + 1
    states.unpersist()


def test_links_of_odd_pages(spark):
    html = '<p><A HREF="/x?a=1&amp;b=2">One <b>two</b></A><a>none</a><a href=\'/y\'>&lt;y&gt;</a><script>"<a href=\'/no\'>"</script><!-- <a href="/c">c</a> --><a href="/x?a=1&amp;b=2">again'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<a href>e</a>"), (4, '<a href="/y">y</a>')], "page_id long, html string")
    links = tables.page_links(pages)
    assert sorted(map(tuple, links.collect())) == [(1, 0, "/x?a=1&b=2", "One two"), (1, 1, "/y", "<y>"), (1, 2, "/x?a=1&b=2", "again"), (4, 0, "/y", "y")]
    assert sorted(map(tuple, tables.link_order(links).collect())) == [("/x?a=1&b=2", 1, 0), ("/y", 1, 0), ("/y", 4, 1)]
    assert tables.page_links(pages.limit(0)).count() == 0


def plain_hops(seeds, edges):
    found = {s: 0 for s in seeds if s is not None}
    front, hops = set(found), 0
    while front:
        hops += 1
        front = {b for a, b in edges if a in front and b is not None} - found.keys()
        found.update(dict.fromkeys(front, hops))
    return found


def test_recursion_equals_a_plain_search(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(5, 5), (1, None), (None, 1), (7, 8), (8, 7), (7, 8)]
    seeds = [1, 7, 7, None, 999]
    got = reachable(spark.createDataFrame([(s,) for s in seeds], "node int"), spark.createDataFrame(edges, "src int, dst int"))
    rows = got.collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.hops for r in rows} == plain_hops(seeds, edges)
    assert reachable(spark.createDataFrame([], "node int"), spark.createDataFrame(edges, "src int, dst int")).count() == 0
    assert reachable(spark.createDataFrame([(3,)], "node int"), spark.createDataFrame([], "src int, dst int")).count() == 1


def test_a_round_of_recursion_shuffles_what_it_found_alone(spark, monkeypatch):
    """Neither the edges nor what has been reached is shuffled once more in each round."""
    plans = []
    deal = Scratch.deal

    def kept(self, frame, name, by, parts):
        if name.startswith("delta-") and name != "delta-0":
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return deal(self, frame, name, by, parts)

    monkeypatch.setattr(Scratch, "deal", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(3000).selectExpr("id % 1000 as src", "(id * 7 + 1) % 1000 as dst")
        found = reachable(spark.range(2).select(F.col("id").alias("node")), edges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.count() == found.select("node").distinct().count() > 10
    assert plans[0].count("Exchange hashpartitioning") == 1  # what was found, by node
    names = [r.tableName for r in spark.sql("show tables").collect()]
    assert not [n for n in names if n.startswith("tarnlight_")]


def test_recursion_goes_hundreds_of_levels_deep(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    began = time.time()
    try:
        got = reachable(spark.range(1).select(F.col("id").alias("node")), spark.range(250).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
        assert got.agg(F.count("*"), F.max("hops"), F.sum("hops")).first() == (251, 250, 31_375)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    print(f"{time.time() - began:.0f} s")


def test_variants_of_odd_json(spark):
    texts = ['{"k": 1}', '{"k": "2"}', '{"k": null}', "{}", "[1, 2]", "7", '"x"', "null", "", " ", "{bad", '{"k": 1', '{"k": [1, {"a": 2.5}]}', None, '{"k": 99999999999999999999}', "x" * 10_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, props string")
    got = {r.i: (r.k, r.deep, r.is_malformed) for r in variants.with_fields(rows, "props", {"k": ("$.k", "bigint"), "deep": ("$.k[1].a", "double")}).collect()}
    assert {i for i, (*_, bad) in got.items() if bad} == {8, 9, 10, 11, 15}
    assert {i: k for i, (k, *_) in got.items() if k is not None} == {0: 1, 1: 2}
    assert {i: d for i, (_, d, _) in got.items() if d is not None} == {12: 2.5}
    assert variants.inferred_schema(rows.filter("i in (0, 3)"), "props") == "OBJECT<k: BIGINT>"
    assert variants.inferred_schema(rows.limit(0), "props") in (None, "VOID")
