"""Composed operators on what the supplied tables don't have: nulls, ties, empty sides, late rows."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tarnlight import plans
from tarnlight.operators import asof_join, interval_join, not_in, sessions, top_per_group
from tarnlight.streaming import deduplicated, event_stream, hourly_counts, idle_keys, joined_within, run_to_files

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(0)), (3, "b", at(9)), (4, None, at(9)), (5, "a", None)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(1), 10), ("a", at(5), 11), ("a", at(5), 12), ("a", at(6), 13), (None, at(1), 14), ("b", None, 15)], "k string, ts timestamp, v int")
    found = {r.id: r.v for r in asof_join(left, right, "ts", ["k"], ["v"]).collect()}
    assert found == {1: 12, 2: None, 3: None, 4: None, 5: None}
    assert asof_join(left, right.limit(0), "ts", ["k"], ["v"]).filter("v is not null").count() == 0
    assert asof_join(left.limit(0), right, "ts", ["k"], ["v"]).count() == 0


def test_interval_join_matches_all_pairs(spark):
    left = spark.createDataFrame([(i, i % 3 or None, at(7 * i)) for i in range(40)], "id int, k int, ts timestamp")
    right = spark.createDataFrame([(i, i % 3 or None, at(5 * i)) for i in range(60)], "rid int, k int, rts timestamp")
    ours = {(r.id, r.rid) for r in interval_join(left, right, "ts", "rts", ["k"], 1800).collect()}
    a, b = left.collect(), right.collect()
    assert ours == {(x.id, y.rid) for x in a for y in b if x.k and x.k == y.k and x.ts - timedelta(seconds=1800) < y.rts <= x.ts}


def test_top_per_group_breaks_ties_by_order(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 1), ("b", 4, None)], "k string, id int, v int")
    top = top_per_group(rows, ["k"], [F.col("v").desc(), F.col("id")], 2)
    assert sorted((r.k, r.id) for r in top.collect()) == [("a", 1), ("a", 2), ("b", 4)]


def test_sessions_split_at_the_gap(spark):
    rows = spark.createDataFrame([(1, at(0)), (1, at(59)), (1, at(119)), (1, at(180)), (2, at(3))], "u int, ts timestamp_ntz")
    assert sorted((r.u, r.n_events) for r in sessions(rows, "u", "ts", "1 hour").collect()) == [(1, 1), (1, 3), (2, 1)]


def test_sessions_cross_slots(spark):
    """Against a plain walk, with sessions over many slots and none, ties, nulls and a hot key."""
    rng = random.Random(12)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), at(rng.randrange(4000))) for _ in range(700)] + [("c", at(60 * i)) for i in range(80)] + [("hot", None), (None, None)]
    keys = {}
    for k, t in rows:
        if k is not None and t is not None:
            keys.setdefault(k, []).append(t)
    expect = []
    for k, own in keys.items():
        own.sort()
        run = [own[0]]
        for t in [*own[1:], None]:
            if t is not None and t <= run[-1] + timedelta(minutes=60):
                run.append(t)
            else:
                expect.append((k, run[0], run[-1], len(run)))
                run = [t]
    frame = spark.createDataFrame(rows, "k string, ts timestamp_ntz").repartition(3)
    for slot in (600, 3600, 86_400 * 40):
        found = sessions(frame, "k", "ts", "60 minutes", slot)
        assert found.columns == ["k", "started", "ended", "n_events"]
        assert sorted(map(tuple, found.collect())) == sorted(expect)
    assert sessions(frame.limit(0), "k", "ts", "60 minutes").count() == 0


def test_asof_carries_rows_over_slots(spark):
    """Against all pairs, with slots shorter than the gaps between rows, nulls, ties and a hot key."""
    rng = random.Random(9)
    left = spark.createDataFrame([(i, rng.choice(["hot", "hot", "hot", "b", None]), at(rng.randrange(5000))) for i in range(300)], "id int, k string, ts timestamp")
    right = spark.createDataFrame([(rng.choice(["hot", "b", "c", None]), at(rng.randrange(5000)), i) for i in range(120)], "k string, ts timestamp, v int")
    seen = right.collect()
    expect = {}
    for x in left.collect():
        own = [(y.ts, y.v) for y in seen if x.k is not None and y.k == x.k and y.ts <= x.ts]
        expect[x.id] = max(own)[1] if own else None
    for seconds in (60, 3600, 86_400 * 30):
        assert {r.id: r.v for r in asof_join(left, right, "ts", ["k"], ["v"], slot_seconds=seconds).collect()} == expect
    assert any(expect.values()) and None in expect.values()


def test_not_in_follows_sql_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    for values in ([], [1], [1, None], [None], [3]):
        right = spark.createDataFrame([(v,) for v in values], "v int")
        left.createOrReplaceTempView("not_in_left")
        right.createOrReplaceTempView("not_in_right")
        expect = spark.sql("select k from not_in_left where k not in (select v from not_in_right)").collect()
        assert sorted(map(str, not_in(left, right, "k", "v").collect())) == sorted(map(str, expect)), values
    spark.catalog.dropTempView("not_in_left")
    spark.catalog.dropTempView("not_in_right")


def test_full_outer_join_keeps_orphans_of_both_sides(spark, tmp_path):
    rows = [(1, at(0), 1, "view"), (2, at(60 * 24 * 29), 2, "view"), (3, at(1), 3, "view"), (4, at(60 * 24 * 29), 3, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    found = plans.queries()["full_outer_activity"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0), (2, 0, 1), (3, 1, 1)]


def test_years_go_to_the_last_order(spark, tmp_path):
    days = [datetime(1999, 3, 1), datetime(2001, 3, 1), datetime(2007, 3, 1)]
    spark.createDataFrame([(i, d) for i, d in enumerate(days)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    found = plans.queries()["calendar_years"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(y, int(y in (1999, 2001, 2007))) for y in range(1999, 2008)]


def test_years_are_not_limited(spark, tmp_path):
    days = [datetime(1850, 3, 1), datetime(2001, 3, 1), None]
    spark.createDataFrame([(i, d) for i, d in enumerate(days)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    found = plans.queries()["calendar_years"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(y, int(y in (1850, 2001))) for y in range(1850, 2002)]


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"
FIRST = [(1, at(5), 1, "view"), (1, at(5), 1, "view"), (2, at(65), 2, "view"), (3, at(200), 1, "view")]
LATE = [(4, at(10), 3, "view"), (5, at(300), 1, "view")]


def arriving(spark, folder, *batches):
    """A folder with a file for each batch, whose times of writing are in that order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        for path in folder.glob("*.parquet"):
            if path.stat().st_mtime > 1_000_000_000 + len(batches):
                os.utime(path, (1_000_000_000 + i, 1_000_000_000 + i))
    return spark.read.parquet(str(folder)).schema


def test_stream_leaves_out_late_rows_and_repeats(spark, tmp_path):
    # a batch drops rows that were late when the batch before it began, so the late one comes two batches after
    schema = arriving(spark, tmp_path / "in", FIRST, [(6, at(210), 2, "view")], LATE)
    counts = run_to_files(hourly_counts(event_stream(spark, str(tmp_path / "in"), schema, 1)))
    # the late row's hour is past when it comes, and the hour of the last event is still open
    assert sorted((r.hour.hour, r.n_events) for r in counts.collect()) == [(0, 2), (1, 1), (3, 2)]
    once = run_to_files(deduplicated(event_stream(spark, str(tmp_path / "in"), schema)))
    assert sorted(r.event_id for r in once.select("event_id").collect()) == [1, 2, 3, 4, 5, 6]


def test_streams_join_within_an_interval(spark, tmp_path):
    rows = [(i, at(7 * i), i % 3 or None, "view" if i % 2 else "purchase") for i in range(60)]
    schema = arriving(spark, tmp_path / "in", rows[:30], rows[30:])

    def stream():
        return event_stream(spark, str(tmp_path / "in"), schema, 1)

    bought = stream().filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = stream().filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("right_ts"))
    found = run_to_files(joined_within(bought, viewed, "user_id", "1 hour").select("event_id", "view_id"))
    pairs = {(p[0], v[0]) for p in rows for v in rows if p[3] == "purchase" and v[3] == "view" and p[2] and p[2] == v[2] and p[1] - timedelta(hours=1) < v[1] <= p[1]}
    assert {(r.event_id, r.view_id) for r in found.collect()} == pairs and pairs


def test_idle_keys_are_given_out_at_their_timeout(spark, tmp_path):
    schema = arriving(spark, tmp_path / "in", FIRST, [(5, at(500), 9, "view")])
    found = run_to_files(idle_keys(event_stream(spark, str(tmp_path / "in"), schema, 1), "user_id"))
    assert sorted((r.user_id, r.n_events, r.last_ts) for r in found.collect()) == [(1, 3, at(200)), (2, 1, at(65))]
