"""Streams with state and timers, and the table that they upsert into, with rows out of order, replays and nulls."""

import os
import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from tarnlight.streaming import event_stream, run_to_files
from tarnlight.streaming.timers import STATE_STORE, first_seen, visits
from tarnlight.streaming.upserts import UpsertTable

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def arriving(spark, folder, *batches):
    """A folder with a file for each batch, whose times of writing are in that order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        for path in folder.glob("*.parquet"):
            if path.stat().st_mtime > 1_000_000_000 + len(batches):
                os.utime(path, (1_000_000_000 + i, 1_000_000_000 + i))
    return event_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, 1)


def test_visits_of_rows_out_of_order(spark, tmp_path):
    """Rows that join two open visits, come late, or lie at the gap itself."""
    batches = [
        [(1, at(0), 1, "view"), (2, at(200), 1, "purchase"), (3, at(10), None, "view")],
        [(4, at(100), 1, "view"), (5, at(400), 2, "purchase"), (6, at(220), 1, "purchase")],  # 4 lies between 1 and 2
        [(7, at(600), 1, "view"), (8, at(300), 2, "view"), (9, at(720), 1, "view")],  # 8 is in time: the watermark was at 390 - 200 when its batch began
        [(10, at(5), 3, "view"), (11, at(2000), 9, "view")],  # 10 is late
        [(12, at(2001), 9, "view")],
    ]
    found = run_to_files(visits(arriving(spark, tmp_path / "in", *batches), "user_id", "event_type = 'purchase'", "2 hours", "200 minutes"), state_store=STATE_STORE)
    rows = sorted((r.user_id or 0, r.visit, r.started, r.ended, r.n_events, r.n_goals, r.goals_so_far) for r in found.collect())
    assert rows == [
        (0, 1, at(10), at(10), 1, 0, 0),
        (1, 1, at(0), at(220), 4, 2, 2),
        (1, 2, at(600), at(720), 2, 0, 2),
        (2, 1, at(300), at(400), 2, 1, 1),
    ]


def test_visits_of_a_key_leave_together(spark, tmp_path):
    """A frame for each visit, or an entry of state for each, cost most of the time of keys with many visits."""
    visited = 3000
    rows = [(i, at(200 * i), 1, "purchase") for i in range(visited)] + [(visited, at(200 * visited + 100_000), 2, "view")]
    seconds = []
    for some in (rows[-1:], rows):
        folder = tmp_path / f"in-{len(some)}"
        began = time.perf_counter()
        found = run_to_files(visits(arriving(spark, folder, some), "user_id", "event_type = 'purchase'"), state_store=STATE_STORE)
        assert found.count() == len(some) - 1
        seconds.append(time.perf_counter() - began)
    assert sorted((r.visit, r.n_goals, r.goals_so_far) for r in found.collect()) == [(i, 1, i) for i in range(1, visited + 1)]
    assert seconds[1] < seconds[0] + 3


def test_visits_of_shuffled_rows_equal_those_in_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, at(rng.randrange(4000)), rng.randrange(4), rng.choice(["view", "purchase", None])) for i in range(120)]
    parts = [rows[i::4] for i in range(4)]
    last = [(1000, at(90_000), 99, "view")]
    stream = arriving(spark, tmp_path / "in", *parts, last)
    found = run_to_files(visits(stream, "user_id", "event_type = 'purchase'", "1 hour", "30 days"), state_store=STATE_STORE)
    keys = defaultdict(list)
    for _, t, k, kind in rows:
        keys[k].append((t, kind == "purchase"))
    expect = Counter()
    for k, own in keys.items():
        own.sort()
        runs = [[own[0]]]
        for x in own[1:]:
            if x[0] <= runs[-1][-1][0] + timedelta(hours=1):
                runs[-1].append(x)
            else:
                runs.append([x])
        so_far = 0
        for visit, run in enumerate(runs, 1):
            so_far += sum(g for _, g in run)
            expect[(k, visit, run[0][0], run[-1][0], len(run), sum(g for _, g in run), so_far)] += 1
    assert Counter(map(tuple, found.collect())) == expect


def test_first_seen_forgets_after_its_time(spark, tmp_path):
    def run(forget):
        folder = tmp_path / forget.replace(" ", "-")
        schema = spark.createDataFrame([], SCHEMA).schema
        for i in range(2):
            spark.createDataFrame([(i, at(i), 7, "view"), (i, at(i), 7, "view"), (i, at(i), 10 + i, "view"), (i, at(i), None, "view")], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
            try:
                query = first_seen(event_stream(spark, str(folder / "in"), schema), "user_id", forget).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).start()
                until = time.time() + 30
                while time.time() < until and sum(p["numInputRows"] for p in query.recentProgress) < 4:  # with a time to live it goes on until it is stopped
                    time.sleep(0.1)
                query.stop()
            finally:
                spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            time.sleep(1.5)
        return Counter((r.user_id, r.n_rows) for r in spark.read.parquet(str(folder / "out")).collect())

    assert run("1 hour") == Counter({(7, 2): 1, (None, 1): 1, (10, 1): 1, (11, 1): 1})
    assert run("1 second") == Counter({(7, 2): 2, (None, 1): 2, (10, 1): 1, (11, 1): 1})


def table_rows(table):
    return Counter(map(tuple, table.read().collect()))


def test_upserts_keep_the_latest_row_and_a_replay_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    table = UpsertTable(spark, f"file://{tmp_path}/table", ["k", "g"], ["at"], buckets=5)
    with pytest.raises(ValueError, match="no batch"):
        table.read()
    best = {}
    batches = []
    for batch_id in range(4):
        rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([1, None]), rng.choice([None, *range(40)]), 100 * batch_id + i) for i in range(30)]
        rows = list({(k, g, t): (k, g, t, v) for k, g, t, v in rows}.values())  # one row for each key and time in a batch
        batches.append(rows)
        for k, g, t, v in rows:
            held = best.get((k, g))
            if held is None or (t is not None, t or 0) >= (held[2] is not None, held[2] or 0):
                best[k, g] = (k, g, t, v)
        frame = spark.createDataFrame(rows, "k string, g int, at int, v int")
        assert table.merge(frame, batch_id)
        assert table_rows(table) == Counter(best.values())
    before = table.manifest()
    for batch_id, rows in enumerate(batches):
        assert not table.merge(spark.createDataFrame(rows, "k string, g int, at int, v int"), batch_id)
    assert table.manifest() == before and table_rows(table) == Counter(best.values())
    assert table.merge(spark.createDataFrame([("new", 1, 1, 1)], "k string, g int, at int, v int"), 0, writer="another")
    untouched = [b for b, place in table.manifest()["buckets"].items() if before["buckets"].get(b) == place]
    assert len(untouched) >= len(before["buckets"]) - 1
    assert table.merge(spark.createDataFrame([], "k string, g int, at int, v int"), 9) and table_rows(table).total() == len(best) + 1


def test_two_writers_of_one_version(spark, tmp_path):
    first, second = (UpsertTable(spark, f"file://{tmp_path}/table", ["k"], ["at"], 2) for _ in range(2))
    stale = second.manifest()
    assert first.merge(spark.createDataFrame([(1, 1)], "k int, at int"), 0)
    second.manifest = lambda: stale
    with pytest.raises(RuntimeError, match="another writer"):
        second.merge(spark.createDataFrame([(2, 1)], "k int, at int"), 0, writer="second")
    del second.manifest
    assert second.merge(spark.createDataFrame([(2, 1)], "k int, at int"), 0, writer="second")
    assert table_rows(first) == Counter([(1, 1), (2, 1)])


def test_a_stream_that_starts_over_changes_nothing(spark, tmp_path):
    stream = arriving(spark, tmp_path / "in", [(1, at(5), 1, "view")], [(2, at(3), 1, "late"), (3, at(9), 2, "view")], [(4, at(8), 1, "buy")])
    table = UpsertTable(spark, str(tmp_path / "table"), ["user_id"], ["ts", "event_id"], 3)
    table.follow(stream, str(tmp_path / "state"))
    expect = Counter([(4, at(8), 1, "buy"), (3, at(9), 2, "view")])
    assert table_rows(table) == expect
    version = table.manifest()["version"]
    table.follow(stream, str(tmp_path / "state-lost"))  # the same batches again, as after a lost checkpoint
    assert table.manifest()["version"] == version == 3 and table_rows(table) == expect
