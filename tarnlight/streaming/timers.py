"""Visits of a key as state with event-time timers, and a first-seen filter whose state has a time to live."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of these operators is kept by RocksDB on the executors' disks and checkpointed with the query.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Open visits of a key that one entry of its list state holds: an entry costs a message to the store and back.
BLOCK = 512


def visits(events: DataFrame, by: str, goal: str, gap: str = "2 hours", lateness: str = "10 minutes") -> DataFrame:
    """by, visit, started, ended, n_events, n_goals, goals_so_far for each visit of a key, once the watermark has passed its end by the gap.

    A visit is a run of a key's events at most `gap` apart, in any order of arrival: a row may extend an open visit at either end or join two.
    n_goals counts rows for which the condition `goal` holds; visit and goals_so_far count over the key's visits in order. Rows later than the lateness are left out; a null key
    is a key of its own. Open visits are a list, each entry the four numbers of up to BLOCK of them, the key's totals a map; a timer stands for the end of the key's first open visit, so nothing is
    scanned to find what is over, and all visits that are over leave in one frame a key. Totals stay as long as the key does. To be run with STATE_STORE as the state store.
    """
    micros = int(pd.Timedelta(gap).total_seconds() * 1_000_000)
    kind = events.schema[by].dataType.simpleString()

    class Visits(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", "low array<long>, high array<long>, n array<long>, goals array<long>")
            self.totals = handle.getMapState("totals", "name string", "n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            spans = self._spans()
            before = min((s[1] for s in spans), default=None)
            for frame in rows:
                spans += [(t, t, 1, g) for t, g in zip(frame["micros"].tolist(), frame["is_goal"].tolist(), strict=True)]
            merged: list[tuple[int, int, int, int]] = []
            for low, high, n, goals in sorted(spans):
                if merged and low <= merged[-1][1] + micros:
                    a, b, m, g = merged.pop()
                    low, high, n, goals = a, max(b, high), m + n, g + goals
                merged.append((low, high, n, goals))
            self._keep(merged)
            if merged[0][1] != before:
                if before is not None:
                    self.handle.deleteTimer(self._timer(before))
                self.handle.registerTimer(self._timer(merged[0][1]))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            spans = self._spans()
            over = [s for s in spans if self._timer(s[1]) <= now]
            if not over:
                return
            # each call of the state is a message to the store, and each frame one to Spark: a key has a few, however many visits are over
            totals = {name[0]: n[0] for name, n in self.totals.iterator()}
            visit, goals_so_far = totals.get("visits", 0), totals.get("goals", 0)
            lows, highs, counts, goals = zip(*over, strict=True)
            sums = list(accumulate(goals, initial=goals_so_far))[1:]
            yield pd.DataFrame({by: pd.Series([key[0]] * len(over), dtype=object), "visit": range(visit + 1, visit + len(over) + 1), "started": pd.to_datetime(lows, unit="us"), "ended": pd.to_datetime(highs, unit="us"), "n_events": counts, "n_goals": goals, "goals_so_far": sums})
            self.totals.updateValue(("visits",), (visit + len(over),))
            self.totals.updateValue(("goals",), (sums[-1],))
            rest = spans[len(over) :]  # the list is in order of time, so what is over comes first
            if rest:
                self._keep(rest)
                self.handle.registerTimer(self._timer(rest[0][1]))
            else:
                self.open.clear()

        def close(self) -> None:
            pass

        def _spans(self) -> list[tuple[int, int, int, int]]:
            return [span for block in self.open.get() for span in zip(*block, strict=True)]

        def _keep(self, spans: list[tuple[int, int, int, int]]) -> None:
            self.open.put([tuple(map(list, zip(*spans[i : i + BLOCK], strict=True))) for i in range(0, len(spans), BLOCK)])

        @staticmethod
        def _timer(end: int) -> int:
            return -(-(end + micros) // 1000)

    rows = events.withWatermark("ts", lateness).select(by, "ts", F.unix_micros("ts").alias("micros"), F.coalesce(F.expr(goal).cast("int"), F.lit(0)).alias("is_goal"))
    schema = f"{by} {kind}, visit long, started timestamp, ended timestamp, n_events long, n_goals long, goals_so_far long"
    return rows.groupBy(by).transformWithStateInPandas(Visits(), schema, "append", "EventTime")


def first_seen(rows: DataFrame, by: str, forget_after: str) -> DataFrame:
    """by, n_rows: each key when it is met for the first time in `forget_after` of processing time, with the rows it then came with.

    A key's state is one number whose time to live the store keeps, so it is bounded by the keys of that time. A null key is a key of its own. To be run with STATE_STORE,
    until it is stopped: as time goes on by itself, such a query has never seen all there is.
    """
    live = int(pd.Timedelta(forget_after).total_seconds() * 1000)
    kind = rows.schema[by].dataType.simpleString()

    class FirstSeen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "n long", live)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            n = sum(len(frame) for frame in rows)
            if not self.seen.exists():
                self.seen.update((n,))
                yield pd.DataFrame({by: [key[0]], "n_rows": [n]})

        def close(self) -> None:
            pass

    return rows.select(by).groupBy(by).transformWithStateInPandas(FirstSeen(), f"{by} {kind}, n_rows long", "append", "ProcessingTime")
