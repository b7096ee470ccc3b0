"""Row patterns: runs of a key's rows, in order, that a regular expression over their kinds accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The letter of rows of no kind.
OTHER = "_"


def match_rows(rows: DataFrame, by: list[str], ts: str, row_id: str, kinds: dict[str, Column], pattern: str, within_seconds: int, overlapping: bool = True, slot_seconds: int | None = None) -> DataFrame:
    """by, first_id, last_id, started, ended, n_rows for the runs of a key's neighbouring rows, in order of ts and row_id, that match.

    kinds names row kinds by one letter each with a condition; a row is of the first kind that holds, or OTHER. A run matches if its letters are one that
    pattern, a regular expression over letters, accepts from the run's first row on (the longest by the expression's own greed, not empty), among the rows up to within_seconds
    after that first row. Every row may start a run. With overlapping=False, of the runs that share a row only
    those stay that start after the last one kept has ended, in order.

    Time is cut into slots of slot_seconds (four times within_seconds by default, and not less than it). A task walks its slots' rows in order with the expression's automaton, all slots of a batch at once; rows in the first
    within_seconds of a slot also go to the slot before, so every run is seen whole in the slot of its first row. Keys' rows are dealt by slot, so a hot key is in many tasks, and a
    task holds a batch and one slot of one key at a time. Rows with a null key, time or id are in no run. Nothing but matches is compared by key when runs that overlap are thinned.
    """
    slot = max(within_seconds, slot_seconds or 4 * within_seconds) * 1_000_000
    within = within_seconds * 1_000_000
    letter = F.lit(OTHER)
    for name, condition in reversed(kinds.items()):
        if len(name) != 1 or name == OTHER:
            raise ValueError("a kind's name is one letter")
        letter = F.when(condition, F.lit(name)).otherwise(letter)
    good = rows.dropna(subset=[*by, ts, row_id])
    marked = good.select(*by, F.col(ts).alias("at"), F.col(row_id).alias("id"), letter.alias("letter"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    own = F.floor(F.col("micros") / slot).cast("long")
    ahead = F.col("micros") - own * slot <= within
    dealt = marked.withColumn("own", own).withColumn("slot", F.explode(F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own))))
    dealt = dealt.repartition(*by, "slot").sortWithinPartitions(*by, "slot", "micros", "id")
    fields = {f.name: f.dataType.simpleString() for f in dealt.schema}
    names = list(by)

    def walk(batches):
        import re

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        accepts = re.compile(pattern).match

        def matches(groups: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            """Of whole groups of a key and slot, which begin at starts; all are walked as one text, in which no run passes its group's end."""
            n = groups.num_rows
            letters, micros = "".join(groups["letter"].to_pylist()), groups["micros"].to_numpy()
            mine = np.flatnonzero(groups["own"].to_numpy() == groups["slot"].to_numpy())
            place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            # a row's limit: how many rows stand before or at its time plus within, in order of group and time
            order = np.lexsort((np.repeat([0, 1], n), np.r_[micros, micros + within], np.r_[place, place]))
            limits = np.empty(2 * n, np.int64)
            limits[order] = np.cumsum(order < n)
            limits = limits[n + mine].tolist()
            # letters of groups are kept apart, so what an expression sees before its first row is of the row's own group
            shift = np.arange(n) + place
            apart = np.full(n + len(starts), ord("\n"), np.uint32)
            apart[shift] = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
            text = apart.tobytes().decode("utf-32-le")
            moved = (shift - np.arange(n))[mine].tolist()
            found = [(i, m.end() - 1 - k) for i, k, limit in zip(mine.tolist(), moved, limits, strict=True) if (m := accepts(text, i + k, limit + k)) and m.end() > i + k]
            first, last = (pa.array([f[side] for f in found], pa.int64()) for side in (0, 1))
            keys = [groups[c].take(first).combine_chunks() for c in names]
            ends = [groups[c].take(side).combine_chunks() for c in ("id", "at") for side in (first, last)]
            sizes = pa.array([e - s + 1 for s, e in found], pa.int64())
            return pa.RecordBatch.from_arrays([*keys, *ends, sizes], [*names, "first_id", "last_id", "started", "ended", "n_rows"])

        held: list[pa.Table] = []  # of the last group, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            n = table.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in [*names, "slot"]:
                new[1:] |= pc.not_equal(table[c].slice(1), table[c].slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[0] |= bool(held) and table[c][0] != held[-1][c][-1]
            borders = np.flatnonzero(new)
            if not len(borders):
                held.append(table)
                continue
            whole = pa.concat_tables([*held, table.slice(0, int(borders[-1]))]).combine_chunks()
            size = whole.num_rows - int(borders[-1])
            starts = np.r_[0, borders[:-1] + size]
            yield matches(whole, np.unique(starts))
            held = [table.slice(int(borders[-1]))]
        if held:
            yield matches(pa.concat_tables(held).combine_chunks(), np.zeros(1, np.int64))

    schema = ", ".join(f"`{c}` {fields[c]}" for c in by) + f", first_id {fields['id']}, last_id {fields['id']}, started {fields['at']}, ended {fields['at']}, n_rows long"
    found = dealt.mapInArrow(walk, schema)
    return found if overlapping else _thinned(found, by)


def _thinned(found: DataFrame, by: list[str]) -> DataFrame:
    """Of runs that share rows, the first and then each that starts after the last kept. Runs are taken together by islands, which no run leaves."""
    start, end = F.struct("started", "first_id"), F.struct("ended", "last_id")
    before = Window.partitionBy(*by).orderBy("started", "first_id")
    reach = F.max(end).over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", (reach.isNull() | (start > reach)).cast("long"))
    islands = marked.withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.struct("started", "first_id", "ended", "last_id", "n_rows")
    whole = islands.groupBy(*by, "island").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    kind = whole.schema["runs"].dataType

    def keep(done: Column, run: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        free = (F.size(done) == 0) | (F.struct(run["started"], run["first_id"]) > F.struct(last["ended"], last["last_id"]))
        return F.when(free, F.array_append(done, run)).otherwise(done)

    kept = whole.select(*by, F.inline(F.aggregate("runs", F.array().cast(kind), keep)))
    return kept.select(*by, "first_id", "last_id", "started", "ended", "n_rows")
