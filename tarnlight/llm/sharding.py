"""Operator 6 [native]: sharding by a k-d tree over metadata.

Rows are gathered to groups of equal texts and the groups to cells of the metadata, whose number
is bounded. The tree is built from the cells' weights; where it cuts a cell, the cell's groups are dealt
by their running sum of weights.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.llm.staging import Workspace

#: Cells of a column's values on its axis, besides that of nulls, and of the size for each doubling.
CELLS, STEPS = 32, 2
#: The part of a shard above which a group of equal texts is placed by itself; of all weight, such groups have at least 1 / MAX_HEAVY each.
HEAVY, MAX_HEAVY = 0.01, 20_000
#: By how much a shard may be over the mean before groups in it are parted.
TOLERANCE = 0.1
SLOT_ROWS = 500
#: Copies of a repeated row that one task writes out at once.
RUN = 1_000
KEY = ["text_hash", "text_crc32", "size"]

#: Coordinates on the axes, a name, a weight.
Item = tuple[tuple[int, ...], int, int]


def build_tree(cells: list[Item], atoms: list[Item], shards: int) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int]]:
    """Where a k-d tree of so many leaves puts cells, which can be cut anywhere, and atoms, which can't be cut.

    A node of several shards is cut along its widest axis (measured against the whole table's width) at
    its weighted median: what is left of the cut weighs as much for each shard as what is right of it. Items with equal
    coordinates on that axis are ordered by the other axes, then by name. An atom on the median goes to the side that comes nearer, and the cut
    through the cells makes up for it; where there is too little in cells, atoms change sides.

    Returns for each cell (end, shard) of its stretches in order, and for each atom its shard.
    """
    items = cells + atoms
    axes = range(len(items[0][0])) if items else range(0)
    extent = [max(c[d] for c, _, _ in items) - min(c[d] for c, _, _ in items) or 1 for d in axes]
    stretches: dict[int, list[tuple[int, int]]] = {}
    homes: dict[int, int] = {}

    def widest(parts: list) -> Callable:
        d = max(axes, key=lambda d: (max(p[0][d] for p in parts) - min(p[0][d] for p in parts)) / extent[d])
        return lambda p: (p[0][d], p[0], p[1])

    def place(parts: list[tuple], whole: list[Item], first: int, count: int) -> None:
        if count == 1 or not parts and not whole:
            for _, name, _, end in parts:
                stretches.setdefault(name, []).append((end, first))
            homes.update((name, first) for _, name, _ in whole)
            return
        left = count // 2
        total = sum(end - start for _, _, start, end in parts) + sum(w for _, _, w in whole)
        halves, rests = _cut(sorted(parts, key=(order := widest(parts + whole))), sorted(whole, key=order), order, total * left // count)
        place(halves[0], rests[0], first, left)
        place(halves[1], rests[1], first + left, count - left)

    place([(at, name, 0, weight) for at, name, weight in cells if weight], atoms, 0, shards)
    return stretches, homes


def _cut(parts: list[tuple], atoms: list[Item], order: Callable, wanted: int) -> tuple[tuple[list, list], tuple[list, list]]:
    """Ordered parts and atoms of a node in two, the first of which weighs as near to wanted as can be."""
    loose = sum(end - start for _, _, start, end in parts)
    below, at = 0, 0  # the weight of what comes before, and the number of parts in it
    taken = 0
    for atom in atoms:
        while at < len(parts) and order(parts[at]) < order(atom):
            below += parts[at][3] - parts[at][2]
            at += 1
        if below + atom[2] / 2 > wanted:
            break
        below += atom[2]
        taken += 1
    left, right = atoms[:taken], atoms[taken:]
    missing = wanted - sum(a[2] for a in left)
    if not 0 <= missing <= loose:
        left, right = _evened(left, right, missing - min(max(missing, 0), loose))
        missing = min(max(wanted - sum(a[2] for a in left), 0), loose)
    before, after = [], []
    for coords, name, start, end in parts:
        size = end - start
        if missing >= size:
            before.append((coords, name, start, end))
        elif missing <= 0:
            after.append((coords, name, start, end))
        else:
            before.append((coords, name, start, start + missing))
            after.append((coords, name, start + missing, end))
        missing -= size
    return (before, after), (left, right)


def _evened(left: list[Item], right: list[Item], gap: int) -> tuple[list[Item], list[Item]]:
    """The atoms after the moves and swaps, one at a time, that bring the left side nearest to gap more than it has."""
    nothing = ((), -1, 0)
    while gap:
        offers = sorted([nothing, *right], key=lambda a: a[2])
        sizes = [a[2] for a in offers]
        best, change = abs(gap), None
        for back in [nothing, *left]:
            i = bisect_left(sizes, back[2] + gap)
            for j in (i - 1, i):
                if 0 <= j < len(sizes) and abs(gap - sizes[j] + back[2]) < best:
                    best, change = abs(gap - sizes[j] + back[2]), (offers[j], back)
        if change is None:
            break
        to_left, to_right = change
        left = [a for a in left if a is not to_right] + [to_left] * (to_left is not nothing)
        right = [a for a in right if a is not to_left] + [to_right] * (to_right is not nothing)
        gap -= to_left[2] - to_right[2]
    return left, right


def _tree_with_room(cells: list[Item], atoms: list[Item], copies: dict[int, int], shards: int) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int]]:
    """The tree, with groups of several copies made into cells of their own only where they weigh more than a shard's mean or leave one over the tolerance."""
    mean = sum(w for _, _, w in cells + atoms) / shards
    most = mean * (1 + TOLERANCE)
    parted = {name for _, name, w in atoms if w > mean and copies[name] > 1}
    while True:
        stretches, homes = build_tree(cells + [a for a in atoms if a[1] in parted], [a for a in atoms if a[1] not in parted], shards)
        loads = dict.fromkeys(range(shards), 0)
        for ends in stretches.values():
            for (end, shard), start in zip(ends, [0, *(e for e, _ in ends)], strict=False):
                loads[shard] += end - start
        for _, name, w in atoms:
            if name in homes:
                loads[homes[name]] += w
        over = [(loads[homes[name]], w, name) for _, name, w in atoms if name in homes and copies[name] > 1 and loads[homes[name]] > most]
        if not over:
            return stretches, homes
        parted.add(max(over)[2])


def kd_shards(docs: DataFrame, shards: int = 24, dims: tuple[str, ...] = ("lang", "source"), target_bytes: int | None = None, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs(doc_id, text, dims).

    The law is `bytes`: the shards' sizes (UTF-8 bytes of the text, none for a null, plus 8) are
    nearly equal. There are `shards` of them or, with target_bytes, as many as let the leaves reach that size. The tree's axes are the
    logarithm of the size and, for each column of dims that docs has, the rank of its value, in at most CELLS
    ranges of values of about equal weight if there are more values; a null comes before all. Rows of equal texts
    have the least of their langs and sources and stay in one shard, except groups that weigh more than a shard's mean or would leave
    one more than TOLERANCE over it: their rows are dealt in order of doc_id hash. A single document is never cut, so
    documents of a shard's size make uneven shards. Slots run from 0 without gaps in each shard, in no meaningful order.
    grown_shard is null. Rows may repeat, each is dealt; doc_id may be null, an empty table gives no rows, and shards
    can be empty if there are few rows. Other columns are ignored.

    To the driver come the weights of cells, at most 31 * STEPS * (CELLS + 1) ^ 2, and the groups above HEAVY, at most
    2 * MAX_HEAVY. A shard of a cut cell is looked up in an array of the cell's cuts.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "sharding")
    present = [d for d in dims if d in docs.columns]
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"), *[F.col(d).cast("string").alias(f"dim_{i}") for i, d in enumerate(present)],
    )
    values = [f"dim_{i}" for i in range(len(present))]
    least = [F.min(v).alias(v) for v in values]
    runs = space.stage(rows.groupBy("doc_id", *KEY).agg(F.count("*").alias("n"), *least), "runs")
    groups = space.stage(runs.groupBy(*KEY).agg(F.sum("n").alias("copies"), *least).withColumn("weight", F.col("copies") * F.col("size")), "groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    axes = ["axis", *[f"axis_{i}" for i in range(len(present))]]
    groups = groups.withColumn("axis", F.floor(F.log2("size") * STEPS).cast("int"))
    for i, v in enumerate(values):
        groups = groups.withColumn(f"axis_{i}", _place(F.col(v), _starts(space, groups, v, total)))

    share = max(HEAVY / shards, 1 / MAX_HEAVY)
    is_heavy = (F.col("weight") > share * total) | (F.col("copies") > share * n_rows)
    heavy = groups.filter(is_heavy).select(*KEY, "copies", "weight", *axes).collect()
    light = groups.filter(~is_heavy)
    sums = light.groupBy(*axes).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    cells = [(tuple(r[a] for a in axes), i, r["weight"]) for i, r in enumerate(sorted(sums, key=lambda r: tuple(r[a] for a in axes)))]
    counts = {tuple(r[a] for a in axes): r["n"] for r in sums}
    heavy.sort(key=lambda r: tuple(r[k] for k in KEY))
    atoms = [(tuple(r[a] for a in axes), len(cells) + i, r["weight"]) for i, r in enumerate(heavy)]
    stretches, homes = _tree_with_room(cells, atoms, {a[1]: r["copies"] for a, r in zip(atoms, heavy, strict=True)}, shards)

    of_cell = [dict(zip(axes, at, strict=True)) | {"bins": max(1, counts[at] // slot_rows)} | _written(stretches[name]) for at, name, _ in cells]
    of_cell = _table(spark, of_cell, f"{', '.join(f'{a}: int' for a in axes)}, bins: long, ends: array<long>, homes: array<int>")
    light = light.join(F.broadcast(of_cell), axes)
    cut = _running(light.filter("size(homes) > 1"), axes, "weight", [F.col(k) for k in KEY])
    light_homes = light.filter("size(homes) = 1").select(*KEY, F.col("homes")[0].alias("shard"))
    light_homes = light_homes.unionByName(cut.select(*KEY, F.get("homes", _after("ends", F.col("start") + F.col("weight") / 2)).alias("shard")))

    keys = "text_hash: long, text_crc32: long, size: long"
    named = {a[1]: {k: r[k] for k in KEY} for a, r in zip(atoms, heavy, strict=True)}
    kept = _table(spark, [named[name] | {"shard": shard} for name, shard in homes.items()], f"{keys}, shard: int")
    # in rows, as the tree cuts by weight
    parted = [
        named[name] | {"bins": max(1, r["copies"] // slot_rows), "homes": [shard for _, shard in stretches[name]], "ends": [round(end / r["size"]) for end, _ in stretches[name]]}
        for (_, name, _), r in zip(atoms, heavy, strict=True)
        if name in stretches
    ]
    parted = runs.join(F.broadcast(_table(spark, parted, f"{keys}, bins: long, ends: array<long>, homes: array<int>")), KEY)
    parted = _running(parted, KEY, "n", [F.col("doc_id")], by=F.xxhash64("doc_id"))
    # the stretches that a run of equal rows reaches into, with the rows in each
    first, last = _after("ends", F.col("start")), _after("ends", F.col("start") + F.col("n") - 1)
    parted = parted.withColumn("i", F.explode(F.sequence(first, last)))
    low = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0)
    inside = F.least(F.get("ends", "i"), F.col("start") + F.col("n")) - F.greatest(low, F.col("start"))
    out = ["doc_id", "size", "text_crc32", "shard", "n"]
    heavy_keys = F.broadcast(_table(spark, list(named.values()), keys))
    dealt = runs.join(heavy_keys, KEY, "left_anti").join(light_homes, KEY).select(*out)
    dealt = dealt.unionByName(runs.join(F.broadcast(kept), KEY).select(*out))
    dealt = dealt.unionByName(parted.withColumn("shard", F.get("homes", "i")).withColumn("n", inside).filter("n > 0").select(*out))
    dealt = space.stage(dealt, "dealt")
    return _slots(dealt, max(8, -(-n_rows // (slot_rows * shards)))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _starts(space: Workspace, groups: DataFrame, name: str, total: int) -> list[str]:
    """The first value of each cell of a column: all values or, if they are more than CELLS, those that begin ranges of about equal weight."""
    values = space.stage(groups.filter(F.col(name).isNotNull()).groupBy(name).agg(F.sum("weight").alias("weight")), "values")
    if values.count() > CELLS:
        ordered = space.stage(values.repartitionByRange(name).withColumn("part", F.spark_partition_id()), "values")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = ordered.groupBy("part").agg(F.sum("weight").alias("weight")).select("part", F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("before"))
        within = F.coalesce(F.sum("weight").over(Window.partitionBy("part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranged = ordered.join(F.broadcast(parts), "part").withColumn("cell", F.floor((F.col("before") + within) / F.lit(total / CELLS)))
        values = ranged.groupBy("cell").agg(F.min(name).alias(name))
    return sorted(r[0] for r in values.select(name).collect())


def _place(value: Column, starts: list[str]) -> Column:
    """The number of the value's cell from 1; 0 for a null."""
    if not starts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= value)), F.lit(0)) * F.when(value.isNull(), 0).otherwise(1)


def _written(ends: list[tuple[int, int]]) -> dict:
    return {"ends": [end for end, _ in ends], "homes": [shard for _, shard in ends]}


def _table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def _after(ends: str, place: Column) -> Column:
    """The number of the stretch that holds the place, the last one for any beyond."""
    return F.least(F.size(F.filter(ends, lambda end: end <= place)), F.size(ends) - 1)


def _running(rows: DataFrame, of: list[str], amount: str, order: list[Column], by: Column | None = None) -> DataFrame:
    """rows with start, the sum of the amounts that come before in its cell: the cell is numbered in `bins` by hash, each after those before it."""
    binned = rows.withColumn("bin", F.pmod(F.xxhash64(by if by is not None else F.col("text_hash"), F.lit(1)), "bins"))
    sums = binned.groupBy(*of, "bin").agg(F.sum(amount).alias("amount"))
    before = F.coalesce(F.sum("amount").over(Window.partitionBy(*of).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*of, "bin", before.alias("before"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy(*of, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return binned.withColumn("own", own).join(sums, [*of, "bin"]).withColumn("start", F.col("before") + F.col("own"))


def _slots(dealt: DataFrame, parts: int) -> DataFrame:
    """Write out the runs of equal rows and number the rows of each shard: in parts of each shard by hash, after the rows of the parts before."""
    keyed = dealt.withColumn("bins", F.lit(parts)).withColumnRenamed("n", "rows")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    started = _running(keyed, ["shard"], "rows", order, by=F.xxhash64(*order))
    first = F.col("start")
    few = started.filter(F.col("rows") <= RUN).withColumn("slot", F.explode(F.sequence(first, first + F.col("rows") - 1)))
    many = started.filter(F.col("rows") > RUN).withColumn("at", F.explode(F.sequence(first, first + F.col("rows") - 1, F.lit(RUN).cast("long")))).repartition("shard", "at")
    many = many.withColumn("slot", F.explode(F.sequence("at", F.least(F.col("at") + RUN - 1, first + F.col("rows") - 1))))
    return few.unionByName(many.drop("at"))


def op6_kd_sharding(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return kd_shards(docs)
