"""Operator 3: token-id output as packed id matrices, by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, texts
from tarnlight.llm.byte_pairs import Vocabulary, encoder
from tarnlight.llm.shipping import remote
from tarnlight.llm.staging import Workspace, once, text_mark

GROUP_BYTES = 4 << 20
#: Bytes of ids after which a batch of pieces is handed on.
HELD_BYTES = 8 << 20
#: Groups that a task packs one after another in large tables.
GROUPS_PER_TASK = 8
#: Copies of one piece that stay together when copies are dealt to groups.
COPIES = 64
BROADCAST_ROWS = 500_000
#: The columns of a packed row.
ROW = (
    ("sequence_id", pa.int64()), ("ids", pa.binary()), ("id_bytes", pa.int32()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
    ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
)


class CapacityTree:
    """A segment tree over the free rooms 0 to capacity, each leaf the number of open bins with that room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at //= 2

    def open(self, found: int, room: int) -> None:
        self.bins[room].append(found)
        self._add(room, 1)

    def best_fit(self, size: int) -> int | None:
        """The smallest room of at least size that some open bin has, or None."""
        at = size + self.leaves
        if self.count[at]:
            return size
        while at > 1:  # up to the first ancestor with open bins to the right, then down to its leftmost
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The items of each bin in the order they were put in; sizes lie between 1 and the capacity."""
    tree, packed = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = tree.best_fit(sizes[i])
        if room is None:
            packed.append([])
            found, room = len(packed) - 1, capacity
        else:
            found = tree.take(room)
        packed[found].append(i)
        if room > sizes[i]:
            tree.open(found, room - sizes[i])
    return packed


def token_matrices(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 1, pad_id: int = 0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Packed rows of token ids for docs(doc_id, text), ready to be written as a table of binary rows.

    Ids are a text's tokens, then end_id unless that is None, cut losslessly at multiples of the
    capacity. Pieces go at random to groups of about group_bytes of text, however long their document
    is; each group is packed by best-fit decreasing. Rows that repeat doc_id and text are counted first, tokenized once, and
    their copies dealt in lots of COPIES, so no group holds more than chance gives it. A row is one sequence:

    sequence_id   group times 2^32 plus bin
    ids           capacity little-endian unsigned integers of id_bytes each, filled up with pad_id
    id_bytes      2 if the vocabulary fits, else 4
    n_tokens      ids before the padding
    cu_seqlens    0 and the cumulative lengths of the segments
    positions     for each id, little-endian unsigned 16-bit (32-bit for capacities over 65,536), its
                  place in its segment: it starts again at 0 with each segment and with the padding
    doc_ids, starts   each segment's document and its first id's place there

    A null or empty text is the end_id alone (no segment without it). Repeated rows are packed each; a
    null doc_id stays null. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    space = Workspace(spark, "token-binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = rows.groupBy("doc_id", text_mark(F.col("text")).alias("text_mark")).agg(F.count("*").cast("long").alias("n"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    kinds = space.stage(kinds, "kinds")
    total, n_repeated = kinds.agg(F.coalesce(F.sum(F.col("n") * (F.col("bytes") + 1)), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    groups = max(1, -(-total // group_bytes))
    width = 2 if max(Vocabulary(tokenizer_path).size, (end_id or 0) + 1, pad_id + 1) <= 1 << 16 else 4
    counted = once(rows, kinds.filter("n > 1"), n_repeated, BROADCAST_ROWS)
    cut = counted.mapInArrow(remote(__name__, "id_batches", tokenizer_path, capacity, end_id, width), "doc_id long, start long, length int, ids binary, n long")
    lots = cut.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    copies = F.least(F.lit(COPIES), F.col("n") - COPIES * F.col("lot")).cast("int")
    dealt = lots.select("doc_id", "start", "length", "ids", copies.alias("copies"), F.pmod(F.xxhash64("doc_id", "start", "ids", "lot"), F.lit(groups)).alias("bin_group"))
    # tasks in number with the groups, not with the session's fixed setting
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // GROUPS_PER_TASK))
    dealt = dealt.repartition(tasks, "bin_group")
    return dealt.groupBy("bin_group").applyInArrow(
        remote(__name__, "matrix_group", capacity, pad_id, width),
        "sequence_id long, ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>",
    )


def id_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int | None, width: int) -> Iterator[pa.RecordBatch]:
    tokens, kind = encoder(path), f"<u{width}"
    tail = b"" if end_id is None else int(end_id).to_bytes(width, "little")
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        held = 0
        for doc_id, text, n in zip(column(batch, "doc_id").to_pylist(), texts(batch), column(batch, "n").to_pylist(), strict=True):
            ids = tokens.encode(text).astype(kind).tobytes() + tail
            for start in range(0, len(ids), width * capacity):
                piece = ids[start : start + width * capacity]
                for values, value in zip(columns, (doc_id, start // width, len(piece) // width, piece, n), strict=True):
                    values.append(value)
            held += len(ids)
            if held > HELD_BYTES:
                yield _piece_batch(columns)
                columns, held = [[], [], [], [], []], 0
        yield _piece_batch(columns)


def _piece_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "n"])


def matrix_group(group: pa.Table, capacity: int, pad_id: int, width: int) -> pa.Table:
    """The order is fixed before packing, so a repeated task gives the same rows. Ids are compared only where all else is equal."""
    base = group["bin_group"][0].as_py() << 32
    doc_ids, starts, lengths, ids, copies = (group[c].to_pylist() for c in ("doc_id", "start", "length", "ids", "copies"))
    order = sorted(range(len(ids)), key=lambda i: (-lengths[i], doc_ids[i] is None, doc_ids[i] or 0, starts[i], ids[i]))
    order = [i for i in order for _ in range(copies[i])]
    place_width = 2 if capacity <= 1 << 16 else 4
    place = np.arange(capacity, dtype=f"<u{place_width}").tobytes()
    pad = np.full(capacity, pad_id, f"<u{width}").tobytes()
    columns: dict[str, list] = {name: [] for name, _ in ROW}
    for found, places in enumerate(best_fit_decreasing([lengths[i] for i in order], capacity)):
        items = [order[p] for p in places]
        own = [lengths[i] for i in items]
        ends = [0, *accumulate(own)]
        rest = capacity - ends[-1]
        row = (
            base + found, b"".join([*(ids[i] for i in items), pad[: width * rest]]), width, ends[-1], ends,
            b"".join(place[: place_width * n] for n in (*own, rest)), [doc_ids[i] for i in items], [starts[i] for i in items],
        )
        for values, value in zip(columns.values(), row, strict=True):
            values.append(value)
    return pa.table([pa.array(columns[name], kind) for name, kind in ROW], names=[name for name, _ in ROW])


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the rows of token_matrices as id matrices with an index: two Parquet tables below path, which must not exist.

    `matrix` holds the rows, ids and positions all of one width, in order of sequence_id in each file; matrices()
    gives a file's rows as arrays. `index` holds a row for each segment, in order of doc_id in each file: doc_id, start, sequence_id,
    offset, length. Nulls and repeats of doc_id stay; no rows give empty tables.
    """
    packed.sortWithinPartitions("sequence_id").write.option("compression", "zstd").parquet(f"{path}/matrix")
    # from what was written, so both agree and nothing is tokenized again
    written = packed.sparkSession.read.schema(packed.schema).parquet(f"{path}/matrix")
    segments = written.select("sequence_id", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts")).alias("place", "segment"))
    offset = F.get("cu_seqlens", F.col("place"))
    index = segments.select(
        F.col("segment.doc_ids").alias("doc_id"), F.col("segment.starts").alias("start"), "sequence_id", offset.alias("offset"), (F.get("cu_seqlens", F.col("place") + 1) - offset).alias("length")
    )
    index.sortWithinPartitions("doc_id", "start").write.option("compression", "zstd").parquet(f"{path}/index")


def matrices(rows: pa.Table, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the positions of rows of `matrix`, as matrices of one row for each sequence."""
    width = rows["id_bytes"][0].as_py() if len(rows) else 4
    place_width = 2 if capacity <= 1 << 16 else 4
    made = (np.frombuffer(b"".join(rows[name].to_pylist()), f"<u{w}").reshape(-1, capacity) for name, w in (("ids", width), ("positions", place_width)))
    return tuple(made)
