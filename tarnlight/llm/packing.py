"""Operator 2: first-fit-decreasing packing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, texts
from tarnlight.llm.byte_pairs import encoder
from tarnlight.llm.shipping import remote
from tarnlight.llm.staging import Workspace

PIECES_PER_GROUP = 4096
#: Copies of one piece that stay together when copies are dealt to groups.
COPIES = 64


class TournamentTree:
    """The free room of bins as the leaves of a tree whose inner nodes hold their children's maximum."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put the size into the leftmost bin with room for it and return that bin. There is one if bins >= items."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            left, right = room[2 * at], room[2 * at + 1]
            room[at] = left if left > right else right
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) for each size, all between 1 and the capacity; ties keep their order."""
    tree = TournamentTree(len(sizes), capacity)
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    filled: dict[int, int] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.first_fit(sizes[i])
        placed[i] = (found, filled.get(found, 0))
        filled[found] = placed[i][1] + sizes[i]
    return placed


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 1, group_size: int = PIECES_PER_GROUP) -> DataFrame:
    """Pack every document of docs(doc_id, text) into sequences of at most capacity tokens.

    A document's ids are its tokens, then end_id unless that is None. Ids are cut at multiples of the
    capacity; pieces go at random to groups of about group_size, and each group is packed on its own
    by first-fit decreasing. Equal pieces of one doc_id are counted first and their copies dealt in lots of COPIES, so
    however often a row is repeated, no group holds more than chance gives it. A sequence's id is its group times
    2^32 plus its bin, so the ids are unique and do not depend on the order of the rows.

    Returns for each piece doc_id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens, sequence_id and offset (gapless from 0 in each sequence). A null or empty text is the
    end_id alone; without end_id such a document has no piece. Repeated rows are packed each; a null
    doc_id stays null. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    space = Workspace(spark, "packing")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        remote(__name__, "cut_batches", tokenizer_path, capacity, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    cut = space.stage(cut, "pieces")
    groups = max(1, -(-cut.count() // group_size))
    lots = cut.groupBy(*cut.columns).agg(F.count("*").alias("n")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    dealt = lots.select(*cut.columns, F.least(F.lit(COPIES), F.col("n") - COPIES * F.col("lot")).cast("int").alias("copies"), F.pmod(F.xxhash64(*cut.columns, "lot"), F.lit(groups)).alias("bin_group"))
    return dealt.groupBy("bin_group").applyInArrow(
        remote(__name__, "pack_group", capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def cut_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int | None) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    tokens = encoder(path)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    for batch in batches:
        columns: list[list[int | None]] = [[] for _ in names]
        doc_ids, starts, lengths, crcs, totals = columns
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts(batch), strict=True):
            ids = tokens.encode_bytes(text) + tail
            for start in range(0, len(ids), 4 * capacity):
                piece = ids[start : start + 4 * capacity]
                doc_ids.append(doc_id)
                starts.append(start // 4)
                lengths.append(len(piece) // 4)
                crcs.append(zlib.crc32(piece))
                totals.append(len(ids) // 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack_group(group: pa.Table, capacity: int) -> pa.Table:
    """The order is fixed before packing, so a repeated task gives the same sequences."""
    base = group["bin_group"][0].as_py() << 32
    group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
    group = group.take(pa.array(np.repeat(np.arange(len(group)), group["copies"].to_numpy()))).drop_columns(["copies", "bin_group"])
    placed = np.array(first_fit_decreasing(group["length"].to_pylist(), capacity), np.int64)
    return group.append_column("sequence_id", pa.array(base + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))
