"""Operator 9: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.llm.batches import bound_batches, column, texts
from tarnlight.llm.byte_pairs import counter
from tarnlight.llm.shipping import remote


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of docs(doc_id, text).

    A map over the rows without any shuffle. A null or empty text has 0 bytes and 0 tokens; a null
    doc_id stays null; repeated rows are counted each; other columns are ignored. The strings of
    special tokens inside a text count as one token each, as the library has it by default.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(remote(__name__, "count_batches", tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = counter(path)
    for batch in batches:
        sizes, counts = [], []
        for text in texts(batch):
            sizes.append(len(text.encode()))
            counts.append(tokens.count(text))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
