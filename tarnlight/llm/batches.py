"""Reading Arrow batches in the Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch grow far beyond 8 MB, whatever the texts' lengths; keep a smaller bound."""
    number = spark.conf.get(BATCH_SETTING).lower().rstrip("b")
    if not number.isdigit() or int(number) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts' UTF-8 bytes; a null gives no bytes."""
    for value in column(batch, name).cast(pa.binary()):
        yield value.as_py() or b""


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    for value in column(batch, name):
        yield value.as_py() or ""


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker, which is used again, returns the memory that it has freed to the system."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
            trim(0)
