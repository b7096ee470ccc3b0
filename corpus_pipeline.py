"""A corpus from raw documents to packed sequences: each stage's Parquet output is the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm.line_dedup import line_dedup
from tarnlight.llm.minhash import drop_near_duplicates
from tarnlight.llm.mixing import pareto_mix
from tarnlight.llm.packing import pack_documents
from tarnlight.llm.quality_rules import keep_quality
from tarnlight.llm.staging import Workspace

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: by their posterior if they have few words too, since a short document is not thereby a bad one."""
    return keep_quality(docs, min_words=1).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in 10 documents or more go; a document of which nothing stays keeps its row, with an empty text."""
    return _documents(line_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, so the sources come near their target weights."""
    mixed = pareto_mix(docs).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("mixing to target weights", mix_stage),
    ("packing", pack_stage),
]

#: The odd sketches, the estimated posteriors and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written and read again before the next."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
