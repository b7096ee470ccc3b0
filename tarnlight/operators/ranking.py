"""Full-text ranking by an inverted index (BM25)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.operators import top_per_group
from tarnlight.scratch import Scratch

#: A term: a run of letters and digits of any script, in lower case.
TERM = r"[\p{L}\p{N}]+"
#: Query terms beyond this number meet the postings by sort and merge instead of a broadcast.
BROADCAST_TERMS = 200_000

#: Bytes of text that one bucket of an index is made from, about.
BUCKET_BYTES = 32_000_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


@dataclass
class TextIndex:
    """Postings in a folder, dealt to buckets by document and in order of term there: each document that has the term, how often, and the document's length."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, docs: DataFrame, folder: str) -> TextIndex:
        """Index docs(doc_id, text) into the folder.

        Rows with one doc_id are one document; a null text has no terms and length 0; rows without a doc_id are left out. Texts are shuffled once, by document; all that is
        counted then stays where it is. A bucket has about BUCKET_BYTES of text, and its postings stand in order of term, so row groups are skipped by their statistics.
        """
        spark = docs.sparkSession
        rows = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first().size
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        counted = rows.repartition(parts, "doc_id").select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        lengths = F.sum("tf").over(Window.partitionBy("doc_id"))
        scratch = Scratch(spark, "text-index")
        written = scratch.deal(counted.withColumn("length", lengths), "postings", "doc_id", parts, folder, ["term"])
        written.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
        n_docs = rows.select("doc_id").distinct().agg(F.count("*").alias("n_docs"))
        total = written.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"), F.lit(parts).alias("parts"), F.lit(docs.schema["doc_id"].dataType.simpleString()).alias("kind"))
        n_docs.join(F.broadcast(total), F.lit(True)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")  # two rows of a few numbers each
        scratch.forget()
        return cls(spark, folder)

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """query_id, place, doc_id, score: the k documents with the highest scores for each of queries(query_id, query), the lower doc_id on ties.

        A document's score is the sum over the query's distinct terms that it has of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), with idf =
        ln(1 + (documents - df + 0.5) / (df + 0.5)). Each part is rounded to 9 digits and added as a decimal, so scores do not depend on the order of
        rows. Only postings of the queries' terms are read into the join, so a document that shares no term is never scored; a query without known terms finds nothing.

        The queries' terms are counted; few are broadcast, and the parts of a document are then added up where its postings are read, all of them in one bucket: what is shuffled is each bucket's k best for a query. More are merged
        by term, where adaptive execution can split a frequent one. Rows of one query_id are one query.
        """
        n_docs, total, parts, kind = self.spark.read.parquet(f"{self.folder}/stats").select("n_docs", "total", "parts", "kind").first()
        scratch = Scratch(self.spark, "text-search")
        asked = queries.filter("query_id is not null").select("query_id", F.explode(terms(F.col("query"))).alias("term")).distinct()
        asked = asked.join(self.spark.read.parquet(f"{self.folder}/terms"), "term")
        idf = F.ln(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = scratch.write(asked.select("query_id", "term", idf.alias("idf")), "terms")
        n_terms = asked.count()
        asked = asked.hint("broadcast") if n_terms <= BROADCAST_TERMS else asked.hint("merge")
        postings = scratch.dealt(f"{self.folder}/postings", f"doc_id {kind}, term string, tf long, length long", "doc_id", parts)
        scratch.forget()
        met = postings.join(asked, "term")
        mean = max(total, 1) / max(n_docs, 1)
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
        scores = met.groupBy("query_id", "doc_id").agg(F.sum(F.round(part, 9).cast("decimal(18, 9)")).cast("double").alias("score"))
        best = top_per_group(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)
        return best.select("query_id", F.col("place").cast("long").alias("place"), "doc_id", F.round("score", 6).alias("score"))
