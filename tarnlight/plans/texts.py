"""Text columns: fields of pages, word counts, repeated values, ordered lists, dot products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators.vectors import nearest
from tarnlight.sources import table


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title element of each page, null where there is none (regular expression)."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.btrim(title), F.lit("")).alias("title"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the host of their address (parsed field, grouped)."""
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n_pages"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of the conversations occurs, and in how many turns (split and unnest; partial sums before the shuffle)."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select("conv_id", "turn", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word != ''")
    own = words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    return own.groupBy("word").agg(F.sum("n").alias("n_places"), F.count("*").alias("n_turns"))


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents have, by digest (group and having)."""
    counts = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_id"))
    return counts.filter("n_documents > 1")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50, the other one with the largest dot product, the lower id on ties.

    All rows are compared with all queries, in groups of bounded size that each hand on one row a query.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")))


def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of each conversation in order of its turns (ordered list)."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["role"]), ",").alias("roles"))


QUERIES = {
    "page_titles": (page_titles, r"select page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title from pages"),
    "page_hosts": (page_hosts, "select nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') as host, count(*) as n_pages from pages group by 1"),
    "word_counts": (
        word_counts,
        r"""with w as (select conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as word from conversations)
        select word, count(*) as n_places, count(distinct (conv_id, turn)) as n_turns from w where word != '' group by 1""",
    ),
    "repeated_texts": (repeated_texts, "select md5(text) as digest, count(*) as n_documents, min(doc_id) as first_id from documents group by 1 having count(*) > 1"),
    "nearest_vectors": (
        nearest_vectors,
        """with p as (select q.vec_id as query_id, e.vec_id, round(list_dot_product(cast(q.embedding as double[]), cast(e.embedding as double[])), 6) as product
        from embeddings q join embeddings e on q.vec_id != e.vec_id where q.vec_id % 50 = 0)
        select query_id, vec_id, product from (select *, row_number() over (partition by query_id order by product desc, vec_id) as place from p) where place = 1""",
    ),
    "conversation_roles": (conversation_roles, "select conv_id, string_agg(role, ',' order by turn) as roles from conversations group by 1"),
}
