"""Queries of chunking and ranking over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.operators import search
from billspark.session import spread, table

QUESTIONS = [(1, "payment plan without interest"), (2, "appeal denial letter deadline"), (3, "assistance application income documents income"), (4, "duplicate charge knee MRI")]


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return search.chunks(spread(table(spark, d, "documents").select("doc_id", "text")))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).drop("content")


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    return search.document_frequency(_chunks(spark, d))


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(_chunks(spark, d)).drop("n_tokens")


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(QUESTIONS, "query_id bigint, query string")
    return search.tfidf_topk(_chunks(spark, d), asked).drop("snippet")


def tfidf_documents(spark: SparkSession, d: str) -> DataFrame:
    """The best chunks for the text of every document whose id is divisible by 100."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").cast("bigint").alias("query_id"), F.col("text").alias("query"))
    return search.tfidf_topk(_chunks(spark, d), asked, broadcast=False, snippets=False)


QUERIES = {f.__name__: f for f in (chunk_documents, doc_frequency, term_frequency, tfidf_topk, tfidf_documents)}

_WORDS = "(SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '') AS w FROM documents WHERE text IS NOT NULL)"
_CHUNKS = f"(SELECT doc_id, (start // 450)::BIGINT AS chunk_index, w[start + 1 : start + 500] AS c FROM (SELECT doc_id, w, unnest(range(0, len(w), 450)) AS start FROM {_WORDS} WHERE len(w) > 0))"
_TOKENS = f"(SELECT doc_id, chunk_index, list_filter(regexp_extract_all(lower(array_to_string(c, ' ')), '[\\p{{L}}\\p{{N}}_]+'), lambda z: regexp_full_match(z, '[a-z0-9]+')) AS t FROM {_CHUNKS})"
_ASKED = "(SELECT query_id, unnest(string_split(lower(q), ' ')) AS term FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") v(query_id, q))"
SQL = {
    "chunk_documents": f"SELECT doc_id, chunk_index, len(c) AS n_words FROM {_CHUNKS}",
    "doc_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM {_TOKENS}) GROUP BY 1",
    "term_frequency": f"SELECT doc_id, chunk_index, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest(t) AS term FROM {_TOKENS}) GROUP BY ALL",
    "tfidf_topk": f"""WITH k AS MATERIALIZED (SELECT * FROM {_TOKENS}), n AS (SELECT count(*) AS n FROM k), a AS (SELECT query_id::BIGINT AS query_id, term, count(*) AS weight FROM {_ASKED} GROUP BY ALL),
  h AS (SELECT doc_id, chunk_index, len(t) AS n_tokens, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, t, unnest(t) AS term FROM k) WHERE term IN (SELECT term FROM a) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
  s AS (SELECT query_id, doc_id, chunk_index, round(sum(weight * tf / n_tokens * (ln((n + 1) / (df + 1)) + 1)), 4) AS score FROM h JOIN f USING (term) JOIN a USING (term), n GROUP BY ALL)
  SELECT query_id, rank, doc_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM s) WHERE rank <= 5""",
}
