"""Inverted index as tables and BM25 over many queries at once.

``postings`` (term, chunk_id, tf, len) carry the passage length, so that scoring needs one join on
the term.  Queries are a table: a hot query or a hot term is just rows.  Per query the best k are
kept by a rank-limited window, which prunes on the map side before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", tokens: str = "tokens", terms: list[str] | None = None) -> DataFrame:
    """(term, chunk_id, len, tf), of all terms or of those named: then other terms are dropped before anything is shuffled."""
    each = chunks.select(F.col(chunk_id).alias("chunk_id"), F.size(tokens).alias("len"), F.explode(tokens if terms is None else F.filter(tokens, lambda t: t.isin(terms))).alias("term"))
    return each.groupBy("term", "chunk_id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row; passages without tokens count in both figures."""
    n = F.greatest(F.size(tokens), F.lit(0))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("total_len")).withColumn("avg_len", F.when(F.col("n") == 0, 0.0).otherwise(F.col("total_len") / F.col("n")))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def score(post: DataFrame, df: DataFrame, corpus: DataFrame, qterms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score); ``qterms`` (query_id, term) may repeat a term, which counts again."""
    asked = qterms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    hit = post.join(asked, "term")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0)))
    part = F.col("times") * idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / norm
    return hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score")).filter("score > 0")


def top_k(scores: DataFrame, k: int, order: str = "score") -> DataFrame:
    """The k best per query; equal scores (to 9 digits) by passage id.  Adds ``rank`` from 1."""
    w = Window.partitionBy("query_id").orderBy(F.round(order, 9).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_terms(queries: DataFrame, tokens: str = "tokens") -> DataFrame:
    return queries.select("query_id", F.explode(tokens).alias("term"))
