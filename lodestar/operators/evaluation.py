"""Retrieval metrics over many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize


def doc_part(chunk_id: Column) -> Column:
    return F.split_part(chunk_id, F.lit("::"), F.lit(1))


def metrics(queries: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, rr).  ``queries``: query_id, relevant array<string>; ``ranked``: query_id, rank, chunk_id.

    Hits are documents; a document counts where its best passage stands.  Precision divides by k.
    """
    per_doc = ranked.select("query_id", doc_part(F.col("chunk_id")).alias("doc"), "rank").groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))
    rel = queries.select("query_id", F.explode_outer(F.array_distinct("relevant")).alias("doc"))
    j = rel.join(per_doc, ["query_id", "doc"], "left").groupBy("query_id").agg(
        F.count("doc").alias("n"), F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first")
    )
    return j.select(
        "query_id",
        (F.col("hits") / k).alias("precision"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.col("hits") / F.col("n")).alias("recall"),
        F.when(F.col("first").isNull(), 0.0).otherwise(1 / F.col("first")).alias("rr"),
    )


def answer_accuracy(pairs: DataFrame) -> DataFrame:
    """(query_id, accuracy): share of expected tokens present in the answer.  ``pairs``: query_id, expected, answer."""
    e, a = tokenize("expected"), tokenize(F.coalesce("answer", F.lit("")))
    return pairs.select("query_id", e.alias("e"), a.alias("a")).select("query_id", F.when(F.size("e") <= 0, 0.0).otherwise(F.size(F.filter("e", lambda t: F.array_contains("a", t))) / F.size("e")).alias("accuracy"))


def report(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


def measured(engine, queries: DataFrame, k: int = 10, timed: int = 100) -> DataFrame:
    """One row of an engine over a stated set (query_id, text, relevant, expected): queries, precision, recall, mrr, answer_accuracy, avg_ms, max_ms, memory_bytes.

    All queries run as one job.  Latency is that of single searches, of the first ``timed`` queries by id: each is a
    job of its own, so a large set is timed in part.
    """
    import time

    out = engine.search_many(queries)
    acc = answer_accuracy(queries.join(out["answer"], "query_id", "left").select("query_id", "expected", "answer")).agg(F.avg("accuracy").alias("answer_accuracy"))
    took = []
    for r in queries.orderBy("query_id").limit(timed).select("text").collect():
        began = time.perf_counter()
        engine.search(r.text or "")
        took.append(1000 * (time.perf_counter() - began))
    size = engine.index.memory().agg(F.sum("bytes").alias("memory_bytes"))
    row = report(metrics(queries, out["results"], k)).crossJoin(acc).crossJoin(size)  # one row each
    return row.withColumns({"avg_ms": F.lit(sum(took) / max(1, len(took))), "max_ms": F.lit(max(took, default=0.0))})


def worst(accuracy: DataFrame, n: int = 3) -> DataFrame:
    return accuracy.orderBy("accuracy", "query_id").limit(n)
