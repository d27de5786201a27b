"""Clicks as events, counted at reading time; boosts, history, pending URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import feedback_boost, normalize_web


def click_counts(events: DataFrame, query: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """(doc, clicks) over all queries, and (query, doc, clicks)."""
    e = events.select(normalize_web(query).alias("query"), F.col(doc).alias("doc_id")).filter("doc_id is not null")
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("clicks")), e.groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("clicks"))


def boosts(cands: DataFrame, by_doc: DataFrame, by_query: DataFrame) -> DataFrame:
    """cands (query, doc_id) with ``feedback``."""
    g = by_doc.select("doc_id", F.col("clicks").alias("g"))
    q = by_query.select("query", "doc_id", F.col("clicks").alias("qc"))
    return cands.join(g, "doc_id", "left").join(q, ["query", "doc_id"], "left").withColumn("feedback", feedback_boost(F.col("g"), F.col("qc"))).drop("g", "qc")


def history(queries: DataFrame, query: str, ts: str, n: int = 10) -> DataFrame:
    """The n latest distinct non-blank queries, the most recent first."""
    return queries.filter(F.trim(F.coalesce(F.col(query), F.lit(""))) != "").groupBy(F.col(query).alias("query")).agg(F.max(ts).alias("last")).orderBy(F.col("last").desc(), "query").limit(n)


def pending(stored: DataFrame, failed: DataFrame) -> DataFrame:
    return stored.select("url").union(failed.select("url")).filter("url is not null").distinct()
