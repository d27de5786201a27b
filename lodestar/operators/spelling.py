"""Vocabulary buckets and spelling correction of query terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vocabulary(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, first, bytes): distinct terms with the keys they are looked up by."""
    return terms.select(F.col(term).alias("term")).filter("term is not null and term <> ''").distinct().withColumn("first", F.substring("term", 1, 1)).withColumn("bytes", F.octet_length("term"))


def correct(qterms: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, pos, term, corrected): unknown terms of three bytes or more become the nearest term.

    Candidates share the first letter and differ by at most one byte in length; the distance is at most
    two; ties go to the shorter, then the alphabetically first.  An equi-join on (first, bytes).
    """
    known = vocab.select(F.col("term").alias("known"))
    q = qterms.join(known, qterms.term == F.col("known"), "left")
    unknown = q.filter(F.col("known").isNull() & (F.octet_length("term") >= 3)).select("query_id", "pos", "term")
    asked = unknown.select("term").distinct().select("term", F.substring("term", 1, 1).alias("first"), F.explode(F.array(*[(F.octet_length("term") + d) for d in (-1, 0, 1)])).alias("bytes"))
    near = asked.join(vocab.withColumnRenamed("term", "cand"), ["first", "bytes"]).withColumn("d", F.levenshtein("term", "cand", 2)).filter("d between 0 and 2")
    w = Window.partitionBy("term").orderBy("d", F.length("cand"), "cand")
    best = near.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("term", F.col("cand").alias("corrected"))
    return qterms.join(best, "term", "left").select("query_id", "pos", "term", F.coalesce("corrected", "term").alias("corrected"))
