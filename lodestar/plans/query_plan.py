"""What a query asks for, as rows: one job analyses any number of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import spelling


def analyse(queries: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(query_id, text, clean, lang, tokens, expanded, intent); blank queries are left out.

    With a vocabulary unknown tokens are corrected before synonyms are added.
    """
    q = queries.select("query_id", F.col("text")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    q = q.withColumn("clean", T.normalize("text")).withColumn("lang", T.detect_language("text")).withColumn("intent", T.intent("text", "lang")).withColumn("tokens", T.tokens_of("clean", "lang"))
    if vocab is not None:
        fixed = spelling.correct(q.select("query_id", F.posexplode("tokens").alias("pos", "term")), vocab)
        fixed = fixed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "corrected"))), lambda x: x["corrected"]).alias("fixed"))
        q = q.join(fixed, "query_id", "left").withColumn("tokens", F.coalesce("fixed", "tokens")).drop("fixed")
    return q.withColumn("expanded", T.expand("tokens", "lang"))
