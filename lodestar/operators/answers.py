"""Extractive answers: sentences of the best passages, scored by expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType
from pyspark.sql.window import Window, WindowSpec

from lodestar.functions import lexicon as L
from lodestar.functions import text as T



def _per_query() -> WindowSpec:
    """Made when asked for: Python workers import this module without a session."""
    return Window.partitionBy("query_id")


def _count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what))


def sentence_scores(ranked: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, chunk_id, pos, sentence, answer_score) for the sentences of the ``top`` passages.

    ``ranked``: query_id, chunk_id, rank, score, text.  ``queries``: query_id, text, clean, tokens, intent.
    Sentences of fewer than five words are dropped, and for factual queries list and redirect lines.
    """
    q = queries.select("query_id", F.col("clean").alias("q_clean"), F.col("tokens").alias("q"), "intent").withColumn("subject", F.filter("q", lambda t: ~t.isin(L.NO_SUBJECT)))
    s = ranked.filter(F.col("rank") <= top).select("query_id", "chunk_id", F.col("score").alias("passage"), F.posexplode(T.sentences("text")).alias("pos", "sentence")).join(q, "query_id")
    s = s.withColumn("c", T.normalize("sentence")).withColumn("st", T.tokens_of("c", T.detect_language("c"))).withColumn("w", F.size(T.split_words("c"))).withColumn("ws", F.size(T.words_ws("sentence")))
    factual = F.col("intent") == "factual"
    blocked = factual & (F.col("c").startswith("list of ") | F.col("c").contains(" redirect "))
    s = s.filter((F.col("ws") >= 5) & ~blocked)
    first = F.col("pos") == 0
    ov = T.overlap_share("q", "st")
    ex = ((F.col("q_clean") != "") & F.col("c").contains(F.col("q_clean"))).cast("double")
    cue = F.greatest(*[F.concat(F.lit(" "), F.col("c"), F.lit(" ")).contains(x) for x in L.VERB_CUES]).cast("double")
    defs = F.greatest(*[F.col("c").contains(x) for x in L.DEFINITION_CUES]).cast("double") * 0.35
    starts, holds = F.exists("subject", lambda t: F.col("c").startswith(t)), F.exists("subject", lambda t: F.col("c").contains(t))
    definition = F.when(F.col("c") == "", 0.0).otherwise(defs + F.when(starts, 0.45).when(holds, 0.2).otherwise(0.0) + F.when(factual & (F.col("w") <= 40), 0.15).otherwise(0.0))
    joined = F.array_join("subject", " ")
    head = F.array_join(F.slice(T.split_words("c"), 1, F.greatest(F.size("subject"), F.lit(3))), " ")
    share = F.size(F.filter("subject", lambda t: F.col("c").contains(t))) / F.greatest(F.size("subject"), F.lit(1)) * 0.4
    title = F.when((F.size("subject") == 0) | (F.col("c") == ""), 0.0).when(head == joined, 0.8).when(F.col("c").startswith(joined), 0.6).otherwise(share)
    numbers = F.size(F.filter(T.split_words("c"), lambda w: w.rlike("[0-9]")))
    brackets = _count(F.col("sentence"), r"[\[\]]")
    noise = F.when(F.col("c") == "", 0.0).otherwise(-(numbers * 0.04 + _count(F.col("sentence"), r"\|") * 0.12 + brackets * 0.03 + F.col("sentence").rlike("wikitable|sortable").cast("double") * 0.5))
    symbols = _count(F.col("sentence"), r"[^\p{IsAlphabetic}\p{N}\s]")
    quality = F.when(F.col("c") == "", -1.0).otherwise(
        -(
            (F.col("w") < 4).cast("double") * 0.7
            + (F.col("w") > 45).cast("double") * 0.35
            + (brackets > 4).cast("double") * 0.35
            + F.col("sentence").rlike("<ref|ref>").cast("double") * 0.25
            + (symbols > F.col("w") * 3).cast("double") * 0.2
            + (F.col("c").startswith("wikimedia ") | F.col("c").contains(" wikimedia ")).cast("double") * 0.08
        )
    )
    lead = F.when(first, 1.0).otherwise(0.0)
    f = factual.cast("double")
    base = F.col("passage") * 0.34 + ov * 0.3 + ex * 0.12 + lead * 0.12 + definition + lead * title + F.greatest(ov, ex) * 0.12 * f + cue * 0.2 * f + noise + quality
    scale = F.when(F.col("intent") == "list", 32.0).when(F.col("intent") == "comparison", 28.0).otherwise(25.0)
    shape = F.when(factual, 1 / (1 + F.abs(F.col("ws") - 18) / 18)).otherwise(1 / (1 + F.col("ws") / scale))
    return s.withColumn("answer_score", base * shape).select("query_id", "chunk_id", "pos", "sentence", "answer_score")


def best_answers(scores: DataFrame, k: int = 1) -> DataFrame:
    """(query_id, answer, confidence, level, source): the best sentences."""
    w = _per_query().orderBy(F.round("answer_score", 9).desc(), "chunk_id", "pos")
    out = scores.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    return out.select("query_id", F.col("n").alias("place"), F.col("sentence").alias("answer"), T.confidence("answer_score").alias("confidence"), T.confidence_level("answer_score").alias("level"), F.col("chunk_id").alias("source"))


def answer_or_first(queries: DataFrame, answers: DataFrame, results: DataFrame) -> DataFrame:
    """The best answer, else the first result with a confidence of 0.35."""
    top = results.filter("rank = 1").select("query_id", F.col("text").alias("r_text"), F.col("chunk_id").alias("r_id"))
    a = answers.filter("place = 1")
    j = queries.select("query_id").join(a, "query_id", "left").join(top, "query_id", "left")
    return j.select("query_id", F.coalesce("answer", "r_text").alias("answer"), F.coalesce("confidence", F.when(F.col("r_id").isNotNull(), 0.35)).alias("confidence"), F.coalesce("source", "r_id").alias("source")).filter("answer is not null")


def shortest_span(words: list[str], norms: list[str], need: list[str]) -> tuple[int, int] | None:
    """[start, end) of the shortest run of words covering all needed tokens."""
    need_set, best, left, have = set(need), None, 0, {}
    if not need_set or not need_set <= set(norms):
        return None
    for right, n in enumerate(norms):
        if n in need_set:
            have[n] = have.get(n, 0) + 1
        while len(have) == len(need_set):
            if best is None or right + 1 - left < best[1] - best[0]:
                best = (left, right + 1)
            m = norms[left]
            if m in have:
                have[m] -= 1
                if not have[m]:
                    del have[m]
            left += 1
    return best


@pandas_udf(StringType())
def span_text(sentence: pd.Series, tokens: pd.Series) -> pd.Series:
    """The shortest covering span of a sentence, or the sentence if a token is missing."""
    import re

    out = []
    for s, q in zip(sentence, tokens):
        ws = (s or "").split()
        norms = [re.sub("[^a-z0-9]+", " ", w.lower()).strip() for w in ws]
        at = shortest_span(ws, norms, list(q) if q is not None else [])
        out.append(" ".join(ws[at[0] : at[1]]) if at else (s or "").strip())
    return pd.Series(out)


def web_answers(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, sentence, span, confidence): per query the passage sentence of the greatest confidence.

    Within a passage the sentence with the greatest overlap wins, then the one with the shorter span.
    """
    q = queries.select("query_id", T.tokenize_web("text").alias("q"))
    s = ranked.select("query_id", "chunk_id", "score", F.posexplode(T.sentences_web("text")).alias("pos", "sentence")).join(q, "query_id")
    s = s.withColumn("overlap", T.overlap_share("q", T.tokenize_web("sentence"))).withColumn("span", span_text("sentence", "q")).withColumn("span_words", F.size(T.words_ws("span")))
    w = Window.partitionBy("query_id", "chunk_id").orderBy(F.col("overlap").desc(), "span_words", "pos")
    best = s.withColumn("n", F.row_number().over(w)).filter("n = 1").withColumn("confidence", F.col("score") + F.col("overlap"))
    v = _per_query().orderBy(F.round("confidence", 9).desc(), "chunk_id")
    return best.withColumn("n", F.row_number().over(v)).filter("n = 1").select("query_id", "chunk_id", "sentence", "span", "confidence")


def demo_answers(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Over all sentences the best of 0.6 rank score + 0.4 overlap."""
    q = queries.select("query_id", T.tokenize_web("text").alias("q"))
    s = ranked.select("query_id", "chunk_id", "score", F.posexplode(T.sentences_web("text")).alias("pos", "sentence")).join(q, "query_id")
    s = s.withColumn("value", F.col("score") * 0.6 + T.overlap_share("q", T.tokenize_web("sentence")) * 0.4)
    w = _per_query().orderBy(F.round("value", 9).desc(), "chunk_id", "pos")
    return s.withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "chunk_id", "sentence", "value")
