"""Hybrid ranking: BM25 and vector hits joined, features scored on the candidates only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window, WindowSpec

from lodestar.config import WEB_OVERRIDES, WEB_WEIGHTS, Weights
from lodestar.functions import lexicon as L
from lodestar.functions import text as T



def _per_query() -> WindowSpec:
    """Made when asked for: Python workers import this module without a session."""
    return Window.partitionBy("query_id")


def min_max(value: str, web: bool = False) -> Column:
    """(v - min) / max(range, 1e-6) per query; with ``web`` a zero range maps positive values to 1."""
    lo, hi = F.min(value).over(_per_query()), F.max(value).over(_per_query())
    if web:
        return F.when(hi == lo, (F.col(value) > 0).cast("double")).otherwise((F.col(value) - lo) / (hi - lo))
    return (F.col(value) - lo) / F.greatest(hi - lo, F.lit(1e-6))


def candidates(bm25: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer join of both hit lists with their scores normalised within their own list; a missing side is 0."""
    b = bm25.select("query_id", "chunk_id", F.col("score").alias("b")).withColumn("bm25", min_max("b")).select("query_id", "chunk_id", "b", "bm25")
    s = semantic.select("query_id", "chunk_id", F.col("score").alias("s")).withColumn("semantic", min_max("s")).select("query_id", "chunk_id", "s", "semantic")
    out = b.join(s, ["query_id", "chunk_id"], "full_outer")
    return out.select("query_id", "chunk_id", F.coalesce("b", F.lit(0.0)).alias("bm25_raw"), F.coalesce("s", F.lit(0.0)).alias("semantic_raw"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"))


def min_window(positions: list[list[int]]) -> int:
    """Length of the shortest stretch of words holding one of each position list; 0 if a list is empty."""
    if any(not len(p) for p in positions):
        return 0
    points = sorted((int(x), i) for i, p in enumerate(positions) for x in p)
    need, have, best, left = len(positions), {}, 0, 0
    for x, i in points:
        have[i] = have.get(i, 0) + 1
        while len(have) == need:
            y, j = points[left]
            width = x - y + 1
            best = width if not best else min(best, width)
            have[j] -= 1
            if not have[j]:
                del have[j]
            left += 1
    return best


@pandas_udf(DoubleType())
def proximity(tokens: pd.Series, positions: pd.Series, query: pd.Series) -> pd.Series:
    """1 / (1 + shortest window over all query tokens), 0 with fewer than two tokens or one missing.

    ``tokens`` and ``positions`` are parallel arrays; a repeated query token shares its positions.
    """
    out = np.zeros(len(tokens))
    for k, (t, p, q) in enumerate(zip(tokens, positions, query)):
        if q is None or len(q) < 2 or t is None:
            continue
        where: dict[str, list[int]] = {}
        for w, x in zip(t, p):
            where.setdefault(w, []).append(x)
        width = min_window([where.get(w, []) for w in q])
        out[k] = 1 / (1 + width) if width else 0.0
    return pd.Series(out)


def contains_share(text: Column, tokens: Column) -> Column:
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(F.filter(tokens, lambda t: text.contains(t))) / F.size(tokens))


def features(cands: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds exact, phrase, proximity, lead, title and the two penalties.

    ``queries``: query_id, clean, tokens, intent.  ``chunks``: chunk_id, clean, lang, tokens.
    """
    q = queries.select("query_id", F.col("clean").alias("q_clean"), F.col("tokens").alias("q"), "intent")
    j = cands.join(q, "query_id").join(chunks.select("chunk_id", "clean", "lang", "tokens"), "chunk_id")
    pos = T.token_positions("clean", "lang")
    factual, size = F.col("intent") == "factual", F.size("q")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    share = contains_share(F.col("clean"), F.col("q"))
    cue = F.greatest(*[F.col("clean").contains(c) for c in L.VERB_CUES])
    starts = F.when(size == 0, False).otherwise(F.forall("q", lambda t: F.col("clean").startswith(t)))
    title = share * 0.25 + starts.cast("double") * 0.35 + (F.col("clean") == F.array_join("q", " ")).cast("double") * 0.75
    empty = (size == 0) | (F.col("clean") == "")
    return j.withColumns(
        {
            "exact": ((F.col("q_clean") != "") & F.col("clean").contains(F.col("q_clean"))).cast("double"),
            "phrase": ((size > 0) & padded("tokens").contains(padded("q"))).cast("double"),
            "prox": proximity(F.transform(pos, lambda x: x["token"]), F.transform(pos, lambda x: x["pos"]), F.col("q")),
            "lead": F.when(empty, 0.0).otherwise(F.when(factual, share * 0.45 + cue.cast("double") * 0.25).otherwise(share * 0.2)) * 0.5,
            "title": F.when(empty, 0.0).otherwise(title * F.when(factual, 1.4).otherwise(1.0)),
            "namespace": F.when(factual & T.is_namespace_title("clean"), -0.25).otherwise(0.0),
            "listed": F.when(factual & (F.col("clean").startswith("list of ") | F.col("clean").contains(" list of ")), -0.20).otherwise(0.0),
        }
    )


def combine(scored: DataFrame, base: Weights = Weights()) -> DataFrame:
    """Weighted sum with the intent's weights; if the best stays below 0.15 and BM25 found anything, BM25 alone."""
    w = {k: F.lit(v) for k, v in base.__dict__.items()}
    for intent in ("factual", "list", "comparison"):
        w = {k: F.when(F.col("intent") == intent, getattr(base.for_intent(intent), k)).otherwise(v) for k, v in w.items()}
    extra = F.col("lead") + F.col("title") + F.col("namespace") + F.col("listed")
    out = scored.withColumn("proximity", F.col("prox") * w["proximity"] + extra)
    full = F.col("bm25") * w["bm25"] + F.col("semantic") * w["semantic"] + F.col("exact") * w["exact"] + F.col("phrase") * w["phrase"] + F.col("proximity")
    out = out.withColumn("full", full).withColumn("best", F.max("full").over(_per_query())).withColumn("any_bm25", F.max((F.col("bm25_raw") > 0).cast("int")).over(_per_query()))
    weak = (F.col("best") < 0.15) & (F.col("any_bm25") == 1)
    return out.withColumn("fallback", weak).withColumn("score", F.when(weak, F.col("bm25")).otherwise(F.col("full"))).filter(~F.col("fallback") | (F.col("bm25_raw") > 0))


def rank(scored: DataFrame, k: int | None = None) -> DataFrame:
    w = _per_query().orderBy(F.round("score", 9).desc(), "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def rank_web(cands: DataFrame, chunks: DataFrame, queries: DataFrame, extras: DataFrame) -> DataFrame:
    """The web profile: normalised over the union of candidates, exact, phrase, freshness, feedback.

    ``queries``: query_id, text.  ``chunks``: chunk_id, text.  ``extras``: query_id, chunk_id, freshness, feedback.
    """
    q = queries.select("query_id", T.normalize_web("text").alias("q_clean"), T.tokenize_web("text").alias("q"), T.classify_web("text").alias("kind"))
    j = cands.join(q, "query_id").join(chunks.select("chunk_id", T.normalize_web("text").alias("c"), T.tokenize_web("text").alias("t")), "chunk_id").join(extras, ["query_id", "chunk_id"], "left")
    pad = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    j = j.withColumns(
        {
            "nb": min_max("bm25_raw", web=True),
            "ns": min_max("semantic_raw", web=True),
            "exact": ((F.col("q_clean") != "") & F.col("c").contains(F.col("q_clean"))).cast("double"),
            "phrase": ((F.size("q") > 0) & pad("t").contains(pad("q"))).cast("double"),
        }
    )

    def weight(name: str) -> Column:
        out = F.lit(WEB_WEIGHTS[name])
        for kind, over in WEB_OVERRIDES.items():
            if name in over:
                out = F.when(F.col("kind") == kind, over[name]).otherwise(out)
        return out

    parts = {"bm25": F.col("nb"), "semantic": F.col("ns"), "exact": F.col("exact"), "phrase": F.col("phrase"), "freshness": F.coalesce("freshness", F.lit(0.0)), "feedback": F.coalesce("feedback", F.lit(0.0))}
    total = None
    for name, value in parts.items():
        total = value * weight(name) if total is None else total + value * weight(name)
    return rank(j.withColumn("score", total).select("query_id", "chunk_id", "kind", "nb", "ns", "exact", "phrase", "score"))


def rank_simple(cands: DataFrame, bm25: float = 0.7, semantic: float = 0.3) -> DataFrame:
    """The demo profile: two weights over scores normalised on the union."""
    out = cands.withColumn("nb", min_max("bm25_raw", web=True)).withColumn("ns", min_max("semantic_raw", web=True))
    return rank(out.withColumn("score", F.col("nb") * bm25 + F.col("ns") * semantic))


def without_phrases(rows: DataFrame, phrases: tuple[str, ...], text: str = "text") -> DataFrame:
    """The rows whose text holds none of the phrases, whatever the case."""
    return rows.filter(~F.greatest(*[F.lower(text).contains(p.lower()) for p in phrases], F.lit(False), F.lit(False)))
