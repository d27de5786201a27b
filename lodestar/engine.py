"""Search over an index: many queries in one job, or one query with a result cache."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.index import Index
from lodestar.operators import answers, bm25, ranking, spelling, vectors
from lodestar.plans.query_plan import analyse
from lodestar.runtime import materialize

#: Up to so many different terms are pushed to the scans of the index.
MOST_TERMS = 10_000


def retrieve(chunks: DataFrame, post: DataFrame, df: DataFrame, corpus: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 hits of analysed queries on the expanded tokens, as many as the intent asks for."""
    hits = bm25.score(post, df, corpus, bm25.query_terms(queries, "expanded"), k1, b)
    want = queries.select("query_id", F.when(F.col("intent") == "factual", 150).when(F.col("intent").isin("list", "comparison"), 100).otherwise(50).alias("k"))
    return bm25.top_k(hits, 150).join(want, "query_id").filter(F.col("rank") <= F.col("k")).drop("k")


class Engine:
    """``search`` answers one query, ``search_many`` a table of them."""

    def __init__(self, index: Index, cache: int = 100, ttl: float | None = None, drop_phrases: tuple[str, ...] = ()):
        """``cache`` results are kept, for ``ttl`` seconds if given; results holding one of ``drop_phrases`` are left out."""
        self.index, self.cache, self.ttl, self.drop_phrases = index, cache, ttl, drop_phrases
        self._hits: OrderedDict = OrderedDict()

    def _plan(self, queries: DataFrame, spell: bool) -> DataFrame:
        """The analysed queries, written: several steps read them.  Spelling reads only words of the letters and lengths asked for."""
        ix, vocab = self.index, None
        if spell:
            asked = analyse(queries).select(F.explode("tokens").alias("t")).filter("t <> ''").select(F.substring("t", 1, 1).alias("f"), F.octet_length("t").alias("n")).distinct().limit(MOST_TERMS + 1).collect()
            vocab = ix.terms()
            if len(asked) <= MOST_TERMS:
                vocab = vocab.filter(F.col("first").isin(sorted({r.f for r in asked})) & F.col("bytes").isin(sorted({r.n + d for r in asked for d in (-1, 0, 1)})))
            vocab = spelling.vocabulary(vocab)
        return materialize(analyse(queries, vocab), "plan")

    def _looked_up(self, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and document frequencies of the queries' terms: pushed to the scan while they are few, joined otherwise."""
        terms = [r.t for r in plan.select(F.explode("expanded").alias("t")).distinct().limit(MOST_TERMS + 1).collect()]
        if len(terms) > MOST_TERMS:
            return self.index.postings(), self.index.term_stats()
        return self.index.postings(sorted(terms)), self.index.term_stats(sorted(terms))

    def _semantic(self, plan: DataFrame, k: int) -> DataFrame:
        """The nearest passages by the inverted lists, by all vectors where the index has no lists."""
        ix, cfg = self.index, self.index.cfg
        q = materialize(vectors.embed(plan, "query_id", "text", cfg).withColumnRenamed("v", "q"), "embedded")
        if ix.centres() is None:
            return vectors.search_i8(ix.vectors(), q, k, "chunk_id")
        return vectors.search_ivf(ix.vectors(), ix.centres(), q, k, "chunk_id", cfg.ivf_probe, quantized=True)

    def search_many(self, queries: DataFrame, spell: bool = True, keep: int | None = None) -> dict[str, DataFrame]:
        """{plan, ranked, results, answers} as DataFrames.

        Tombstoned passages take part in retrieval and ranking and are dropped from the results.
        """
        ix, cfg = self.index, self.index.cfg
        plan = self._plan(queries, spell)
        post, stats = self._looked_up(plan)
        hits = retrieve(ix.chunks(), post, stats, ix.corpus_stats(), plan, cfg.k1, cfg.b)
        sem = self._semantic(plan, 150) if cfg.vector_enabled else hits.limit(0)
        c = ranking.candidates(hits, sem)
        ranked = ranking.rank(ranking.combine(ranking.features(c, ix.chunks(), plan), cfg.weights))
        live = ranked.join(ix.deleted(), "chunk_id", "left_anti").select("query_id", "chunk_id", "bm25", "semantic", "exact", "phrase", "proximity", "score")
        texts = ix.chunks().select("chunk_id", "text")  # the text is fetched last, for the kept rows only
        if self.drop_phrases:
            live = ranking.without_phrases(live.join(texts, "chunk_id"), self.drop_phrases).drop("text")
        top = ranking.rank(live, keep or cfg.results_k)
        with_text = top.join(texts, "chunk_id").join(plan.select("query_id", "tokens"), "query_id").withColumn("snippet", T.snippet("text", "tokens", cfg.snippet_chars))
        scores = answers.sentence_scores(with_text, plan)
        best = answers.best_answers(scores, 3)
        return {"plan": plan, "ranked": ranked, "results": with_text.drop("tokens"), "answers": best, "answer": answers.answer_or_first(plan, best, with_text)}

    def search(self, query: str) -> dict:
        """{answer, answers, results} of one query; blank queries give an empty response.  Cached until the index changes."""
        if not query.strip():
            return {"answer": None, "answers": [], "results": []}
        key = (" ".join(query.lower().split()), self.index.version)
        if key in self._hits and (self.ttl is None or time.monotonic() - self._hits[key][0] <= self.ttl):
            self._hits.move_to_end(key)
            return self._hits[key][1]
        spark = self.index.spark
        out = self.search_many(spark.createDataFrame([(0, query)], "query_id int, text string"))
        res = [{"id": r.chunk_id, "text": r.snippet, "score": r.score} for r in out["results"].orderBy("rank").collect()]
        ans = [{"text": r.answer, "confidence": r.confidence, "source": r.source} for r in out["answers"].orderBy("place").collect()]
        first = ans[0] if ans else {"text": res[0]["text"], "confidence": 0.35, "source": res[0]["id"]} if res else None
        self._hits[key] = (time.monotonic(), {"answer": first, "answers": ans, "results": res})
        while len(self._hits) > self.cache:
            self._hits.popitem(last=False)
        return self._hits[key][1]

    def debug(self, query: str) -> list[dict]:
        """Every ranked passage of one query with its score and what it is made of, hidden ones included; spelling is left as it is."""
        if not query.strip():
            return []
        ranked = self.search_many(self.index.spark.createDataFrame([(0, query)], "query_id int, text string"), spell=False)["ranked"]
        parts = ["score", "bm25", "semantic", "exact", "phrase", "proximity"]
        return [{"id": r.chunk_id, **{p: r[p] for p in parts}} for r in ranked.orderBy("rank").collect()]  # at most both candidate lists
