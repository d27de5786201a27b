import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import Chunking, Config
from lodestar.operators import answers, bm25, chunking, dedup, evaluation, ranking, shards, spelling, vectors


def loop_chunks(n, c, merge):
    words, out, at = list(range(n)), [], 0
    while n - at > c.max_words:
        take = min(c.target_words, c.max_words)
        out.append(words[at : at + take])
        at += take
    rest = words[at:]
    if rest:
        if merge and out and len(rest) < c.min_words:
            out[-1] += rest
        else:
            out.append(rest)
    return [len(x) for x in out]


@pytest.mark.parametrize("merge", [True, False])
def test_chunks_match_the_loop(spark, merge):
    c = Chunking(10, 20, 15)
    sizes = list(range(0, 90))
    df = spark.createDataFrame([(n, " ".join(["w"] * n) + " ") for n in sizes] + [(900, None), (901, " \n")], "doc_id int, text string")
    got = {}
    for r in chunking.chunk(df, c, merge=merge).orderBy("chunk_no").collect():
        got.setdefault(int(r.doc_id), []).append(len(r.text.split()))
    assert got == {n: loop_chunks(n, c, merge) for n in sizes if n}


def test_bm25_counts_repeated_query_terms(spark):
    ch = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "x", "z"]), ("c", [])], "chunk_id string, tokens array<string>")
    q = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, "none")], "query_id int, term string")
    post = bm25.postings(ch)
    got = {(r.query_id, r.chunk_id): r.score for r in bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(ch), q).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    assert got[2, "a"] == pytest.approx(2 * got[1, "a"])
    idf = np.log(1 + (3 - 2 + 0.5) / 2.5)
    assert got[1, "b"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3))))


def test_min_window():
    assert ranking.min_window([[0, 9], [5], [6, 20]]) == 5
    assert ranking.min_window([[3], [3]]) == 1
    assert ranking.min_window([[1], []]) == 0
    rnd = random.Random(1)
    for _ in range(100):
        lists = [[rnd.randint(0, 30) for _ in range(rnd.randint(1, 4))] for _ in range(3)]
        want = min(max(a, b, c) - min(a, b, c) + 1 for a in lists[0] for b in lists[1] for c in lists[2])
        assert ranking.min_window(lists) == want


def test_min_max_of_a_lone_hit(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 3.0)], "query_id int, v double")
    got = sorted(tuple(r) for r in df.select("query_id", ranking.min_max("v").alias("n"), ranking.min_max("v", web=True).alias("w")).collect())
    assert got == [(1, 0.0, 1.0), (2, 0.0, 0.0), (2, 1.0, 1.0)]


def test_worked_example(spark):
    from lodestar.plans.query_plan import analyse

    docs = spark.createDataFrame([("1", "BM25 is a ranking function used by search engines. It normalizes term frequency by document length."), ("2", "Vector search uses embeddings.")], "doc_id string, text string")
    ch = chunking.build(chunking.chunk(docs))
    plan = analyse(spark.createDataFrame([(1, "what is bm25"), (2, " ")], "query_id int, text string"))
    p = plan.collect()
    assert len(p) == 1 and p[0].tokens == ["bm25"] and p[0].expanded == ["bm25", "ranking", "tfidf", "tf-idf"] and p[0].intent == "factual"
    f = ranking.features(spark.createDataFrame([(1, "1::chunk1")], "query_id int, chunk_id string"), ch, plan).first()
    assert f.title == pytest.approx(0.84) and f.lead == pytest.approx(0.35) and f.exact == 0 and f.phrase == 1 and f.prox == 0
    w = Config().weights.for_intent("factual")
    assert (round(w.bm25, 3), round(w.semantic, 3), round(w.exact, 3), round(w.phrase, 3), w.proximity) == (0.575, 0.45, 0.96, 0.66, 0.4)


def test_near_dedup_is_greedy_in_order(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(300):
        sig = (rnd.randrange(4) << 60) | rnd.getrandbits(6)
        rows.append((i, sig - (1 << 64) if sig >= 1 << 63 else sig))
    kept, buckets = [], {}
    for i, s in rows:
        u = s & 0xFFFFFFFFFFFFFFFF
        b = buckets.setdefault(u >> 48, [])
        if all(bin(u ^ k).count("1") > 3 for k in b):
            b.append(u)
            kept.append(i)
    got = [r.k for r in dedup.near_dedup(spark.createDataFrame(rows, "k int, sig bigint"), "k").orderBy("k").collect()]
    assert got == kept
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x != y and bin((x ^ y) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3}
    firsts = {s: i for i, s in reversed(rows)}
    want = {(a, b) for a, b in want if a in firsts.values() and b in firsts.values()}
    assert {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(rows, "k int, sig bigint"), "k").collect()} == want


def test_simhash_and_exact_dedup(spark):
    df = spark.createDataFrame([(1, "A b."), (2, "a  B"), (3, ""), (4, None), (5, "c")], "k int, t string")
    sig = {r.k: r.sig for r in dedup.simhash(df, "k", "t").collect()}
    assert sig[1] == sig[2] and sig[3] == sig[4] == 0
    assert sorted(r.k for r in dedup.exact_dedup(df, "t", "k").collect()) == [1, 3, 5]
    assert dedup._fnv64("foobar") == 0x85944171F73967E8


def test_spelling(spark):
    v = spelling.vocabulary(spark.createDataFrame([("granary",), ("granite",), ("mill",)], "term string"))
    q = spark.createDataFrame([(1, 0, "granery"), (1, 1, "mill"), (1, 2, "mi"), (1, 3, "grxxxxy"), (1, 4, "xill")], "query_id int, pos int, term string")
    assert [r.corrected for r in spelling.correct(q, v).orderBy("pos").collect()] == ["granary", "mill", "mi", "grxxxxy", "xill"]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, e array<float>").select("id", vectors.unit("e").alias("v"))
    q = df.filter("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    full = {(r.query_id, r.rank): r.id for r in vectors.search_full(df, q, 5, "id").collect()}
    assert all(full[i, 1] == i for i in range(5))
    x = vectors.systematic_sample(df, "id", "v", 100)
    assert len(x) == 100
    c = vectors.kmeans_dot(x, 8, 4)
    ivf = vectors.search_ivf(vectors.ivf_assign(df, c, "id"), c, q, 5, "id", probes=8)
    assert {(r.query_id, r.rank): r.id for r in ivf.collect()} == full
    books = vectors.pq_train(x, 4, 64, 4)
    pq = {(r.query_id, r.id) for r in vectors.search_pq(vectors.pq_encode(df, books, "id"), books, q, 5, "id").collect()}
    assert sum((i, full[i, 1]) in pq for i in range(5)) >= 3
    z = df.select("v", vectors.quantize("v").alias("z")).collect()
    assert all(abs(a - b * r.z.scale) <= r.z.scale / 2 + 1e-9 for r in z for a, b in zip(r.v, r.z.q))
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "id int, v array<double>").select(vectors.quantize("v").alias("z")).first().z
    assert (list(zero.q), zero.scale) == ([0, 0], 1.0)


def test_embedding(spark):
    v = vectors.embed_one("ab", 384, 3, 5)
    assert (v * v).sum() == pytest.approx(1) and (v > 0).sum() == 3
    df = spark.createDataFrame([(1, "Old mill!"), (2, "old MILL"), (3, None), (4, "")], "k int, t string")
    got = {r.k: r.v for r in vectors.embed(df, "k", "t").collect()}
    assert got[1] == got[2] and got[3] == got[4]


def test_shards(spark):
    docs = spark.createDataFrame([(i,) for i in random.Random(1).sample(range(1000), 237)], "doc_id int")
    got = shards.assign(docs, "doc_id", 50, parts=7).orderBy("doc_id").collect()
    assert [r.shard for r in got] == [f"shard_{i // 50:04d}" for i in range(237)]
    m = spark.createDataFrame([(0, 70), (1, 20), (2, 50)], "pos int, bytes bigint")
    assert [r.pos for r in shards.within_budget(m, 95).collect()] == [0, 1]
    assert [r.pos for r in shards.within_budget(m, 10).collect()] == [0]
    s = spark.createDataFrame([(f"s{i}",) for i in range(5)], "shard string")
    assert sorted(r.shard for r in shards.pick(s, 13, 3).collect()) == ["s0", "s3", "s4"]


def test_evaluation(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["c"])], "query_id int, relevant array<string>")
    r = spark.createDataFrame([(1, 1, "x::chunk1"), (1, 2, "a::chunk2"), (1, 3, "a::chunk1"), (3, 12, "c::chunk1")], "query_id int, rank int, chunk_id string")
    got = {x.query_id: (x.precision, x.recall, round(x.rr, 4)) for x in evaluation.metrics(q, r).collect()}
    assert got == {1: (0.1, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0833)}


def test_spans_and_answers():
    assert answers.shortest_span(["a", "b", "c", "a"], ["a", "b", "c", "a"], ["c", "a"]) == (2, 4)
    assert answers.shortest_span(["a"], ["a"], ["z"]) is None and answers.shortest_span(["a"], ["a"], []) is None


def test_phrase_filter_takes_the_passages_of_every_document(spark, tmp_path):
    from lodestar.operators.ranking import without_phrases
    from lodestar.plans.catalog import queries

    t = spark.createDataFrame([(1, "Bm25 IS a ranking function"), (2, "the mill"), (3, "A Museum")], "n int, text string")
    assert [r.n for r in without_phrases(t, ("bm25 is a ranking function", "museum")).collect()] == [2]
    assert without_phrases(t, ()).count() == 3
    words = lambda i: f"The mill of place number {i} was built beside the old weir and has a wheel of oak."
    docs = [(i, words(i) if i % 4 else "Stopwords are common words. " + words(i), "en", "web/a", 80, None, None, None) for i in range(1, 11)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, ext_id string, meta map<string,string>, ingested_at timestamp").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.chunk_id.split("::")[0] for r in queries()["flt_noise_phrase_all"](spark, str(tmp_path)).collect()}
    assert got == {"1", "2", "3", "5", "6", "7", "9", "10"}
