import json

import pytest

from lodestar import packs
from lodestar.config import Chunking, Config
from lodestar.engine import Engine
from lodestar.index import Index
from lodestar.operators import evaluation
from lodestar.streaming import ingest

DOCS = [
    ("1", "BM25 is a ranking function used by search engines. It normalizes term frequency by document length."),
    ("2", "Vector search uses embeddings to capture semantic similarity between query and document."),
    ("3", "Hybrid ranking combines keyword and semantic scores for better retrieval quality."),
    ("4", "Answer extraction returns the most relevant sentence from a passage."),
    ("5", "Offline-first search stores data on device and syncs when online."),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    ix = Index(spark, str(tmp_path_factory.mktemp("ix")))
    assert ix.add(spark.createDataFrame(DOCS, "doc_id string, text string")) == 5
    return ix


def test_search(index):
    e = Engine(index)
    out = e.search("what is bm25")
    assert out["results"][0]["id"] == "1::chunk1" and out["answer"]["text"].startswith("BM25 is a ranking function")
    assert e.search("What is  BM25") is out
    assert e.search("what is vectro search")["results"][0]["id"] == "2::chunk1"
    assert e.search("  ") == {"answer": None, "answers": [], "results": []}


def test_evaluation_set(spark, index):
    q = spark.createDataFrame([(0, "what is bm25", ["1"]), (1, "what is vector search", ["2"]), (2, "hybrid ranking signals", ["3"])], "query_id int, text string, relevant array<string>")
    out = Engine(index).search_many(q)
    m = evaluation.report(evaluation.metrics(q, out["results"])).first()
    assert m.mrr == 1.0 and m.recall == 1.0 and m.precision == pytest.approx(0.1)


def test_changes(spark, tmp_path):
    cfg = Config(chunking=Chunking(3, 6, 4), vector_enabled=False)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    ix = Index(spark, str(tmp_path / "a"), cfg)
    ix.add(docs(DOCS[:3]), batch="x")
    ix.add(docs(DOCS[3:]))
    assert ix.add(docs(DOCS[:3]), batch="x") == 0 and ix.add(docs(DOCS[:2])) == 0
    assert ix.delete(spark.createDataFrame([("2",), ("1::chunk1",), ("none",)], "id string")) == 1 + ix.chunks().filter("doc_id = '2'").count()
    v = ix.version
    assert "1::chunk1" not in [r["id"] for r in Engine(ix).search("bm25 ranking function")["results"]]
    ix = Index(spark, str(tmp_path / "a"), cfg)
    before = sorted(r.chunk_id for r in ix.live().collect())
    ix.compact()
    assert ix.version > v and sorted(r.chunk_id for r in ix.chunks().collect()) == before and ix.deleted().count() == 0
    assert ix.validate("hybrid ranking") == []
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path / "a"), Config())


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ix = Index(spark, str(tmp_path / "ix"), Config(vector_enabled=False))
    put = lambda name, rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
    put("1.json", [{"op": "add", "id": i, "text": t} for i, t in DOCS])
    ingest.follow(spark, ix, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
    put("2.json", [{"op": "delete", "id": "5"}, {"op": "add", "id": "6", "text": "A new text about mills."}, {"op": "add", "id": "7"}])
    ingest.follow(spark, ix, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.doc_id for r in ix.live().collect()) == ["1", "2", "3", "4", "6"]
    ingest.follow(spark, ix, str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
    assert ix.live().count() == 5


def test_packs(spark, tmp_path):
    root = str(tmp_path / "packs")
    m = packs.pack(spark, spark.createDataFrame(DOCS, "doc_id string, text string"), root, per_shard=2, cfg=Config(vector_enabled=False))
    assert [s["docs"] for s in m["languages"][0]["shards"]] == [2, 2, 1]
    assert packs.pack_info(spark, root).first().docs == 5
    assert packs.validate_pack(spark, root, "bm25", Config(vector_enabled=False)) == []
    assert packs.select_shards(spark, m, "en", "default").count() == 3 and packs.select_shards(spark, m, "en", "none").count() == 1
    assert len(packs.export_packs(root, str(tmp_path / "out"))) == 3
    assert packs.load_manifest(spark, str(tmp_path / "nowhere"))["languages"] == []


def test_updates_keep_the_new_text(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    texts = lambda ix: {r.doc_id: r.text for r in ix.live().collect()}
    ix = Index(spark, str(tmp_path / "u"), Config(vector_enabled=False))
    ix.add(docs([("a", "the old mill"), ("b", "the old pier")]))
    ix.delete(ids("a"))
    assert ix.add(docs([("a", "a new granary")])) == 1 and texts(ix) == {"a": "a new granary", "b": "the old pier"}
    assert [r["id"] for r in Engine(ix).search("granary")["results"]] == ["a::chunk1"] and Engine(ix).search("mill")["results"] == []
    assert ix.update(docs([("b", "a new harbour")])) == 1 and texts(ix) == {"a": "a new granary", "b": "a new harbour"}
    batch = spark.createDataFrame([("delete", "a", None), ("add", "a", "third text"), ("add", "c", "fresh text"), ("update", "b", "last text")], "op string, id string, text string")
    ingest.apply_changes(ix, batch, "x")
    ingest.apply_changes(ix, batch, "x")
    want = {"a": "third text", "b": "last text", "c": "fresh text"}
    assert texts(ix) == want
    ix.delete(ids("c"))
    ix = Index(spark, str(tmp_path / "u"), Config(vector_enabled=False))
    ix.compact()
    del want["c"]
    assert texts(ix) == want == {r.doc_id: r.text for r in ix.chunks().collect()} and ix.term_stats().filter("term = 'mill'").count() == 0


def test_a_crash_before_publishing_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from lodestar import index as module

    docs = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    ix = Index(spark, str(tmp_path / "c"), Config(vector_enabled=False))
    ix.add(docs(DOCS[:2]))
    monkeypatch.setattr(module, "publish_version", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ix.update(docs([("1", "never seen"), ("9", "never seen")]))
    monkeypatch.undo()
    again = Index(spark, str(tmp_path / "c"), Config(vector_enabled=False))
    assert again.version == ix.version == 1 and {r.doc_id: r.text for r in again.live().collect()} == dict(DOCS[:2])
    assert again.update(docs([("1", "seen now")])) == 1 and again.live().filter("doc_id = '1'").first().text == "seen now"
    with pytest.raises(OSError):  # the other writer has not seen this version
        ix.add(docs(DOCS[3:]))


def test_search_reads_its_own_terms_only(spark, index):
    plan = index.term_stats(["bm25"])._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    assert index.memory().filter("part = 'vectors'").first().bytes == 5 * 388


def test_debug_breaks_the_score_down(spark, index):
    rows = Engine(index).debug("what is bm25")
    assert rows[0]["id"] == "1::chunk1" and set(rows[0]) == {"id", "score", "bm25", "semantic", "exact", "phrase", "proximity"}


def test_search_over_shards(spark, tmp_path):
    root = str(tmp_path / "packs")
    packs.pack(spark, spark.createDataFrame(DOCS, "doc_id string, text string"), root, per_shard=2)
    e = packs.ShardedEngine(spark, root)
    assert len(e.paths) == 3 and len(e.shards_of("what is bm25")) == 3 and len(e.shards_of("the semantic and keyword scores of it")) == 2
    out = e.search("what is bm25")
    assert out["results"][0]["id"] == "1::chunk1" and out["answer"]["source"] == "1::chunk1" and len({r["id"] for r in out["results"]}) == len(out["results"])
    assert packs.ShardedEngine(spark, str(tmp_path / "no")).search("x") == {"answer": None, "answers": [], "results": []}


def test_measured_report(spark, index):
    q = spark.createDataFrame([(0, "what is bm25", ["1"], "BM25 is a ranking function"), (1, "zzz", [], "none")], "query_id int, text string, relevant array<string>, expected string")
    m = evaluation.measured(Engine(index), q).first()
    assert m.queries == 2 and m.mrr == 0.5 and 0.4 < m.answer_accuracy <= 1 and m.max_ms >= m.avg_ms > 0 and m.memory_bytes > 0
