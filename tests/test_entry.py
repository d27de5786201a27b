import re

import __spark_entry__ as entry


def test_every_check_belongs_to_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60 and "bm25_topk" in q


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"query_id", "chunk_id", "score"} <= set(rows[0].asDict())


def test_no_local_checkpoint():
    from pathlib import Path

    root = Path(entry.__file__).parent / "lodestar"
    for p in root.rglob("*.py"):
        text = p.read_text(encoding="utf-8")
        assert not re.search(r"\.localCheckpoint\(", text)
        if "llm" not in p.parts:
            assert "lodestar.llm" not in text
