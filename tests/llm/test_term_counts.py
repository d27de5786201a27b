import datetime as dt

from pyspark.sql import functions as F

from lodestar.llm.term_counts import TermCountStore, build_from_history

T = [dt.datetime(2025, 1, d) for d in range(1, 9)]
SCHEMA = "chunk_id string, tokens array<string>, indexed_at timestamp, term string, dead boolean"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", len(r) > 3 and r[3]) if len(r) == 3 else (*r[:3], "clash", r[3]) for r in rows], SCHEMA)


def got(store):
    return {r.term: (r.occurrences, r.records) for r in store.counts().collect()}


def brute(rows):
    valid = {}
    for r in rows:
        if r[0] is not None and (r[0] not in valid or r[2] >= valid[r[0]][2]):
            valid[r[0]] = r
    out = {}
    for r in valid.values():
        if len(r) > 3 and r[3]:
            continue
        terms = [t for t in r[1] or [] if t]
        for t in set(terms):
            o, n = out.get(t, (0, 0))
            out[t] = (o + terms.count(t), n + 1)
    return out, sum(not (len(r) > 3 and r[3]) for r in valid.values())


ROWS = [
    ("a", ["x", "x", "y", None, ""], T[0]),
    ("b", ["y"], T[0]),
    ("c", None, T[1]),
    ("d", [], T[1]),
    (None, ["z"], T[1]),
    ("a", ["x", "w"], T[4]),
    ("b", ["y"], T[5]),
    ("e", ["x"], T[5]),
    ("e", ["x"], T[5]),
]


def test_batches_equal_a_rebuild(spark, tmp_path):
    want, n = brute(ROWS)
    one = TermCountStore(spark, str(tmp_path / "one"))
    one.apply(table(spark, ROWS), "chunk_id", "tokens", "indexed_at")
    assert (got(one), one.n_records()) == (want, n)
    many = TermCountStore(spark, str(tmp_path / "many"))
    for lo in range(0, len(ROWS), 3):
        many = TermCountStore(spark, str(tmp_path / "many"))  # state is read back from the folder
        many.apply(table(spark, ROWS[lo : lo + 3]), "chunk_id", "tokens", "indexed_at")
    assert (got(many), many.n_records()) == (want, n)
    many.apply(table(spark, ROWS[:3]), "chunk_id", "tokens", "indexed_at")  # stale rows change nothing
    assert got(many) == want
    many.compact()
    assert (got(TermCountStore(spark, str(tmp_path / "many"))), many.n_records()) == (want, n)


def test_deletes_and_empty(spark, tmp_path):
    s = TermCountStore(spark, str(tmp_path / "s"))
    s.apply(table(spark, ROWS).limit(0), "chunk_id", "tokens", "indexed_at")
    assert (got(s), s.n_records()) == ({}, 0)
    s.apply(table(spark, ROWS), "chunk_id", "tokens", "indexed_at")
    s.apply(table(spark, [("a", None, T[6], True), ("zz", None, T[6], True)]), "chunk_id", "tokens", "indexed_at", F.col("dead"))
    want, n = brute([*ROWS, ("a", None, T[6], True), ("zz", None, T[6], True)])
    assert (got(s), s.n_records()) == (want, n)


def test_history_in_two_batches_and_marks(spark):
    s = build_from_history(spark, table(spark, ROWS), "chunk_id", "tokens", "indexed_at")
    assert (got(s), s.n_records()) == brute(ROWS)
    marks = {r.term: r.mark for r in s.marked(rare_at_most=1, common_share=0.3).collect()}
    assert marks == {"x": "common", "w": "rare", "y": "rare"}


def test_reconcile_names_what_is_wrong(spark):
    from lodestar.llm.term_counts import reconcile

    chunks = spark.createDataFrame([("1", "a", ["x", "y", "x", None, ""], 1), ("1", "b", ["x", "z"], 2), ("2", "a", ["y", "w", "v"], 1), ("3", "a", None, 1), (None, "a", ["q"], 1)], "id string, shard string, toks array<string>, at int")
    meta = spark.createDataFrame([("b", "x", 1), ("b", "z", 7), ("a", "y", None), ("a", "w", 1), ("a", "w", 1), ("a", "gone", 3), ("a", None, 1)], "shard string, term string, df bigint")
    got = {(r.shard, r.term): (r.state, r.stored, r.true) for r in reconcile(meta, chunks, "id", "toks", "at").collect()}
    assert got == {("b", "x"): ("ok", 1, 1), ("b", "z"): ("stale", 7, 1), ("a", "y"): ("unset", None, 1), ("a", "w"): ("repeated", 1, 1), ("a", "v"): ("missing", None, 1), ("a", "gone"): ("left_over", 3, 0)}
    assert reconcile(meta.limit(0), chunks.limit(0), "id", "toks", "at").count() == 0
