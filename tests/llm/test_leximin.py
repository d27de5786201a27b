import random

from lodestar.llm.leximin import brute_force, leximin_top

SCHEMA = "q bigint, c string, a double, b double, n int, place int"
NAN = float("nan")


def rows():
    rnd = random.Random(5)
    out = []
    for q in (1, 2, 3):
        for i in range(30):
            out.append((q, f"c{i:02}", rnd.choice([None, NAN, 0.0, 0.0, rnd.random() * 10**q]), rnd.choice([None, 1.0, rnd.random()]), 7, 7))
    return [*out, (4, "only", None, NAN, 7, 7)]


def ranked(spark, rs, **kw):
    out = {}
    for r in leximin_top(spark.createDataFrame(rs, SCHEMA), "q", "c", ["a", "b"], **kw).collect():
        out.setdefault(r.q, []).append((r.place, r.c))
    return {q: [c for _, c in sorted(v)] for q, v in out.items()}


def test_matches_brute_force(spark):
    assert ranked(spark, rows()) == brute_force([r[:4] for r in rows()], 2)


def test_hot_groups_take_the_block_path_with_the_same_result(spark):
    assert ranked(spark, rows(), hot_rows=5) == brute_force([r[:4] for r in rows()], 2)


def test_top_k_and_empty(spark):
    assert {q: v[:4] for q, v in brute_force([r[:4] for r in rows()], 2).items()} == ranked(spark, rows(), k=4)
    assert leximin_top(spark.createDataFrame([], SCHEMA), "q", "c", ["a", "b"]).count() == 0
