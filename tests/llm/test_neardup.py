import random

import numpy as np
import pytest

from lodestar.llm.neardup import NearDuplicates, brute_force, signatures

SCHEMA = "kind string, key bigint, text string, cls int, rep int, h int"


def corpus():
    rnd = random.Random(2)
    vocab = [f"t{i}" for i in range(500)]
    out, key = [], 0
    for n in (3, 4, 7, 15, 40, 120):
        for _ in range(4):
            base = [rnd.choice(vocab) for _ in range(n)]
            for edits in (0, 0, 1, 2, 4, 8):
                ws = list(base)
                for _ in range(min(edits, n // 3)):
                    at = rnd.randrange(len(ws))
                    rnd.choice([lambda: ws.insert(at, rnd.choice(vocab)), lambda: ws.__setitem__(at, rnd.choice(vocab)), lambda: ws.pop(at)])()
                key += 1
                out.append((rnd.choice(["x", "y"]), key, " ".join(ws)))
    out += [("x", 9001, None), ("x", 9002, ""), ("x", 9003, "two words"), ("x", 9004, "A b, C."), ("x", 9005, "a B c"), ("x", 9005, "a B c")]
    return out


@pytest.mark.parametrize("shingle,least", [(3, 0.6), (5, 0.8)])
def test_pairs_match_brute_force(spark, shingle, least):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows] + [("x", None, "a b c d e f", 0, 0, 0)], SCHEMA)
    nd = NearDuplicates(df, shingle, least)
    got = [tuple(r) for r in nd.pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_force(rows, shingle, least)
    links = {(r.kind, r.key): r.links for r in nd.members().collect()}
    assert len(links) == len({(k, i) for k, i, t in rows if t and len(t.split()) >= shingle})


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([("x", i, "the same words again and again", 0, 0, 0) for i in range(300)], SCHEMA)
    nd = NearDuplicates(df, 3, 0.6)
    assert nd.links.count() == 0
    assert {r.rep for r in nd.members().collect()} == {0}
    assert nd.pairs().count() == 300 * 299 // 2
    assert NearDuplicates(df.limit(0), 3, 0.6).pairs().count() == 0


def test_a_bin_collides_as_often_as_the_sets_agree():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 12, dtype=np.uint64)
    hit = []
    for _ in range(300):
        shared = rng.integers(0, 2**63, 12, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 2**63, 4, dtype=np.uint64)]) for _ in range(2))
        s = signatures(np.concatenate([a, b]), np.repeat([0, 1], 16), 2)
        hit.append((s[0] == s[1]).mean())
    assert abs(np.mean(hit) - 12 / 20) < 0.02


def test_a_hot_bucket_is_joined_before_the_exchange():
    from lodestar.llm.neardup import _thin

    rnd = np.random.default_rng(3)
    nodes = rnd.permutation(1000).astype(np.int64)[:200]
    flat = np.arange(400, dtype=np.uint64).reshape(200, 2)
    flat[:150, 0] = 7777
    keep, edges = _thin(flat, nodes, 64)
    assert keep[:, 1].all() and keep[150:, 0].all() and keep[:150, 0].sum() == 2
    lo, hi = nodes[:150].min(), nodes[:150].max()
    assert {tuple(e) for e in edges} == {(lo, n) for n in nodes[:150] if n > lo} | {(n, hi) for n in nodes[:150] if n < hi}
    keep, edges = _thin(flat[150:], nodes[150:], 64)
    assert keep.all() and edges.shape == (0, 2)


def test_texts_of_one_boilerplate(spark):
    """Three hundred texts share most of their words: hot buckets, a hub of many leaves, all pairs right."""
    rnd = np.random.default_rng(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rnd.choice(60, int(rnd.integers(1, 9)), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append(("d", i, " ".join(w)))
    got = {(r.kind, r.a, r.b) for r in NearDuplicates(spark.createDataFrame(rows, "kind string, key bigint, text string"), 3, 0.6).pairs().collect()}
    want = brute_force(rows, 3, 0.6)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_members_of_a_hot_bucket_meet_across_batches(spark):
    """One band, a bucket that is hot in each of two batches: every like pair of its members comes out, whichever batches they are in."""
    from lodestar.llm.neardup import bands
    from lodestar.llm.words import hash_words, shingle_hashes, words

    rnd = np.random.default_rng(6)
    rows = []
    for i in range(300):
        w = [f"b{k}" for k in range(60)]
        for k in rnd.choice(60, int(rnd.integers(1, 5)), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append(("d", i, " ".join(w)))
    sets = [shingle_hashes(hash_words(words(t)), 3) for _, _, t in rows]
    sig = signatures(np.concatenate(sets), np.repeat(np.arange(300), [len(s) for s in sets]), 300, 3)
    bucket = bands(sig, np.zeros(300, dtype=np.uint64))[:, 0]
    assert np.unique(bucket, return_counts=True)[1].max() > 128
    df = spark.createDataFrame(rows, "kind string, key bigint, text string").coalesce(2)
    got = {(r.kind, r.a, r.b) for r in NearDuplicates(df, 3, 0.6, bins=3, rows=3).pairs().collect()}
    want = brute_force(rows, 3, 0.6)
    assert got <= want and {p for p in want if bucket[p[1]] == bucket[p[2]]} <= got
