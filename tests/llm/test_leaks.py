import random

import numpy as np

from lodestar.llm.leaks import ItemIndex, brute_force, find_leaks, shingle_similarity, simhashes
from lodestar.llm.words import hash_words, words

D = "doc_id bigint, text string, item_id int, similarity int"
I = "item_id bigint, expected_answer string, doc_id int"


def data():
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([1, 5, 11, 12, 13, 40]))) for i in range(30)] + [(90, None), (91, " ... "), (92, "")]
    docs = [(k, say(60)) for k in range(40)]
    for k in range(40, 80):
        ws = rnd.choice(items[:30])[1].split()
        at = rnd.randint(0, max(0, len(ws) - 12))
        n = rnd.choice([11, 12, 12, 20])
        docs.append((k, say(10) + "\n" + ", ".join(ws[at : at + n]).upper() + "! " + say(5)))
    docs += [(81, None), (82, ""), (83, say(40_000) + " " + items[5][1] + " end")]
    return docs, items


def test_finds_exactly_the_documents_with_consecutive_words(spark):
    docs, items = data()
    df = spark.createDataFrame([(*x, 0, 0) for x in docs], D)
    it = spark.createDataFrame([(*x, 0) for x in items + items[:3]], I)
    want = brute_force(docs, [x for x in items if x[1]])
    for kw in ({}, {"block_items": 7}):
        got = find_leaks(df, "doc_id", "text", it, "item_id", "expected_answer", **kw).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert find_leaks(df.limit(0), "doc_id", "text", it, "item_id", "expected_answer").count() == 0
    assert find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "expected_answer").count() == 0


def test_near_windows(spark):
    base = [f"word{i}" for i in range(40)]
    near = base[:20] + ["changed"] + base[21:]
    df = spark.createDataFrame([(1, " ".join(near), 0, 0), (2, " ".join(reversed(base)), 0, 0)], D)
    it = spark.createDataFrame([(5, " ".join(base), 0)], I)
    got = find_leaks(df, "doc_id", "text", it, "item_id", "expected_answer", window=40, radius=7, min_similarity=0.7).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] and 0.7 < got[0].similarity < 1


def test_blocks_find_every_pair_within_the_radius():
    rnd = np.random.default_rng(3)
    items = [(i, " ".join(f"v{x}" for x in rnd.integers(0, 99, 12))) for i in range(50)]
    ix = ItemIndex(items, 12, 3)
    own = ix.lengths[12][2]
    probe = own[rnd.integers(0, len(own), 500)]
    for _ in range(3):
        probe = probe ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64))
    want = {(i, j) for i in range(500) for j in range(len(own)) if bin(int(probe[i] ^ own[j])).count("1") <= 3}
    assert ix.candidates(12, probe) == want


def test_simhash_is_a_majority_of_bits():
    h = hash_words(words("one two three four five six"))
    for k, got in enumerate(simhashes(h, 5)):
        bits = sum((1 << b) for b in range(64) if sum((int(x) >> b) & 1 for x in h[k : k + 5]) > 2)
        order = np.unpackbits(np.array([bits], dtype=np.uint64).view(np.uint8))
        assert (np.unpackbits(np.array([got], dtype=np.uint64).view(np.uint8)) == order).all()
    assert shingle_similarity(["a"], ["a"]) == 1.0 and shingle_similarity(["a"], ["b"]) == 0.0
