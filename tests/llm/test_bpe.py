import os
import random

import pytest

from lodestar.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.default_vocab(), "rb") as f:
        return bpe.parse_ranks(f.read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.default_vocab()), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


CASES = ["", " ", "a", "Hello, world's  best\n\n\tthing 123", "<|endoftext|> it", "naïve Straße дом पानी 漢字 😀", "\r\n\r\n  x", "\x1c\x1d a\x85b　 c​ d", "don't I'LL we've", "a" * 3000, "ab " * 50 + "zq" * 700, "  x  y"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_the_public_tokenizer(ranks, reference, text):
    assert bpe.Encoder(ranks).encode(text) == reference(text)


def test_random_texts(ranks, reference):
    rnd = random.Random(7)
    alphabet = "abcdeorst  \n\t'’.,-0123éß漢д \x1f" + "THE"
    enc = bpe.Encoder(ranks, capacity=50)
    for _ in range(300):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        assert enc.encode(s) == reference(s)


def test_long_pieces_merge_like_short_ones(ranks, monkeypatch):
    rnd = random.Random(3)
    for _ in range(50):
        piece = bytes(rnd.choice(b"etaonis hx\xc3\xa9") for _ in range(rnd.randint(2, 200)))
        short = bpe.merge_parts(piece, ranks)
        assert bpe._merge_long(piece, ranks) == short or piece in ranks


def test_rows_nulls_and_clashing_columns(spark, reference):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (1, "a b", 9), (None, "x", 9)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert got == [(0, reference("x")), (1, reference("a b")), (1, reference("a b")), (2, []), (3, [])]
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
