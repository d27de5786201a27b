import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "text,clean", [("  Hello, WORLD! ", "hello world"), ("naïve-Straße №5", "naïve straße 5"), ("क्या है", "क या है"), ("...", ""), ("", "")]
)
def test_normalize(spark, text, clean):
    assert one(spark, T.normalize(F.lit(text))) == clean


@pytest.mark.parametrize("text,lang", [("the end", "en"), ("ver la casa", "es"), ("sous LA mer", "es"), ("वह घर", "hi"), ("дом वह", "other"), ("", "en"), (None, None)])
def test_language(spark, text, lang):
    assert one(spark, T.detect_language(F.lit(text).cast("string"))) == lang


@pytest.mark.parametrize(
    "word,lang,want",
    [("running", "en", "runn"), ("this", "en", "thi"), ("ring", "en", "ring"), ("markedly", "en", "mark"), ("uses", "en", "use"), ("quickly", "en", "quick"), ("naïves", "en", "naïves"),
     ("rápidamente", "es", "rápida"), ("ciudades", "es", "ciudad"), ("canciones", "es", "cancion"), ("años", "es", "añ"), ("घरes", "hi", "घरes")],
)
def test_stem(spark, word, lang, want):
    assert one(spark, T.stem(F.lit(word), F.lit(lang))) == want


def test_tokens_and_positions(spark):
    assert one(spark, T.tokenize(F.lit("The dogs of this town were running"))) == ["dog", "thi", "town", "runn"]
    assert one(spark, T.position_map(F.lit("the dogs of town and dogs"), F.lit("en"))) == {"dog": [1, 5], "town": [3]}


@pytest.mark.parametrize(
    "q,want", [("what is bm25", "factual"), ("cats vs dogs", "comparison"), ("list the best towns", "list"), ("old mill", "factual"), ("of the", "other"), ("the old mill stood by water", "other"), ("lista de casas y la otra", "list")]
)
def test_intent(spark, q, want):
    assert one(spark, T.intent(F.lit(q))) == want


def test_expand_and_web(spark):
    assert one(spark, T.expand(F.array(F.lit("search"), F.lit("x")), F.lit("en"))) == ["search", "retrieve", "retrieval", "x"]
    assert one(spark, T.classify_web(F.lit("stop it"))) == "list"
    assert one(spark, T.tokenize_web(F.lit("You can See Ñandu"))) == ["can", "see", "andu"]


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit(" One. Two!? three"))) == ["One.", "Two!", "?", "three"]
    assert one(spark, T.sentences_web(F.lit("One... Two!? three"))) == ["One...", "Two!?", "three"]


def test_snippet_and_highlight(spark):
    text = "x" * 100 + " the Museum, of " + "y " * 100
    got = one(spark, T.snippet(F.lit(text), F.array(F.lit("museum"))))
    assert "[Museum,]" in got and len(got) < 190
    assert one(spark, T.highlight(F.lit("A  b"), F.array(F.lit("b")))) == "A [b]"


def test_hashes(spark):
    assert one(spark, T.fnv32(F.lit("foobar"))) == 0xBF9CF968
    assert one(spark, T.fnv64(F.lit("foobar"))) == "85944171F73967E8"
    assert one(spark, T.fnv32(F.lit(""))) == 2166136261
    assert one(spark, T.hamming(F.lit(0b1011), F.lit(0b0010))) == 2


def test_web_strings(spark):
    assert one(spark, T.slugify(F.lit("--The Old Mill! "))) == "the-old-mill"
    assert one(spark, T.strip_tags(F.lit("a<script>x<y</script><b>c</b>"))).split() == ["a", "c"]
    assert one(spark, T.decode_entities(F.lit("&amp;lt; &quot;x&quot;"))) == '< "x"'
    assert one(spark, T.normalize_url(F.lit("http://a/b#c"))) == "http://a/b"
    assert one(spark, T.clean_answer(F.lit("It is [1] old ( ).  And new."))) == "It is old ."
    assert one(spark, T.is_namespace_title(F.lit("Category:X")))
    assert one(spark, T.is_redirect(F.lit(" #REDIRECT [[x]]")))


def test_scores(spark):
    now = F.lit(dt.datetime(2025, 1, 31, tzinfo=dt.timezone.utc))
    fresh = lambda m: one(spark, T.freshness(F.lit(m) if m is None else F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), now))
    assert fresh({"date": "2025-01-01"}) == 0.5
    assert fresh({"date": "nonsense", "createdAt": "2025-01-31T00:00:00Z"}) == 1.0
    assert fresh({"date": "2030-01-01"}) == 1.0 and fresh({"other": "2025-01-01"}) == 0.0
    assert one(spark, T.confidence_level(F.lit(0.76))) == "high" and one(spark, T.confidence(F.lit(7.0))) == 1.0
    assert round(one(spark, T.feedback_boost(F.lit(1), F.lit(2))), 6) == 0.358352
    assert one(spark, T.feedback_boost(F.lit(None).cast("bigint"), F.lit(0))) == 0.0
