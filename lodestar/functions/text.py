"""Text functions as Column expressions: they stay inside the JVM and need no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import lexicon as L


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- normalising and tokens --------------------------------------------------------------------
def normalize(text) -> Column:
    """Letters and digits of any script in lower case; every other run is one blank."""
    return F.trim(F.lower(F.regexp_replace(_c(text), r"[^\p{IsAlphabetic}\p{N}]+", " ")))


def normalize_web(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " "))


def detect_language(text) -> Column:
    """hi or other by the first Devanagari or Cyrillic letter, es if an article of it occurs, else en."""
    t = _c(text)
    first = F.regexp_extract(t, "[\\u0900-\\u097F\\u0400-\\u04FF]", 0)
    low = F.lower(t)
    return (
        F.when(t.isNull(), None)
        .when((first >= "ऀ") & (first <= "ॿ"), "hi")
        .when(first != "", "other")
        .when(low.contains(" el ") | low.contains(" la "), "es")
        .otherwise("en")
    )


def split_words(clean) -> Column:
    return F.filter(F.split(_c(clean), " "), lambda w: w != "")


#: What is left has at least three bytes; with suffixes sharing an ending the longer is listed first.
STEM_EN = r"^([\x00-\x7F]{3,}?)(?:" + "|".join(L.SUFFIX_EN) + ")$"
STEM_ES = r"^([^\x00-\x7F].|.[^\x00-\x7F]|.{3,}?)(?:" + "|".join(dict.fromkeys(L.SUFFIX_ES)) + ")$"


def stem(word, lang) -> Column:
    w, g = _c(word), _c(lang)
    return F.when(g == "en", F.regexp_replace(w, STEM_EN, "$1")).when(g == "es", F.regexp_replace(w, STEM_ES, "$1")).otherwise(w)


def is_stop(word, lang) -> Column:
    w, g = _c(word), _c(lang)
    return ((g == "en") & w.isin(L.STOP_EN)) | ((g == "es") & w.isin(L.STOP_ES)) | ((g == "hi") & w.isin(L.STOP_HI))


def tokens_of(clean, lang) -> Column:
    """Stemmed words without stop words; the stop list is applied to the stems."""
    g = _c(lang)
    words = split_words(clean)
    # one branch per language, so that the language is tested once a text and not once a word
    en = F.filter(F.transform(words, lambda w: F.regexp_replace(w, STEM_EN, "$1")), lambda w: ~w.isin(L.STOP_EN))
    es = F.filter(F.transform(words, lambda w: F.regexp_replace(w, STEM_ES, "$1")), lambda w: ~w.isin(L.STOP_ES))
    hi = F.filter(words, lambda w: ~w.isin(L.STOP_HI))
    return F.when(g == "en", en).when(g == "es", es).when(g == "hi", hi).otherwise(words)


def tokenize(text) -> Column:
    clean = normalize(text)
    return tokens_of(clean, detect_language(clean))


def token_positions(clean, lang) -> Column:
    """array<struct<token, pos>>: positions count every word, stop words leave gaps."""
    g = _c(lang)
    words = split_words(clean)

    # one branch per language, so that the language is tested once a text and not once a word
    def branch(rx: str | None, stop: list[str]) -> Column:
        token = lambda w: F.regexp_replace(w, rx, "$1") if rx else w
        return F.filter(F.transform(words, lambda w, i: F.struct(token(w).alias("token"), i.alias("pos"))), lambda x: ~x["token"].isin(stop) if stop else F.lit(True))

    return F.when(g == "en", branch(STEM_EN, L.STOP_EN)).when(g == "es", branch(STEM_ES, L.STOP_ES)).when(g == "hi", branch(None, L.STOP_HI)).otherwise(branch(None, []))


def position_map(clean, lang) -> Column:
    pos = token_positions(clean, lang)
    return F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(pos, lambda x: x["token"])),
            lambda t: F.struct(t, F.transform(F.filter(pos, lambda x: x["token"] == t), lambda x: x["pos"])),
        )
    )


def tokenize_web(text) -> Column:
    return F.filter(F.split(normalize_web(text), " "), lambda w: (w != "") & ~w.isin(L.STOP_WEB))


def expand(tokens, lang) -> Column:
    """Every token followed by its synonyms, which are not stemmed."""
    t, g = _c(tokens), _c(lang)

    def with_synonyms(code: str) -> Column:
        def one(w):
            out = F.array(w)
            for k, v in L.SYNONYMS[code].items():
                out = F.when(w == k, F.array(w, *[F.lit(s) for s in v])).otherwise(out)
            return out

        return F.flatten(F.transform(t, one))

    return F.when(g == "en", with_synonyms("en")).when(g == "es", with_synonyms("es")).when(g == "hi", with_synonyms("hi")).otherwise(t)


# -- query understanding -----------------------------------------------------------------------
def intent(query, lang=None) -> Column:
    clean = normalize(query)
    g = _c(lang) if lang is not None else detect_language(query)
    words = split_words(clean)
    has = lambda code, kind: F.arrays_overlap(words, F.array(*[F.lit(w) for w in L.INTENTS[code][kind].split()]))
    short = (F.size(words) <= 3) & F.exists(words, lambda w: ~w.isin(L.NO_CONTENT))
    out = None
    for kind in ("comparison", "list", "factual"):
        hit = F.lit(False)
        for code in ("en", "es", "hi"):
            hit = hit | ((g == code) & has(code, kind))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(short, "factual").otherwise("other")


def classify_web(query) -> Column:
    low = F.lower(_c(query))
    any_of = lambda ws: F.greatest(*[low.contains(w) for w in ws])
    return F.when(any_of(L.WEB_COMPARISON), "comparison").when(any_of(L.WEB_LIST), "list").otherwise("factual")


# -- sentences, snippets -----------------------------------------------------------------------
def sentences(text) -> Column:
    """Pieces ending at every full stop, exclamation or question mark."""
    found = F.regexp_extract_all(_c(text), F.lit("[^.!?]*[.!?]|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(found, lambda s: _strip(s)), lambda s: s != "")


def sentences_web(text) -> Column:
    found = F.regexp_extract_all(_c(text), F.lit("[^.!?]+[.!?]+|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(found, lambda s: _strip(s)), lambda s: s != "")


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def words_ws(text) -> Column:
    """Words as white space cuts them."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def highlight(text, tokens) -> Column:
    t = _c(tokens)
    bare = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
    return F.array_join(F.transform(words_ws(text), lambda w: F.when(F.array_contains(t, bare(w)), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")


def snippet(text, tokens, length: int = 180) -> Column:
    """A window of ``length`` characters from 40 before the first token that occurs, highlighted."""
    s, t = _c(text), _c(tokens)
    low = F.lower(s)
    found = F.filter(F.transform(t, lambda w: F.instr(low, w)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(1)) - 40, F.lit(1))
    cut = F.when(F.length(s) <= length, s).otherwise(_strip(F.substring(s, start, F.lit(length))))
    return highlight(cut, t)


# -- hashes ------------------------------------------------------------------------------------
_M = 0xFFFFFFFF


def byte_values(text) -> Column:
    """UTF-8 bytes as numbers."""
    hx = F.hex(F.encode(_c(text), "UTF-8"))
    n = (F.length(hx) / 2).cast("int")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(hx, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")))


def fnv32(text) -> Column:
    return F.aggregate(byte_values(text), F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(_M)))


def fnv64(text) -> Column:
    """FNV-1a 64 as 16 hex digits, in two 32-bit halves so that nothing overflows."""

    def step(a, b):
        x = a["lo"].bitwiseXOR(b)
        low = x * 435
        return F.struct(
            (a["hi"] * 435 + F.shiftright(low, 32) + x * 256).bitwiseAND(F.lit(_M)).alias("hi"),
            low.bitwiseAND(F.lit(_M)).alias("lo"),
        )

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    return F.aggregate(byte_values(text), start, step, lambda a: F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0")))


def poly31(text, modulus: int = 1 << 32) -> Column:
    """31-polynomial hash of the characters' code points, wrapped at 2^32."""
    chars = F.filter(F.split(_c(text), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(modulus)))


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


# -- strings of web pages ----------------------------------------------------------------------
def slugify(text) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)


def clean_ws(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def strip_tags(html) -> Column:
    s = F.regexp_replace(_c(html), r"(?is)<script.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(s, r"<[^>]+>", " ")


#: Fixed: the six entities that are decoded, in this order.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def decode_entities(text) -> Column:
    s = _c(text)
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def normalize_url(url) -> Column:
    return F.regexp_replace(_c(url), "#.*$", "")


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))


def url_path(url) -> Column:
    p = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def clean_answer(text) -> Column:
    s = clean_ws(text)
    s = F.regexp_replace(s, r"\[[^\]]*\]", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\(\s*\)", ""), r"\s+", " "))
    first = F.regexp_extract(s, r"^(.*?[.!?])(?:\s|$)", 1)
    return F.substring(F.when(first != "", first).otherwise(s), 1, 220)


def is_namespace_title(title) -> Column:
    return F.lower(_c(title)).rlike("^(" + "|".join(L.NAMESPACES) + "):")


def is_redirect(text) -> Column:
    return F.lower(F.ltrim(_c(text))).rlike("^#?redirect")


# -- scores ------------------------------------------------------------------------------------
def confidence(score) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(score)))


def confidence_level(score) -> Column:
    c = confidence(score)
    return F.when(c > 0.75, "high").when(c > 0.5, "medium").otherwise("low")


def overlap_share(query_tokens, text_tokens) -> Column:
    q, t = _c(query_tokens), _c(text_tokens)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.filter(q, lambda w: F.array_contains(t, w))) / F.size(q))


def confidence_web(retrieval, query_tokens, answer_tokens) -> Column:
    return _c(retrieval) + overlap_share(query_tokens, answer_tokens)


def parsed_date(value) -> Column:
    """A date string, ISO or epoch seconds or milliseconds; null if it is none."""
    v = F.trim(_c(value))
    num = F.try_to_number(v, F.lit("9999999999999")).cast("double")
    iso = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")])
    return F.coalesce(iso, F.when(v.rlike("^[0-9]{13}$"), F.timestamp_seconds(num / 1000)).when(v.rlike("^[0-9]{10}$"), F.timestamp_seconds(num)))


def freshness(meta, now) -> Column:
    """1 / (1 + age in days / 30) of the first readable date key; the future counts as today."""
    when = F.coalesce(*[parsed_date(F.try_element_at(_c(meta), F.lit(k))) for k in L.DATE_KEYS])
    days = (_c(now).cast("double") - when.cast("double")) / 86400
    return F.when(when.isNull(), 0.0).otherwise(1 / (1 + F.greatest(days, F.lit(0.0)) / 30))


def feedback_boost(global_clicks, query_clicks) -> Column:
    n = F.coalesce(_c(global_clicks), F.lit(0)) + 2 * F.coalesce(_c(query_clicks), F.lit(0))
    return F.when(n <= 0, 0.0).otherwise(F.log1p(n.cast("double")) / 5)
