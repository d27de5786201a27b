"""The engine's own queries by name, over whole tables, and the SQL that checks them."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.config import Chunking, Config
from lodestar.functions import lexicon as L
from lodestar.functions import text as T
from lodestar.operators import answers, bm25, chunking, dedup, evaluation, feedback, ranking, shards, spelling, vectors
from lodestar.plans import ranksql as R
from lodestar.plans import sqltext as S
from lodestar.plans.query_plan import analyse
from lodestar.runtime import load, materialize, scratch_path

QUERIES = [(1, "what is the granary museum"), (2, "list the windmill types of the harbour"), (3, "compare the lighthouse and the observatory"), (4, "old bridge")]
NOW = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
_REG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def wrap(f):
        key = name or f.__name__
        _REG[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REG)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(s, d):
    return load(s, d, "documents", spread=True)


def _items(s, d):
    return load(s, d, "eval_items").select("item_id", "query", "expected_answer", "relevant_docs").dropDuplicates(["item_id"])


def _chunks(s, d, cfg=Chunking(), merge=True):
    return chunking.chunk(_docs(s, d), cfg, merge=merge)


def _built(s, d):
    return chunking.build(_chunks(s, d))


def _qs(s):
    return s.createDataFrame(QUERIES, "query_id int, text string")


def _plan(s):
    return analyse(_qs(s))


def _searched(s, d, columns=("chunk_id", "text", "clean", "lang", "tokens")):
    """Passages written once, the postings of the queries' terms, and the analysed queries."""
    c = materialize(_built(s, d).select(*columns), "passages")
    plan = materialize(_plan(s), "plan")
    terms = sorted({r.t for r in plan.select(F.explode(F.concat("tokens", "expanded")).alias("t")).distinct().collect()})  # of a fixed set of queries
    return c, bm25.postings(c, terms=terms), plan


_ITEMS = "(select distinct on (item_id) item_id, query, expected_answer, relevant_docs from eval_items) i"


# -- scalar functions --------------------------------------------------------------------------
@query(f"select doc_id, md5({S.norm('text')}) clean from documents")
def fn_normalize(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.normalize("text").cast("binary")).alias("clean"))


@query(f"select doc_id, md5({S.norm_web('text')}) clean from documents")
def fn_normalize_js(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.normalize_web("text").cast("binary")).alias("clean"))


@query(f"select doc_id, {S.lang('text')} lang from documents")
def fn_detect_lang(s, d):
    return _docs(s, d).select("doc_id", T.detect_language("text").alias("lang"))


_TOK_CTE = f"with n as (select doc_id, {S.norm('text')} clean from documents), g as (select *, {S.lang('clean')} lang from n)"


@query(f"{_TOK_CTE} select doc_id, array_to_string({S.tokens('clean', 'lang')}, ' ') tokens from g")
def fn_tokenize(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.tokenize("text"), " ").alias("tokens"))


@query(f"{_TOK_CTE}, t as (select doc_id, lang, unnest({S.words('clean')}) w, generate_subscripts({S.words('clean')}, 1) - 1 pos from g), u as (select doc_id, {S.stem('w', 'lang')} token, lang, pos from t) select doc_id, token, cast(pos as int) pos from u where not ((lang = 'en' and token in {S._in(L.STOP_EN)}) or (lang = 'es' and token in {S._in(L.STOP_ES)}) or (lang = 'hi' and token in {S._in(L.STOP_HI)}))")
def fn_positions(s, d):
    c = _docs(s, d).select("doc_id", T.normalize("text").alias("clean"))
    x = c.select("doc_id", F.explode(T.token_positions("clean", T.detect_language("clean"))).alias("x"))
    return x.select("doc_id", "x.token", "x.pos")


@query(f"{_TOK_CTE}, t as (select lang, unnest({S.words('clean')}) word from g) select distinct lang, word, {S.stem('word', 'lang')} stem from t where lang in ('en', 'es')")
def fn_stem(s, d):
    c = _docs(s, d).select(T.normalize("text").alias("clean")).withColumn("lang", T.detect_language("clean")).filter("lang in ('en', 'es')")
    w = c.select("lang", F.explode(T.split_words("clean")).alias("word")).distinct()
    return w.select("lang", "word", T.stem("word", "lang").alias("stem"))


@query(f"select doc_id, array_to_string({S.tokens_web('text')}, ' ') tokens from documents")
def fn_tokenize_js(s, d):
    return _docs(s, d).select("doc_id", F.array_join(T.tokenize_web("text"), " ").alias("tokens"))


_IQ = f"with q as (select item_id, query, {S.norm('query')} clean, {S.lang('query')} lang from {_ITEMS})"


@query(f"{_IQ}, t as (select *, {S.tokens('clean', 'lang')} tk from q) select item_id, array_to_string({S.expanded('tk', 'lang')}, ' ') expanded from t")
def fn_expand(s, d):
    q = _items(s, d).withColumn("lang", T.detect_language("query"))
    return q.select("item_id", F.array_join(T.expand(T.tokens_of(T.normalize("query"), "lang"), "lang"), " ").alias("expanded"))


@query(f"{_IQ} select item_id, {S.intent('query', 'lang')} intent from q")
def fn_intent(s, d):
    return _items(s, d).select("item_id", T.intent("query").alias("intent"))


@query(f"{_IQ} select item_id, {S.intent_web('query')} kind from q")
def fn_classify_js(s, d):
    return _items(s, d).select("item_id", T.classify_web("query").alias("kind"))


@query(f"select doc_id, cast(generate_subscripts(x, 1) - 1 as int) pos, unnest(x) sentence from (select doc_id, {S.sentences('text')} x from documents)")
def fn_sentences(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@query(f"select doc_id, cast(generate_subscripts(x, 1) - 1 as int) pos, unnest(x) sentence from (select doc_id, {S.sentences_web('text')} x from documents)")
def fn_sentences_js(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(T.sentences_web("text")).alias("pos", "sentence"))


_HL = f"array_to_string(list_transform({S.words_ws('cut')}, lambda w: case when regexp_replace(lower(w), '[^a-z0-9]', '', 'g') in ('museum', 'granary', 'bridge') then '[' || w || ']' else w end), ' ')"


@query(
    "with l as (select doc_id, text, list_filter([instr(lower(text), 'museum'), instr(lower(text), 'granary'), instr(lower(text), 'bridge')], lambda p: p > 0) f from documents where text is not null),"
    f" c as (select doc_id, case when length(text) <= 180 then text else {S.strip('substr(text, greatest(coalesce(f[1], 1) - 40, 1), 180)')} end cut from l) select doc_id, {_HL} snippet from c"
)
def fn_snippet(s, d):
    tokens = F.array(F.lit("museum"), F.lit("granary"), F.lit("bridge"))
    return _docs(s, d).filter("text is not null").select("doc_id", T.snippet("text", tokens).alias("snippet"))


@query(f"select doc_id, {_HL} marked from (select doc_id, text cut from documents where text is not null)")
def fn_highlight(s, d):
    return _docs(s, d).filter("text is not null").select("doc_id", T.highlight("text", F.array(F.lit("museum"), F.lit("granary"), F.lit("bridge"))).alias("marked"))


_ORDS = "list_transform(range(1, length(source) + 1), lambda i: cast(ord(substr(source, i, 1)) as {t}))"


@query(f"select distinct source, list_reduce(list_prepend(cast(2166136261 as bigint), {_ORDS.format(t='bigint')}), lambda h, b: (xor(h, b) * 16777619) & 4294967295) h from documents")
def fn_fnv32(s, d):
    return _docs(s, d).select("source").distinct().select("source", T.fnv32("source").alias("h"))


@query(
    f"with x as (select distinct source, list_reduce(list_prepend(cast(14695981039346656037 as hugeint), {_ORDS.format(t='hugeint')}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) h from documents)"
    " select source, lpad(upper(to_base(cast(h // 4294967296 as bigint), 16)), 8, '0') || lpad(upper(to_base(cast(h % 4294967296 as bigint), 16)), 8, '0') h from x"
)
def fn_fnv64(s, d):
    return _docs(s, d).select("source").distinct().select("source", T.fnv64("source").alias("h"))


@query(f"select distinct source, list_reduce(list_prepend(cast(0 as bigint), {_ORDS.format(t='bigint')}), lambda h, b: (h * 31 + b) % 4294967296) h from documents")
def fn_strhash(s, d):
    return _docs(s, d).select("source").distinct().select("source", T.poly31("source").alias("h"))


_HEX = "(select distinct title, hex(encode(title)) hx from raw_pages where title is not null)"
_HASHED = "list_reduce(list_prepend(cast({seed} as hugeint), list_transform(range(0, cast(length(hx) / 2 as bigint)), lambda i: cast({byte} as hugeint))), lambda h, b: (xor(h, b) * {prime}) % {wrap})"


@query(
    f"select title, cast({_HASHED.format(seed='2166136261', byte=R._byte('hx', 'i'), prime='16777619', wrap='4294967296')} as bigint) h32, lpad(upper(to_base(cast(x // 4294967296 as bigint), 16)), 8, '0') || lpad(upper(to_base(cast(x % 4294967296 as bigint), 16)), 8, '0') h64"
    f" from (select *, {_HASHED.format(seed='14695981039346656037', byte=R._byte('hx', 'i'), prime='1099511628211', wrap='18446744073709551616')} x from {_HEX})"
)
def fn_fnv_bytes(s, d):
    """Both hashes over the bytes of titles in several alphabets."""
    return load(s, d, "raw_pages").select("title").filter("title is not null").distinct().select("title", T.fnv32("title").alias("h32"), T.fnv64("title").alias("h64"))


@query("select crawl_id, md5(url) id, md5(url) = id as same from raw_pages")
def fn_md5id(s, d):
    return load(s, d, "raw_pages").select("crawl_id", F.md5("url").alias("id"), (F.md5("url") == F.col("id")).alias("same"))


@query("select crawl_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) slug from raw_pages")
def fn_slugify(s, d):
    return load(s, d, "raw_pages").select("crawl_id", T.slugify("title").alias("slug"))


@query(f"select crawl_id, trim(regexp_replace(text, '{S.WS}+', ' ', 'g'), ' ') clean from raw_pages")
def fn_clean_ws(s, d):
    return load(s, d, "raw_pages").select("crawl_id", T.clean_ws("text").alias("clean"))


_STRIP = r"regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"select doc_id, md5({_STRIP}) plain from documents")
def fn_strip_tags(s, d):
    return _docs(s, d).select("doc_id", F.md5(T.strip_tags("text").cast("binary")).alias("plain"))


def _entities_sql(c: str) -> str:
    for a, b in T.ENTITIES:
        c = "replace({}, '{}', '{}')".format(c, a, b.replace("'", "''"))
    return c


@query(f"select doc_id, {_entities_sql('text')} plain from documents where contains(text, '&')")
def fn_entities(s, d):
    return _docs(s, d).filter(F.col("text").contains("&")).select("doc_id", T.decode_entities("text").alias("plain"))


@query("select crawl_id, regexp_replace(url, '#.*$', '') url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) host from raw_pages")
def fn_norm_url(s, d):
    return load(s, d, "raw_pages").select("crawl_id", T.normalize_url("url").alias("url"), T.url_host("url").alias("host"))


@query(
    rf"with a as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '{S.WS}+', ' ', 'g'), ' '), '\[[^\]]*\]', '', 'g'), '\( *\)', '', 'g'), '{S.WS}+', ' ', 'g'), ' ') t from documents where text is not null)"
    r" select doc_id, substr(case when regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1) <> '' then regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1) else t end, 1, 220) answer from a"
)
def fn_clean_answer(s, d):
    return _docs(s, d).filter("text is not null").select("doc_id", T.clean_answer("text").alias("answer"))


@query("select case when c > 0.75 then 'high' when c > 0.5 then 'medium' else 'low' end as level, count(*) n, round(sum(c), 3) total from (select greatest(0.0, least(1.0, semantic)) c from score_breakdown where semantic is not null and not isnan(semantic)) group by all")
def fn_confidence(s, d):
    x = load(s, d, "score_breakdown").filter("semantic is not null and not isnan(semantic)")
    return x.groupBy(T.confidence_level("semantic").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(T.confidence("semantic")), 3).alias("total"))


@query("select query_id, chunk_id, epoch_us(scored_at) as at, round(greatest(0.0, least(1.0, semantic)), 9) c, case when semantic > 0.75 then 'high' when semantic > 0.5 then 'medium' else 'low' end as level from score_breakdown where semantic is not null and not isnan(semantic)")
def fn_confidence_rows(s, d):
    x = load(s, d, "score_breakdown").filter("semantic is not null and not isnan(semantic)")
    return x.select("query_id", "chunk_id", F.unix_micros("scored_at").alias("at"), F.round(T.confidence("semantic"), 9).alias("c"), T.confidence_level("semantic").alias("level"))


@query(f"select item_id, round(0.5 + case when len(q) = 0 then 0 else len(list_filter(q, lambda x: list_contains(a, x))) / len(q) end, 9) confidence from (select item_id, {S.tokens_web('query')} q, {S.tokens_web('expected_answer')} a from {_ITEMS})")
def fn_confidence_js(s, d):
    x = _items(s, d).select("item_id", T.tokenize_web("query").alias("q"), T.tokenize_web("expected_answer").alias("a"))
    return x.select("item_id", F.round(T.confidence_web(F.lit(0.5), "q", "a"), 9).alias("confidence"))


@query(R.freshness(repr(NOW.timestamp())))
def fn_freshness(s, d):
    return _docs(s, d).select("doc_id", F.round(T.freshness("meta", F.lit(NOW)), 9).alias("freshness"))


# -- chunking ----------------------------------------------------------------------------------
@query(f"with {S.chunks()} select chunk_id, chunk_no, text, total_chunks from ck", "chunk_words")
def chunk_words(s, d):
    return _chunks(s, d).select("chunk_id", "chunk_no", "text", "total_chunks")


@query(f"with {S.chunks(100, 300, 200, False)} select chunk_id, chunk_no, text from ck")
def chunk_page(s, d):
    return _chunks(s, d, Config().page_chunking, merge=False).select("chunk_id", "chunk_no", "text")


@query(f"with {S.chunks(200, 500, 300)} select doc_id, chunk_no - 1 as chunk_index, total_chunks, len({S.words_ws('text')}) n_words from ck")
def chunk_js(s, d):
    return _chunks(s, d, Chunking(200, 500, 300)).select("doc_id", (F.col("chunk_no") - 1).alias("chunk_index"), "total_chunks", F.size(T.words_ws("text")).cast("bigint").alias("n_words"))


@query(f"with {S.built()} select chunk_id, md5(clean) clean, lang, array_to_string(tokens, ' ') tokens from cb")
def chunk_build(s, d):
    return _built(s, d).select("chunk_id", F.md5(F.col("clean").cast("binary")).alias("clean"), "lang", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {S.chunks()} select chunk_id id, text from ck where chunk_no % 3 <> 0 and trim(text, ' ') <> ''")
def prj_live(s, d):
    c = _chunks(s, d)
    return chunking.live(c, c.filter("chunk_no % 3 = 0"))


@query("select c.chunk_id, c.doc_id, length(d.text) doc_chars from (select distinct chunk_id, doc_id from chunks) c join documents d on c.doc_id = cast(d.doc_id as varchar)")
def prj_lookup(s, d):
    c = load(s, d, "chunks").select("chunk_id", "doc_id").distinct()
    return c.join(_docs(s, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.length("text").cast("bigint").alias("doc_chars")), "doc_id").select("chunk_id", "doc_id", "doc_chars")


# -- filters -----------------------------------------------------------------------------------
@query(f"with x as (select doc_id, unnest({S.sentences('text')}) s from documents) select doc_id, count(*) n, count(*) filter (len({S.words_ws('s')}) >= 5) kept from x group by doc_id")
def flt_trivial(s, d):
    x = _docs(s, d).select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size(T.words_ws("s")) >= 5, 1)).alias("kept"))


@query(f"select doc_id from documents where regexp_matches(lower(text), '^({'|'.join(L.NAMESPACES)}):') or regexp_matches(lower(ltrim(text)), '^#?redirect') or {S.norm('text')} like 'list of %' or contains({S.norm('text')}, ' redirect ')")
def flt_namespace(s, d):
    c = T.normalize("text")
    return _docs(s, d).filter(T.is_namespace_title("text") | T.is_redirect("text") | c.startswith("list of ") | c.contains(" redirect ")).select("doc_id")


_TITLED = "case crawl_id % 5 when 0 then 'Category:' || title when 1 then '#REDIRECT ' || title when 2 then 'List of ' || title else title end"


@query(f"select crawl_id from (select crawl_id, {_TITLED} t from raw_pages) where regexp_matches(lower(t), '^({'|'.join(L.NAMESPACES)}):') or regexp_matches(lower(ltrim(t)), '^#?redirect')")
def flt_namespace_titles(s, d):
    """The filters of dumps over titles of which some are made pages of other namespaces and redirects."""
    t = load(s, d, "raw_pages").select("crawl_id", F.expr(_TITLED).alias("t"))
    return t.filter(T.is_namespace_title("t") | T.is_redirect("t")).select("crawl_id")


@query("select doc_id, ext_id from documents where trim(coalesce(ext_id, '')) <> '' and not regexp_matches(ext_id, '^[0-9]+$') and contains(ext_id, ':')")
def flt_pack_source(s, d):
    return _docs(s, d).filter("trim(coalesce(ext_id, '')) <> '' and not ext_id rlike '^[0-9]+$' and contains(ext_id, ':')").select("doc_id", "ext_id")


@query("select min(doc_id) doc_id, ext_id from documents where ext_id is not null and text is not null group by ext_id")
def flt_update_valid(s, d):
    x = _docs(s, d).filter("ext_id is not null and text is not null")
    w = Window.partitionBy("ext_id").orderBy("doc_id")
    return x.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("doc_id", "ext_id")


@query(f"with {S.chunks()} select chunk_id from ck where chunk_id not in (select chunk_id from chunks where chunk_id is not null)")
def flt_js_existing(s, d):
    return _chunks(s, d).select("chunk_id").join(load(s, d, "chunks").select("chunk_id"), "chunk_id", "left_anti")


@query(f"select min(doc_id) doc_id from documents group by {S.norm('coalesce(text, ' + repr('') + ')')}")
def flt_exact_dup(s, d):
    return dedup.exact_dedup(_docs(s, d), "text", "doc_id").select("doc_id")


@query(R.greedy())
def flt_near_dup(s, d):
    return dedup.near_dedup(dedup.simhash(_docs(s, d), "doc_id", "text"), "doc_id").select("doc_id")


@query(f"with {R.fingerprints()} select doc_id, sig from sg")
def ag_simhash(s, d):
    return dedup.simhash(_docs(s, d), "doc_id", "text")


@query(f"with {R.fingerprints()}, f as (select sig, min(doc_id) doc_id from sg group by sig) select x.doc_id a, y.doc_id b, cast(bit_count(xor(x.sig, y.sig)) as int) distance from f x join f y on x.doc_id < y.doc_id where bit_count(xor(x.sig, y.sig)) <= 3")
def jn_neardup(s, d):
    return dedup.near_pairs(dedup.simhash(_docs(s, d), "doc_id", "text"), "doc_id")


# -- aggregates --------------------------------------------------------------------------------
_POST = f"with {S.built()}, t as (select chunk_id, len(tokens) dl, unnest(tokens) term from cb)"


@query(f"{_POST} select chunk_id, term, cast(count(*) as int) tf, cast(dl as int) as len from t group by chunk_id, term, dl")
def ag_tf(s, d):
    return bm25.postings(_built(s, d)).select("chunk_id", "term", "tf", "len")


@query(f"{_POST} select term, count(distinct chunk_id) df from t group by term")
def ag_df(s, d):
    return bm25.term_stats(bm25.postings(_built(s, d)))


@query(f"with {S.built()} select count(*) n, cast(sum(len(tokens)) as bigint) total_len, round(sum(len(tokens)) / count(*), 9) avg_len from cb")
def ag_corpus(s, d):
    return bm25.corpus_stats(_built(s, d)).withColumn("avg_len", F.round("avg_len", 9))


@query(f"with {S.built()} select chunk_id, cast(len(tokens) as bigint) as len from cb")
def ag_doclen(s, d):
    return _built(s, d).select("chunk_id", F.size("tokens").cast("bigint").alias("len"))


@query(f"{_POST} select distinct term, substr(term, 1, 1) as first, cast(strlen(term) as int) bytes from t where term <> ''")
def ag_vocab(s, d):
    return spelling.vocabulary(bm25.postings(_built(s, d)))


_CLICKS = "with e as (select trim(regexp_replace(lower(event_type), '[^a-z0-9]+', ' ', 'g')) as query, user_id as doc_id from events where user_id is not null)"


@query(f"{_CLICKS} select query, doc_id, count(*) clicks from e group by all")
def ag_clicks(s, d):
    return feedback.click_counts(load(s, d, "events"), "event_type", "user_id")[1]


@query(f"{_CLICKS}, g as (select doc_id, count(*) g from e group by 1), q as (select query, doc_id, count(*) c from e group by all) select query, doc_id, round(ln(1 + g + 2 * c) / 5, 9) feedback from q join g using (doc_id)")
def jn_feedback(s, d):
    g, q = feedback.click_counts(load(s, d, "events"), "event_type", "user_id")
    return feedback.boosts(q.select("query", "doc_id"), g, q).select("query", "doc_id", F.round("feedback", 9).alias("feedback"))


@query("select source, count(*) docs, coalesce(sum(strlen(text)), 0)::bigint bytes, count(*) filter (text is null or trim(text, ' ') = '') empty from documents group by source")
def ag_health(s, d):
    x = _docs(s, d).groupBy("source")
    return x.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("bytes"), F.count(F.when(F.col("text").isNull() | (F.trim("text") == ""), 1)).alias("empty"))


# -- BM25 --------------------------------------------------------------------------------------
_TOPK = "r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, {k}) as rank from sc where score > 0)"


@query(f"with {S.built()}, {S.queries(QUERIES)}, {S.bm25()}, {_TOPK.format(k='chunk_id')} select query_id, chunk_id, round(score, 6) score, cast(rank as int) as rank from r where rank <= 10")
def bm25_topk(s, d):
    c, post, plan = _searched(s, d, ("chunk_id", "tokens"))
    hits = bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan))
    return bm25.top_k(hits, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_ALLQ = f"qn as (select item_id as query_id, query as text, {S.norm('query')} clean, {S.lang('query')} lang from {_ITEMS} where trim(coalesce(query, '')) <> ''), qa as (select *, {S.tokens('clean', 'lang')} tokens from qn)"


@query(f"with {S.built()}, {_ALLQ}, {S.bm25()}, {_TOPK.format(k='chunk_id')} select query_id, chunk_id, round(score, 6) score, cast(rank as int) as rank from r where rank <= 10")
def bm25_all_items(s, d):
    c = materialize(_built(s, d).select("chunk_id", "tokens"), "bm25")
    post = bm25.postings(c)
    plan = analyse(_items(s, d).select(F.col("item_id").alias("query_id"), F.col("query").alias("text")))
    hits = bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan))
    return bm25.top_k(hits, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_WEBQ = f"qv(query_id, text) as (values {', '.join(f'({i}, {chr(39)}{q}{chr(39)})' for i, q in QUERIES)}), qa as (select *, {S.tokens_web('text')} tokens from qv), cb as (select doc_id, {S.tokens_web('text')} tokens from documents where text is not null)"


@query(f"with {_WEBQ}, {S.bm25('cb', 'doc_id')}, {_TOPK.format(k='doc_id')} select query_id, doc_id, round(score, 6) score from r where rank <= 10")
def bm25_demo(s, d):
    c = _docs(s, d).filter("text is not null").select(F.col("doc_id").alias("chunk_id"), T.tokenize_web("text").alias("tokens"))
    post = bm25.postings(c)
    q = _qs(s).select("query_id", F.explode(T.tokenize_web("text")).alias("term"))
    return bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), q), 10).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"with {_WEBQ}, tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(tokens) term from cb) group by all), nn as (select doc_id, sqrt(sum(tf * tf)) dn from tf group by 1), q as (select query_id, term, count(*) qf from (select query_id, unnest(tokens) term from qa) group by all), qq as (select query_id, sqrt(sum(qf * qf)) qn from q group by 1) select query_id, doc_id, round(sum(tf * qf) / (any_value(dn) * any_value(qn)), 6) score from tf join q using (term) join nn using (doc_id) join qq using (query_id) group by query_id, doc_id")
def vec_cos_sparse(s, d):
    c = _docs(s, d).filter("text is not null").select(F.col("doc_id").alias("chunk_id"), T.tokenize_web("text").alias("tokens"))
    q = _qs(s).select("query_id", F.explode(T.tokenize_web("text")).alias("term"))
    return vectors.sparse_cosine(c, q).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    f"{_POST}, v as (select distinct term, substr(term, 1, 1) f, strlen(term) b from t where term <> ''), q as (select item_id, {S.norm('query')} clean, {S.lang('query')} lang from {_ITEMS} where trim(coalesce(query, '')) <> ''),"
    f" qt as (select item_id as query_id, unnest({S.tokens('clean', 'lang')}) term, generate_subscripts({S.tokens('clean', 'lang')}, 1) - 1 pos from q), u as (select distinct term from qt where term not in (select term from v) and strlen(term) >= 3),"
    " c as (select u.term, v.term cand, levenshtein(u.term, v.term) d from u join v on v.f = substr(u.term, 1, 1) and abs(v.b - strlen(u.term)) <= 1 where levenshtein(u.term, v.term) <= 2),"
    " b as (select term, cand from (select *, row_number() over (partition by term order by d, length(cand), cand) rn from c) where rn = 1) select query_id, cast(pos as int) pos, qt.term, coalesce(cand, qt.term) corrected from qt left join b on qt.term = b.term"
)
def jn_spell(s, d):
    v = spelling.vocabulary(bm25.postings(_built(s, d)))
    q = _items(s, d).filter("trim(coalesce(query, '')) <> ''").withColumn("lang", T.detect_language("query"))
    qt = q.select(F.col("item_id").alias("query_id"), F.posexplode(T.tokens_of(T.normalize("query"), "lang")).alias("pos", "term"))
    return spelling.correct(qt, v)


# -- windows and normalisation -----------------------------------------------------------------
_VALID = "v as (select * from (select *, row_number() over (partition by query_id, chunk_id order by scored_at desc) rn from score_breakdown) where rn = 1), c as (select query_id, chunk_id, bm25, case when isnan(semantic) then null else semantic end semantic, exact, proximity from v)"


def _runs(s, d):
    x = load(s, d, "score_breakdown")
    w = Window.partitionBy("query_id", "chunk_id").orderBy(F.col("scored_at").desc())
    return x.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("query_id", "chunk_id", "bm25", F.when(~F.isnan("semantic"), F.col("semantic")).alias("semantic"), "exact", "proximity")


@query(f"with {_VALID} select query_id, chunk_id, round((bm25 - min(bm25) over w) / greatest(max(bm25) over w - min(bm25) over w, 1e-6), 6) nb, round((semantic - min(semantic) over w) / greatest(max(semantic) over w - min(semantic) over w, 1e-6), 6) ns from c window w as (partition by query_id)")
def rk_minmax(s, d):
    x = _runs(s, d)
    return x.select("query_id", "chunk_id", F.round(ranking.min_max("bm25"), 6).alias("nb"), F.round(ranking.min_max("semantic"), 6).alias("ns"))


@query(f"with {_VALID}, b as (select query_id, chunk_id, bm25 from c where bm25 > 0), m as (select query_id, chunk_id, semantic from c where semantic is not null), nb as (select *, (bm25 - min(bm25) over w) / greatest(max(bm25) over w - min(bm25) over w, 1e-6) n from b window w as (partition by query_id)), ns as (select *, (semantic - min(semantic) over w) / greatest(max(semantic) over w - min(semantic) over w, 1e-6) n from m window w as (partition by query_id)) select coalesce(nb.query_id, ns.query_id) query_id, coalesce(nb.chunk_id, ns.chunk_id) chunk_id, round(coalesce(nb.n, 0), 6) bm25, round(coalesce(ns.n, 0), 6) semantic from nb full join ns on nb.query_id = ns.query_id and nb.chunk_id = ns.chunk_id")
def jn_hybrid(s, d):
    x = _runs(s, d)
    c = ranking.candidates(x.filter("bm25 > 0").select("query_id", "chunk_id", F.col("bm25").alias("score")), x.filter("semantic is not null").select("query_id", "chunk_id", F.col("semantic").alias("score")))
    return c.select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"), F.round("semantic", 6).alias("semantic"))


@query(f"with {_VALID} select * from (select query_id, chunk_id, cast(row_number() over (partition by query_id order by round(bm25, 9) desc, chunk_id) as int) as rank from c where bm25 > 0) where rank <= 50")
def tk_rank(s, d):
    x = _runs(s, d).filter("bm25 > 0").withColumn("score", F.col("bm25"))
    return bm25.top_k(x, 50).select("query_id", "chunk_id", "rank")


@query(f"with {_VALID}, u as (select query_id, chunk_id, coalesce(bm25, 0) b, coalesce(semantic, 0) m from c), n as (select *, max(b) over w bh, min(b) over w bl, max(m) over w mh, min(m) over w ml from u window w as (partition by query_id)), z as (select query_id, chunk_id, 0.7 * case when bh = bl then cast(b > 0 as int) else (b - bl) / (bh - bl) end + 0.3 * case when mh = ml then cast(m > 0 as int) else (m - ml) / (mh - ml) end score from n) select query_id, chunk_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) rn from z) where rn <= 10")
def rk_js_simple(s, d):
    x = _runs(s, d).select("query_id", "chunk_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25_raw"), F.coalesce("semantic", F.lit(0.0)).alias("semantic_raw"))
    return ranking.rank_simple(x).filter("rank <= 10").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("select query_id, chunk_id, score from (select query_id, chunk_id, max(bm25) score, row_number() over (partition by query_id order by round(max(bm25), 9) desc, chunk_id) rn from score_breakdown where bm25 is not null group by query_id, chunk_id) where rn <= 10")
def set_shards(s, d):
    return shards.merge_results(load(s, d, "score_breakdown").filter("bm25 is not null").select("query_id", "chunk_id", F.col("bm25").alias("score")), 10).select("query_id", "chunk_id", "score")


@query("select doc_id, printf('shard_%04d', (row_number() over (order by doc_id) - 1) // 128) shard from documents")
def snk_pack(s, d):
    return shards.assign(_docs(s, d), "doc_id", 128).select("doc_id", "shard")


@query("with b as (select source, sum(coalesce(strlen(text), 0)) bytes from documents group by 1), r as (select source, bytes, sum(bytes) over (order by source rows unbounded preceding) running, row_number() over (order by source) rn from b) select source, cast(bytes as bigint) bytes, cast(running as bigint) running from r where running <= 400000 or rn = 1")
def wn_runbytes(s, d):
    b = _docs(s, d).groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("bytes"))
    return shards.within_budget(b, 400_000, "source").select("source", "bytes", "running")


@query("select query, epoch_us(max(scored_at)) as last from score_breakdown where trim(coalesce(query, '')) <> '' group by query order by last desc, query limit 10")
def wn_history(s, d):
    return feedback.history(load(s, d, "score_breakdown"), "query", "scored_at").withColumn("last", F.unix_micros("last"))


@query("with n as (select vec_id, row_number() over (order by vec_id) - 1 rn, count(*) over () // 100 st from embeddings) select vec_id from n where rn % greatest(st, 1) = 0 order by vec_id limit 100")
def wn_sample(s, d):
    e = load(s, d, "embeddings")
    step = max(1, e.count() // 100)
    return shards.number_rows(e.select("vec_id"), "vec_id").filter(F.col("row_no") % step == 0).orderBy("vec_id").limit(100).select("vec_id")


@query("select distinct link as url from (select unnest(links) link from raw_pages) where link is not null union select distinct url from raw_pages where url is not null")
def ag_distinct(s, d):
    p = load(s, d, "raw_pages")
    return feedback.pending(p.select(F.explode("links").alias("url")), p.select("url"))


# -- evaluation --------------------------------------------------------------------------------
@query(f"with rr as (select item_id, row_number() over (partition by item_id order by d) as rank, d from (select item_id, unnest(list_distinct(relevant_docs)) d from {_ITEMS})), q as (select item_id, list_distinct(relevant_docs) rel from {_ITEMS}) select item_id, round((select count(*) from rr where rr.item_id = q.item_id and rank <= 2) / 2, 6) as precision, round(case when coalesce(len(rel), 0) = 0 then 0 else (select count(*) from rr where rr.item_id = q.item_id and rank <= 2) / len(rel) end, 6) recall, case when coalesce(len(rel), 0) = 0 then 0.0 else 1.0 end::double rr from q")
def ev_pr(s, d):
    it = _items(s, d)
    q = it.select(F.col("item_id").alias("query_id"), F.col("relevant_docs").alias("relevant"))
    r = it.select(F.col("item_id").alias("query_id"), F.posexplode(F.array_sort(F.array_distinct("relevant_docs"))).alias("p", "c")).select("query_id", (F.col("p") + 1).alias("rank"), F.concat("c", F.lit("::chunk1")).alias("chunk_id"))
    return evaluation.metrics(q, r, 2).select(F.col("query_id").alias("item_id"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "rr")


@query(
    f"with {S.built()}, {_ALLQ}, {S.bm25()}, {_TOPK.format(k='chunk_id')}, h as (select query_id, split_part(chunk_id, '::', 1) doc, min(rank) as rank from r where rank <= 50 group by all),"
    f" rel as (select item_id as query_id, unnest(list_distinct(relevant_docs)) doc from {_ITEMS}), j as (select i.item_id, count(rel.doc) n, count(*) filter (h.rank <= 10) hits, min(h.rank) as first from {_ITEMS} left join rel on rel.query_id = i.item_id left join h on h.query_id = rel.query_id and h.doc = rel.doc group by 1)"
    " select count(*) queries, round(avg(hits / 10), 6) as precision, round(avg(case when n = 0 then 0 else hits / n end), 6) recall, round(avg(case when first is null then 0 else 1 / first end), 6) mrr from j"
)
def ag_eval(s, d):
    c = materialize(_built(s, d).select("chunk_id", "tokens"), "bm25")
    post = bm25.postings(c)
    it = _items(s, d)
    plan = analyse(it.select(F.col("item_id").alias("query_id"), F.col("query").alias("text")))
    hits = bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan)), 50)
    m = evaluation.report(evaluation.metrics(it.select(F.col("item_id").alias("query_id"), F.col("relevant_docs").alias("relevant")), hits))
    return m.select("queries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")])


_EV = (
    f"with {S.built()}, {_ALLQ}, {S.bm25()}, {_TOPK.format(k='chunk_id')}, h as (select query_id, split_part(chunk_id, '::', 1) doc, min(rank) as rank from r where rank <= 50 group by all),"
    f" rel as (select item_id as query_id, unnest(list_distinct(relevant_docs)) doc from {_ITEMS}), j as (select i.item_id, count(rel.doc) n, count(*) filter (h.rank <= 10) hits, min(h.rank) as first from {_ITEMS} left join rel on rel.query_id = i.item_id left join h on h.query_id = rel.query_id and h.doc = rel.doc group by 1)"
)


def _item_hits(s, d):
    c = materialize(_built(s, d).select("chunk_id", "text", "tokens"), "bm25")
    it = _items(s, d)
    plan = analyse(it.select(F.col("item_id").alias("query_id"), F.col("query").alias("text")))
    post = bm25.postings(c)
    return it, c, bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan)), 50)


@query(f"{_EV} select item_id, round(hits / 10, 6) as precision, round(case when n = 0 then 0 else hits / n end, 6) recall, round(case when first is null then 0 else 1 / first end, 6) rr from j")
def ev_items(s, d):
    """Precision, recall and reciprocal rank of the engine's own results, item by item."""
    it, _, hits = _item_hits(s, d)
    m = evaluation.metrics(it.select(F.col("item_id").alias("query_id"), F.col("relevant_docs").alias("relevant")), hits)
    return m.select(F.col("query_id").alias("item_id"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "rr")])


_FIRST = f"t1 as (select query_id, cb.text from r join cb using (chunk_id) where rank = 1), e1 as (select i.item_id, {S.norm('i.expected_answer')} ec, {S.norm('coalesce(t1.text, ' + repr('') + ')')} ac from {_ITEMS} left join t1 on t1.query_id = i.item_id), e2 as (select item_id, {S.tokens('ec', S.lang('ec'))} e, {S.tokens('ac', S.lang('ac'))} a from e1), e3 as (select item_id, round(case when coalesce(len(e), 0) = 0 then 0 else len(list_filter(e, lambda x: list_contains(a, x))) / len(e) end, 6) accuracy from e2)"


@query(f"with {S.built()}, {_ALLQ}, {S.bm25()}, {_TOPK.format(k='chunk_id')}, {_FIRST} select * from e3")
def ev_answers(s, d):
    """Share of the expected answer's tokens in the first passage found."""
    it, c, hits = _item_hits(s, d)
    first = hits.filter("rank = 1").join(c.select("chunk_id", "text"), "chunk_id").select("query_id", F.col("text").alias("answer"))
    pairs = it.select(F.col("item_id").alias("query_id"), F.col("expected_answer").alias("expected")).join(first, "query_id", "left")
    return evaluation.answer_accuracy(pairs).select(F.col("query_id").alias("item_id"), F.round("accuracy", 6).alias("accuracy"))


@query(f"with {S.built()}, {_ALLQ}, {S.bm25()}, {_TOPK.format(k='chunk_id')}, {_FIRST} select * from e3 order by accuracy, item_id limit 3")
def wn_worst_answers(s, d):
    x = ev_answers(s, d).withColumnRenamed("item_id", "query_id")
    return evaluation.worst(x).select(F.col("query_id").alias("item_id"), "accuracy")


_ACC = f"a as (select item_id, {S.norm('expected_answer')} ec, {S.norm('query')} qc from {_ITEMS}), b as (select item_id, {S.tokens('ec', S.lang('ec'))} e, {S.tokens('qc', S.lang('qc'))} q from a), z as (select item_id, round(case when coalesce(len(e), 0) = 0 then 0 else len(list_filter(e, lambda x: list_contains(coalesce(q, []), x))) / len(e) end, 6) accuracy from b)"


@query(f"with {_ACC} select * from z")
def ev_acc(s, d):
    x = _items(s, d).select(F.col("item_id").alias("query_id"), F.col("expected_answer").alias("expected"), F.col("query").alias("answer"))
    return evaluation.answer_accuracy(x).select(F.col("query_id").alias("item_id"), F.round("accuracy", 6).alias("accuracy"))


@query(f"with {_ACC} select * from z order by accuracy, item_id limit 3")
def wn_worst(s, d):
    x = _items(s, d).select(F.col("item_id").alias("query_id"), F.col("expected_answer").alias("expected"), F.col("query").alias("answer"))
    return evaluation.worst(evaluation.answer_accuracy(x).withColumn("accuracy", F.round("accuracy", 6))).select(F.col("query_id").alias("item_id"), "accuracy")


# -- vectors -----------------------------------------------------------------------------------
def _emb(s, d):
    return load(s, d, "embeddings").filter("embedding is not null").select("vec_id", vectors.unit("embedding").alias("v"))


def _emb_queries(s, d):
    return _emb(s, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


_UNIT = "u as (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) v from embeddings where embedding is not null)"
_VTOP = "select query_id, vec_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) rn from s) where rn <= 10"


@query(f"with {_UNIT}, s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.v, b.v) score from u a, u b where a.vec_id % 50 = 0) {_VTOP}")
def vec_full(s, d):
    return vectors.search_full(_emb(s, d), _emb_queries(s, d), 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


_Q8 = "z as (select vec_id, v, case when list_max(list_transform(v, lambda x: abs(x))) / 127 < 1e-6 then 1.0 else list_max(list_transform(v, lambda x: abs(x))) / 127 end sc from u), i as (select vec_id, v, sc, list_transform(v, lambda x: greatest(-127, least(127, round(x / sc)))) q from z)"


@query(f"with {_UNIT}, {_Q8} select vec_id, cast(list_sum(q) as bigint) total, cast(list_sum(list_transform(q, lambda x: abs(x))) as bigint) size, round(sc, 9) scale from i")
def vec_quantize(s, d):
    z = _emb(s, d).select("vec_id", vectors.quantize("v").alias("z"))
    total = lambda f: F.aggregate("z.q", F.lit(0).cast("bigint"), lambda a, x: a + f(x.cast("bigint")))
    return z.select("vec_id", total(lambda x: x).alias("total"), total(lambda x: F.abs(x)).alias("size"), F.round("z.scale", 9).alias("scale"))


@query(f"with {_UNIT}, {_Q8} select vec_id, cast(generate_subscripts(q, 1) - 1 as int) pos, cast(unnest(q) as int) code from i")
def vec_quantize_codes(s, d):
    z = _emb(s, d).select("vec_id", F.posexplode(vectors.quantize("v")["q"]).alias("pos", "code"))
    return z.select("vec_id", "pos", F.col("code").cast("int").alias("code"))


@query(f"with {_UNIT}, {_Q8}, s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.v, b.q) * b.sc score from u a, i b where a.vec_id % 50 = 0) {_VTOP}")
def vec_i8(s, d):
    z = _emb(s, d).select("vec_id", vectors.quantize("v").alias("z")).select("vec_id", "z.q", "z.scale")
    return vectors.search_i8(z, _emb_queries(s, d), 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"with {_UNIT}, f as (select vec_id, list_transform(v, lambda x: greatest(-127, least(127, floor(x * 127.0 + 0.5)))) q from u), s as (select a.vec_id query_id, b.vec_id, list_dot_product(a.q, b.q) / 16129 score from f a, f b where a.vec_id % 50 = 0) {_VTOP}")
def vec_i8_js(s, d):
    f = _emb(s, d).select("vec_id", vectors.quantize_fixed("v").alias("v"))
    q = f.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    r = vectors.search_full(f, q, 10, "vec_id")
    return r.select("query_id", "vec_id", F.round(F.col("score") / 16129, 6).alias("score"))


def _layout(s, d, **kw):
    return vectors.build(_emb(s, d), "vec_id", **kw)


@query()
def vec_ivf(s, d):
    return vectors.search(_layout(s, d, quantized=False), _emb_queries(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(_SQL["vec_i8"])
def vec_ivf_all(s, d):
    """The inverted file over 8-bit codes with every list probed finds what a scan of the codes finds."""
    every = Config(ivf_probe=Config().ivf_lists)
    return vectors.search(_layout(s, d), _emb_queries(s, d), 10, every).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query()
def vec_pq(s, d):
    return vectors.search(_layout(s, d, pq=True), _emb_queries(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query()
def vec_hnsw(s, d):
    return vectors.search(_layout(s, d, graph=True), _emb_queries(s, d), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("select count(*) queries, true as recall_kept from embeddings where embedding is not null and vec_id % 50 = 0")
def vec_hnsw_recall(s, d):
    """Recall of the graph search against the exact one is at least 0.9."""
    near = lambda x: x.select("query_id", "vec_id")
    exact = near(vectors.search_full(_emb(s, d), _emb_queries(s, d), 10, "vec_id")).withColumn("true", F.lit(1))
    found = near(vectors.search(_layout(s, d, graph=True), _emb_queries(s, d), 10)).withColumn("hit", F.lit(1))
    j = exact.join(found, ["query_id", "vec_id"], "left")
    return j.agg(F.count_distinct("query_id").alias("queries"), (F.sum("hit") >= 0.9 * F.sum("true")).alias("recall_kept"))


@query(f"with {S.chunks()}, cn as (select chunk_id, {S.norm('text')} clean from ck), {R.embedding('cn', 'chunk_id', 'clean', 'ec')} select chunk_id, cast(dim as int) dim, round(c / norm, 6) as value from ec")
def vec_embed_values(s, d):
    """The values of the vectors that are not zero."""
    v = vectors.embed(_chunks(s, d), "chunk_id", "text").select("chunk_id", F.posexplode("v").alias("dim", "value")).filter("value <> 0")
    return v.select("chunk_id", "dim", F.round("value", 6).alias("value"))


@query(f"with {S.chunks()} select chunk_id, cast(384 as int) dims, case when {S.norm('text')} = '' then 0.0 else 1.0 end::double norm from ck")
def vec_embed(s, d):
    v = vectors.embed(_chunks(s, d), "chunk_id", "text")
    return v.select("chunk_id", F.size("v").alias("dims"), F.round(vectors.dot("v", "v"), 5).alias("norm"))


# -- ranking, answers, engine ------------------------------------------------------------------
def _ranked(s, d):
    c, post, plan = _searched(s, d)
    hits = bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan, "expanded")), 150)
    sem = vectors.search_full(vectors.embed(c, "chunk_id", "text"), vectors.embed(plan, "query_id", "text").withColumnRenamed("v", "q"), 150, "chunk_id")
    cands = ranking.candidates(hits, sem)
    return c, plan, ranking.rank(ranking.combine(ranking.features(cands, c, plan))), cands


_FULL = f"with {S.built()}, {S.queries(QUERIES)}, qx as (select query_id, {S.expanded('tokens', 'lang')} ex from qa), {S.bm25(qtok='ex').replace('from qa)', 'from qx)')}, {_TOPK.format(k='chunk_id')}, h as (select * from r where rank <= 150), {R.semantic()}, {R.candidates()}"
_B150 = f"with {S.built()}, {S.queries(QUERIES)}, {S.bm25()}, {_TOPK.format(k='chunk_id')}, h as (select * from r where rank <= 150)"


@query(f"{_B150} select h.query_id, chunk_id, cast(qa.clean <> '' and contains(cb.clean, qa.clean) as double) exact, cast(len(qa.tokens) > 0 and contains(' ' || array_to_string(cb.tokens, ' ') || ' ', ' ' || array_to_string(qa.tokens, ' ') || ' ') as double) phrase, round(len(list_filter(qa.tokens, lambda x: contains(cb.clean, x))) / len(qa.tokens), 6) share from h join cb using (chunk_id) join qa using (query_id)")
def rk_features(s, d):
    c, post, plan = _searched(s, d)
    hits = bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan)), 150)
    f = ranking.features(hits.select("query_id", "chunk_id"), c, plan)
    return f.select("query_id", "chunk_id", "exact", "phrase", F.round(ranking.contains_share(F.col("clean"), F.col("q")), 6).alias("share"))


@query(f"{_B150}, {R.features('h')} select query_id, chunk_id, {', '.join(f'round({c}, 6) {c}' for c in ('exact', 'phrase', 'prox', 'lead', 'title', 'namespace', 'listed'))} from ft")
def rk_signals(s, d):
    """Every signal of the ranking on the 150 best BM25 hits of each query."""
    c, post, plan = _searched(s, d)
    hits = bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan)), 150)
    f = ranking.features(hits.select("query_id", "chunk_id"), c, plan)
    return f.select("query_id", "chunk_id", *[F.round(x, 6).alias(x) for x in ("exact", "phrase", "prox", "lead", "title", "namespace", "listed")])


@query(f"{_FULL}, {R.features('cd')}, {R.combined()} select query_id, chunk_id, round(bm25, 6) bm25, round(semantic, 6) semantic, round(exact, 6) exact, round(phrase, 6) phrase, round(proximity, 6) proximity, round(score, 6) score, fallback, rank from rk")
def rk_combine(s, d):
    r = _ranked(s, d)[2]
    return r.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("bm25", "semantic", "exact", "phrase", "proximity", "score")], "fallback", "rank")


@query(f"{_FULL}, {R.web()} select query_id, chunk_id, kind, round(score, 6) score, rank from rw")
def rk_js(s, d):
    c, _, _, cands = _ranked(s, d)
    extras = cands.select("query_id", "chunk_id", F.lit(0.0).alias("freshness"), F.lit(0.0).alias("feedback"))
    return ranking.rank_web(cands, c, _qs(s), extras).select("query_id", "chunk_id", "kind", F.round("score", 6).alias("score"), "rank")


@query(f"{_FULL}, {R.features('cd')}, {R.combined()}, {R.answers()} {R.best()}")
def ax_answer(s, d):
    c, plan, ranked, _ = _ranked(s, d)
    top = ranked.filter("rank <= 10").select("query_id", "chunk_id", "rank", "score").join(c.select("chunk_id", "text"), "chunk_id")
    best = answers.best_answers(answers.sentence_scores(top, plan), 3)
    return best.select("query_id", "place", "answer", F.round("confidence", 6).alias("confidence"), "level", "source")


@query(f"{_B150}, t as (select query_id, chunk_id, score, unnest({S.sentences_web('text')}) sentence, generate_subscripts({S.sentences_web('text')}, 1) - 1 pos from h join ck using (chunk_id) where rank <= 10), o as (select query_id, chunk_id, pos, sentence, score * 0.6 + 0.4 * case when len(q) = 0 then 0 else len(list_filter(q, lambda x: list_contains({S.tokens_web('sentence')}, x))) / len(q) end as value from t join (select query_id, {S.tokens_web('text')} q from qv) using (query_id)) select query_id, chunk_id, sentence, round(value, 6) as value from (select *, row_number() over (partition by query_id order by round(value, 9) desc, chunk_id, pos) rn from o) where rn = 1")
def ax_demo(s, d):
    c, post, plan = _searched(s, d)
    hits = bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan)), 10).join(c.select("chunk_id", "text"), "chunk_id")
    return answers.demo_answers(hits, _qs(s)).select("query_id", "chunk_id", "sentence", F.round("value", 6).alias("value"))


@query(f"{_B150}, hw as (select query_id, chunk_id, score, ck.text from h join ck using (chunk_id) where rank <= 10), {R.web_answers('hw')} select query_id, chunk_id, sentence, span, round(confidence, 6) confidence from wa")
def ax_js(s, d):
    c, post, plan = _searched(s, d)
    hits = bm25.top_k(bm25.score(post, bm25.term_stats(post), bm25.corpus_stats(c), bm25.query_terms(plan)), 10).join(c.select("chunk_id", "text"), "chunk_id")
    return answers.web_answers(hits, _qs(s)).withColumn("confidence", F.round("confidence", 6))


def _small_index(s, d):
    from lodestar.index import Index

    ix = Index(s, scratch_path(s, "index"), Config(vector_enabled=False))
    return ix, _docs(s, d).select(F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("doc_id"), "text")


@query(f"with {S.built()} select chunk_id, md5(text) as text, len(tokens) n from cb where cast(doc_id as bigint) % 7 <> 0")
def inc_compact(s, d):
    """Two adds, a delete by document and a compaction give what one build of the remaining documents gives."""
    ix, docs = _small_index(s, d)
    ix.add(docs.filter("n % 2 = 0"), batch="a")
    ix.add(docs.filter("n % 2 = 1"), batch="b")
    ix.add(docs.filter("n % 2 = 1"), batch="b")
    ix.delete(docs.filter("n % 7 = 0").select(F.col("doc_id").alias("id")))
    ix.compact()
    return ix.chunks().select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text"), F.size("tokens").cast("bigint").alias("n"))


@query(f"with {S.built()}, k as (select * from cb where cast(doc_id as bigint) % 7 <> 0), t as (select chunk_id, unnest(tokens) term from k) select term, count(distinct chunk_id) df, (select count(*) from k) n, (select cast(coalesce(sum(len(tokens)), 0) as bigint) from k) total_len from t group by term")
def inc_compact_df(s, d):
    """Dictionary and corpus figures after two adds, a delete and a compaction are those of the passages left."""
    ix, docs = _small_index(s, d)
    ix.add(docs.filter("n % 2 = 0"))
    ix.add(docs.filter("n % 2 = 1"))
    ix.delete(docs.filter("n % 7 = 0").select(F.col("doc_id").alias("id")))
    ix.compact()
    return ix.term_stats().crossJoin(ix.corpus_stats().select("n", "total_len"))  # one row


@query(f"with {S.built()} select chunk_id, md5(text) as text from cb where cast(doc_id as bigint) % 3 = 0 or cast(doc_id as bigint) % 3 = 1 and cast(doc_id as bigint) % 2 = 1 union all select doc_id || '::chunk1', md5('renewed ' || doc_id) from (select cast(doc_id as varchar) doc_id from documents where doc_id % 3 = 2)")
def inc_update(s, d):
    """Documents deleted and added again, replaced, and deleted and added in one batch: what is live are the newest versions."""
    from lodestar.streaming.ingest import apply_changes

    ix, docs = _small_index(s, d)
    ix.add(docs.filter("n % 2 = 0 or n % 3 <> 1"))
    ix.delete(docs.filter("n % 3 = 0").select(F.col("doc_id").alias("id")))
    ix.add(docs.filter("n % 3 = 0"))
    ix.update(docs.filter("n % 3 = 2").select("doc_id", F.concat(F.lit("renewed "), "doc_id").alias("text")))
    ops = docs.filter("n % 3 = 1").select(F.lit("delete").alias("op"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("text"))
    apply_changes(ix, ops.unionByName(docs.filter("n % 3 = 1 and n % 2 = 1").select(F.lit("add").alias("op"), F.col("doc_id").alias("id"), "text")), "b")
    return ix.live().select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text"))


_ENGINE = (
    f"with {S.built()}, {S.queries(QUERIES).replace('qa as (', 'q0 as (')}, {R.corrected()}, qx as (select query_id, {S.expanded('tokens', 'lang')} ex from qa), {S.bm25(qtok='ex').replace('from qa)', 'from qx)')}, {_TOPK.format(k='chunk_id')},"
    " h as (select r.* from r join qa using (query_id) where rank <= case when intent = 'factual' then 150 when intent in ('list', 'comparison') then 100 else 50 end),"
    " cd as (select query_id, chunk_id, score bm25_raw, 0 semantic_raw, (score - min(score) over w) / greatest(max(score) over w - min(score) over w, 1e-6) bm25, 0 semantic from h window w as (partition by query_id))"
)


@query(f"{_ENGINE}, {R.features('cd')}, {R.combined()} select rk.query_id, rank, chunk_id, round(score, 6) score, {R.snippet('cb.text', 'qa.tokens')} snippet from rk join cb using (chunk_id) join qa on qa.query_id = rk.query_id where rank <= 10")
def api_search(s, d):
    from lodestar.engine import Engine

    ix, docs = _small_index(s, d)
    ix.add(docs)
    out = Engine(ix).search_many(_qs(s))
    return out["results"].select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "snippet")


@query(f"with {S.built()} select lang, count(*) chunks, count(distinct doc_id) docs, cast(sum(len(tokens)) as bigint) tokens from cb group by lang")
def api_health(s, d):
    ix, docs = _small_index(s, d)
    ix.add(docs)
    return ix.live().groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.sum(F.size("tokens")).cast("bigint").alias("tokens"))


@query(f"with {S.chunks()} select chunk_id, text from ck where cast(doc_id as bigint) % 5 <> 0 and not contains(lower(text), 'museum') and trim(text, ' ') <> ''")
def flt_noise_phrase(s, d):
    c = _chunks(s, d).join(_docs(s, d).filter("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_anti")
    return ranking.without_phrases(c, ("museum",)).filter(F.trim("text") != "").select("chunk_id", "text")


#: The reference's phrases of its demo texts, and one that the test corpus holds.
NOISE = ("bm25 is a ranking function", "stopwords are common words", "exact match and phrase match", "museum")


@query(f"with {S.chunks()} select chunk_id, text from ck where " + " and ".join(f"not contains(lower(text), '{p}')" for p in NOISE))
def flt_noise_phrase_all(s, d):
    """The filter over the passages of all documents."""
    return ranking.without_phrases(_chunks(s, d), NOISE).select("chunk_id", "text")


@query()
def src_json_any(s, d):
    from lodestar.runtime import write_small_text
    from lodestar.sources import readers

    folder = scratch_path(s, "json")
    write_small_text(s, f"{folder}/a.json", json.dumps([{"id": "1", "text": "one"}, {"content": "two", "metadata": {"k": "v"}}, {"id": "x"}]))
    write_small_text(s, f"{folder}/b.json", json.dumps({"body": "three", "id": "3"}))
    write_small_text(s, f"{folder}/c.json", json.dumps({"k1": "four", "k2": {"text": "five"}}))
    return readers.json_any(s, folder)


# readers over whole tables, written out in the form that is read
def _texts(s, d):
    return _docs(s, d).filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), "text")


@query("select cast(doc_id as varchar) id, text from documents where text is not null")
def src_jsonl(s, d):
    from lodestar.sources import readers

    folder = scratch_path(s, "jsonl")
    _texts(s, d).write.json(folder)
    return readers.json_lines(s, folder)


@query("select cast(doc_id as varchar) id, text, source from documents where trim(text, chr(32)) <> ''")
def src_js_jsonl(s, d):
    """The lenient reader: text under another name, meta under another name."""
    from lodestar.sources import readers

    folder = scratch_path(s, "jsonl")
    x = _docs(s, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), F.create_map(F.lit("source"), "source").alias("metadata"))
    x.write.json(folder)
    return readers.json_lines_any(s, folder).select("id", "text", F.col("meta")["source"].alias("source"))


def _nations(s, d):
    return load(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.format_string("The nation %s lies in region %s.", "n_name", "n_regionkey").alias("text"))


@query("select cast(n_nationkey as varchar) || '.txt' id, ('The nation ' || n_name || ' lies in region ' || n_regionkey || '.') as text from nation")
def src_text_dir(s, d):
    from lodestar.runtime import write_small_text
    from lodestar.sources import readers

    folder = scratch_path(s, "texts")
    for r in _nations(s, d).collect():  # 25 rows at any scale
        write_small_text(s, f"{folder}/{r.id}.txt", r.text)
    return readers.text_dir(s, folder)


@query("select cast(n_nationkey as varchar) id, ('The nation ' || n_name || ' lies in region ' || n_regionkey || '.') as text, null as source from nation where n_nationkey % 2 = 0 union all select cast(n_nationkey as varchar) || '.txt', ('The nation ' || n_name || ' lies in region ' || n_regionkey || '.'), cast(n_nationkey as varchar) || '.txt' from nation where n_nationkey % 2 = 1")
def src_js_rawdir(s, d):
    """A folder of JSON documents and text files; JSON lines in it are not read back."""
    from lodestar.runtime import write_small_text
    from lodestar.sources import readers

    folder = scratch_path(s, "raw")
    rows = _nations(s, d).collect()  # 25 rows at any scale
    for r in rows:
        if int(r.id) % 2:
            write_small_text(s, f"{folder}/{r.id}.txt", r.text)
    write_small_text(s, f"{folder}/all.json", json.dumps([{"id": r.id, "text": r.text} for r in rows if int(r.id) % 2 == 0]))
    write_small_text(s, f"{folder}/more.jsonl", json.dumps({"id": "x", "text": "not read"}))
    return readers.raw_dir(s, folder).select("id", "text", F.col("meta")["source"].alias("source"))


@query("select cast(n_nationkey as varchar) id, ('The nation ' || n_name || ' lies in region ' || n_regionkey || '.') as text from nation")
def src_json_array(s, d):
    from lodestar.runtime import write_small_text
    from lodestar.sources import readers

    folder = scratch_path(s, "array")
    write_small_text(s, f"{folder}/a.json", json.dumps([{"id": r.id, "text": r.text} for r in _nations(s, d).collect()]))  # 25 rows at any scale
    return readers.json_auto(s, f"{folder}/a.json")


@query("select 'wiki:' || n_nationkey id, n_name || chr(10) || trim(regexp_replace(('The nation ' || n_name || ' lies in region ' || n_regionkey || '.'), ' +', ' ', 'g')) as text from nation")
def src_wiki_xml(s, d):
    from lodestar.sources import readers

    folder = scratch_path(s, "wiki")
    x = _nations(s, d).select(F.col("name").alias("title"), "id", F.struct(F.concat(F.lit("{{Box|x={{y}}}}"), F.regexp_replace("text", "^(\\w+)", "[[Page|$1]]")).alias("text")).alias("revision"))
    x.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(folder)
    return readers.wiki_xml(s, folder)


@query("select 'wiki:' || n_nationkey id, n_name || chr(10) || substr(trim(regexp_replace(('The nation ' || n_name || ' lies in region ' || n_regionkey || '.'), ' +', ' ', 'g')), 1, 40) as text from nation where n_nationkey % 5 <> 0")
def src_wiki_core(s, d):
    """Namespace pages and redirects are left out, the lead is cut."""
    from lodestar.sources import readers

    folder = scratch_path(s, "wiki")
    body = F.when(F.col("id") % 10 == 5, F.concat(F.lit("#REDIRECT [[X]] "), "text")).otherwise(F.col("text"))
    x = _nations(s, d).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("Category:"), "name")).otherwise(F.col("name")).alias("title"), "id", F.struct(body.alias("text")).alias("revision"))
    x.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(folder)
    return readers.wiki_xml(s, folder, core=True, n_sentences=100, max_chars=40)


@query("select 'web:' || md5('http://n.test/' || n_nationkey) id, n_name || ' ' || trim(regexp_replace(('The nation ' || n_name || ' lies in region ' || n_regionkey || '.'), ' +', ' ', 'g')) as text from nation")
def src_warc(s, d):
    import gzip

    from lodestar.runtime import write_small_bytes
    from lodestar.sources import readers

    folder, parts = scratch_path(s, "warc"), []
    for r in _nations(s, d).collect():  # 25 rows at any scale
        for kind in ("request", "response"):
            body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html><head><title>{r.name}</title></head><body><p>{r.text}</p></body></html>".encode()
            head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://n.test/{r.id}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            parts.append(gzip.compress(head + body + b"\r\n\r\n"))
    write_small_bytes(s, f"{folder}/a.warc.gz", b"".join(parts))
    return readers.warc(s, folder)


@query("with p as (select lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) host, url from raw_pages) select distinct url from p where host not like 'm.%' and not contains(url, '.html')")
def src_robots(s, d):
    """Hosts beginning with m. forbid everything; a rule is a prefix of the path."""
    from lodestar.sources import crawl

    u = load(s, d, "raw_pages").select("url").filter("url is not null").distinct()
    hosts = u.select(T.url_host("url").alias("host")).distinct().filter("host like 'm.%'")
    rules = crawl.robots_rules(hosts.select("host", F.lit("User-agent: *\nDisallow: /  # all\n").alias("body")))
    return crawl.allowed(u, rules).filter("not contains(url, '.html')")


@query(r"select 'web:' || md5(url) id, trim(regexp_replace(regexp_replace(regexp_replace(case when title is null or trim(title, ' ') = '' then '' else title || ' ' end || text, '<[^>]*>', '', 'g'), '&amp;', '&', 'g'), '[\s]+', ' ', 'g')) as text from raw_pages where text is not null and url is not null and trim(regexp_replace(coalesce(title, '') || text, '[\s]+', ' ', 'g')) <> ''")
def src_html_doc(s, d):
    from lodestar.sources import readers

    p = load(s, d, "raw_pages").filter("text is not null").select("url", F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><p>"), "text", F.lit("</p></body></html>")).alias("html"))
    return readers.html_documents(p, "url", "html")


@query("select regexp_replace(url, '#.*$', '') url, 0 depth from raw_pages where trim(coalesce(text, ''), ' ') <> '' and url is not null group by 1")
def src_crawl_seeded(s, d):
    """Every page is a seed: all that have a text come out at depth 0, once."""
    from lodestar.sources import crawl

    p = load(s, d, "raw_pages")
    return crawl.crawl(p, p.select("url"), limit=None).select(T.normalize_url("url").alias("url"), "depth")


@query("select distinct url, 0 depth from raw_pages where trim(coalesce(text, ''), ' ') <> '' and url is not null")
def src_crawl(s, d):
    from lodestar.sources import crawl

    p = load(s, d, "raw_pages")
    return crawl.crawl(p, p.select("url"), limit=None).select("url", "depth")


@query()
def fn_wiki_clean(s, d):
    from lodestar.sources import readers

    return readers.clean_wiki(_docs(s, d), "doc_id", "text")
