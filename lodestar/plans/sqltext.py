"""Pieces of SQL for the checks: the text functions once more, in another engine's dialect."""

from __future__ import annotations

from lodestar.functions import lexicon as L

#: Alphabetic marks of Devanagari, which the other dialect's letter class leaves out.
_MARKS = r"\x{0900}-\x{0903}\x{093A}\x{093B}\x{093E}-\x{094C}\x{094E}\x{094F}\x{0955}-\x{0957}\x{0962}\x{0963}"
WS = r"[ \t\n\x0B\f\r]"


def norm(c: str) -> str:
    return rf"trim(lower(regexp_replace({c}, '[^\p{{L}}\p{{N}}{_MARKS}]+', ' ', 'g')))"


def norm_web(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def lang(c: str) -> str:
    first = rf"regexp_extract({c}, '[\x{{0900}}-\x{{097F}}\x{{0400}}-\x{{04FF}}]')"
    return (
        rf"case when {c} is null then null when regexp_matches({first}, '[\x{{0900}}-\x{{097F}}]') then 'hi' when {first} <> '' then 'other' "
        f"when contains(lower({c}), ' el ') or contains(lower({c}), ' la ') then 'es' else 'en' end"
    )


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def words_ws(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _in(ws: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in ws) + ")"


_EN = r"^([\x00-\x7F]{3,}?)(?:" + "|".join(L.SUFFIX_EN) + ")$"
_ES = r"^([^\x00-\x7F].|.[^\x00-\x7F]|.{3,}?)(?:" + "|".join(dict.fromkeys(L.SUFFIX_ES)) + ")$"


def stem(w: str, g: str) -> str:
    return rf"case {g} when 'en' then regexp_replace({w}, '{_EN}', '\1') when 'es' then regexp_replace({w}, '{_ES}', '\1') else {w} end"


def tokens(clean: str, g: str) -> str:
    w = words(clean)
    one = lambda rx, stop: rf"list_filter(list_transform({w}, lambda x: regexp_replace(x, '{rx}', '\1')), lambda x: x not in {_in(stop)})"
    return f"case {g} when 'en' then {one(_EN, L.STOP_EN)} when 'es' then {one(_ES, L.STOP_ES)} when 'hi' then list_filter({w}, lambda x: x not in {_in(L.STOP_HI)}) else {w} end"


def tokens_web(c: str) -> str:
    return f"list_filter(string_split({norm_web(c)}, ' '), lambda w: w <> '' and w not in {_in(L.STOP_WEB)})"


def sentences(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[^.!?]*[.!?]|[^.!?]+$'), lambda s: {strip('s')}), lambda s: s <> '')"


def sentences_web(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: {strip('s')}), lambda s: s <> '')"


def has(list_: str, ws: str) -> str:
    return f"list_has_any({list_}, [{', '.join(repr(w) for w in ws.split())}])"


def intent(q: str, g: str) -> str:
    w = words(norm(q))
    out = "case "
    for kind in ("comparison", "list", "factual"):
        out += "when " + " or ".join(f"({g} = '{code}' and {has(w, L.INTENTS[code][kind])})" for code in ("en", "es", "hi")) + f" then '{kind}' "
    return out + f"when len({w}) <= 3 and len(list_filter({w}, lambda x: x not in {_in(L.NO_CONTENT)})) > 0 then 'factual' else 'other' end"


def intent_web(q: str) -> str:
    any_ = lambda ws: " or ".join(f"contains(lower({q}), '{w}')" for w in ws)
    return f"case when {any_(L.WEB_COMPARISON)} then 'comparison' when {any_(L.WEB_LIST)} then 'list' else 'factual' end"


def chunks(lo: int = 100, hi: int = 200, target: int = 150, merge: bool = True) -> str:
    """CTEs ending in ck(doc_id, chunk_no, chunk_id, text, total_chunks)."""
    t = min(hi, target)
    merged = f"f > 0 and r < {lo}" if merge else "false"
    return f"""dw as (select cast(doc_id as varchar) doc_id, {words_ws('text')} w from documents where text is not null),
 dn as (select *, len(w) n, cast(greatest(0, ceil((len(w) - {hi}) / {t}.0)) as bigint) f from dw where len(w) > 0),
 dr as (select *, n - f * {t} r from dn),
 dt as (select *, case when {merged} then f else f + 1 end total from dr),
 ck as (select doc_id, cast(i as int) chunk_no, doc_id || '::chunk' || i chunk_id, array_to_string(list_slice(w, (i - 1) * {t} + 1, case when i < total then i * {t} else n end), ' ') as text, cast(total as int) total_chunks
   from (select *, unnest(range(1, total + 1)) i from dt))"""


def built() -> str:
    """chunks() and cb(chunk_id, doc_id, chunk_no, text, clean, lang, tokens)."""
    return f"""{chunks()},
 cn as (select chunk_id, doc_id, chunk_no, text, {norm('text')} clean from ck),
 cl as (select *, {lang('clean')} lang from cn),
 cb as (select *, {tokens('clean', 'lang')} tokens from cl)"""


def queries(rows: list[tuple[int, str]]) -> str:
    """qa(query_id, text, clean, lang, intent, tokens)."""
    v = ", ".join(f"({i}, '{q}')" for i, q in rows)
    return f"""qv(query_id, text) as (values {v}),
 qn as (select *, {norm('text')} clean, {lang('text')} lang from qv),
 qa as (select *, {intent('text', 'lang')} intent, {tokens('clean', 'lang')} tokens from qn)"""


def expanded(tok: str, g: str) -> str:
    def one(code: str) -> str:
        cases = " ".join(f"when x = '{k}' then ['{k}', {', '.join(repr(s) for s in v)}]" for k, v in L.SYNONYMS[code].items())
        return f"flatten(list_transform({tok}, lambda x: case {cases} else [x] end))"

    return f"case {g} when 'en' then {one('en')} when 'es' then {one('es')} when 'hi' then {one('hi')} else {tok} end"


def bm25(table: str = "cb", key: str = "chunk_id", k1: float = 1.5, b: float = 0.75, qtok: str = "tokens") -> str:
    """sc(query_id, key, score) for qa against a table with tokens."""
    return f"""pt as (select {key}, len(tokens) dl, unnest(tokens) term from {table}),
 po as (select {key}, dl, term, count(*) tf from pt group by all),
 st as (select term, count(*) df from po group by term),
 co as (select count(*) n, coalesce(sum(len(tokens)), 0) / greatest(count(*), 1) av from {table}),
 qt as (select query_id, term, count(*) times from (select query_id, unnest({qtok}) term from qa) group by all),
 sc as (select query_id, {key}, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / greatest(av, 1.0)))) score
   from po join st using (term) join qt using (term), co group by all)"""
