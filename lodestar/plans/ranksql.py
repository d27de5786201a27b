"""SQL of the ranking, the answers, the embedding and the fingerprints, for the checks."""

from __future__ import annotations

from lodestar.config import WEB_OVERRIDES, WEB_WEIGHTS, Weights
from lodestar.functions import lexicon as L
from lodestar.plans import sqltext as S

_LIST = "list_filter({0}, lambda x: {1})"


def _byte(h: str, i: str) -> str:
    """Byte i (from 0) of a hexadecimal string."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr({h}, {at}, 1)) - 1)"
    return f"cast(16 * {digit(f'2 * ({i}) + 1')} + {digit(f'2 * ({i}) + 2')} as bigint)"


def embedding(table: str, key: str, clean: str, out: str) -> str:
    """CTE ``out``(key, dim, c, norm): counts of hashed byte n-grams of the padded text."""
    steps = []
    for n in (3, 4, 5):
        h = "cast(2166136261 as bigint)"
        for k in range(n):
            h = f"((xor({h}, {_byte('g', str(k))}) * 16777619) & 4294967295)"
        steps.append(f"when {2 * n} then {h}")
    grams = " union all ".join(f"select {key}, unnest(list_transform(range(0, cast(length(h) / 2 as bigint) - {n - 1}), lambda i: substr(h, 2 * i + 1, {2 * n}))) g from {out}_h where length(h) >= {2 * n}" for n in (3, 4, 5))
    return (
        f"{out}_h as (select {key}, hex(encode(' ' || {clean} || ' ')) h from {table}), {out}_g as ({grams}), {out}_t as (select {key}, g, count(*) n from {out}_g group by all),"
        f" {out}_d as (select g, (case length(g) {' '.join(steps)} end) % 384 dim from (select distinct g from {out}_t)), {out}_c as (select {key}, dim, sum(n) c from {out}_t join {out}_d using (g) group by all),"
        f" {out} as (select {key}, dim, c, sqrt(sum(c * c) over (partition by {key})) norm from {out}_c)"
    )


def semantic(k: int = 150) -> str:
    """CTE sh(query_id, chunk_id, score): the nearest passages of cb for the queries qa."""
    return (
        f"{embedding('cb', 'chunk_id', 'clean', 'ec')}, {embedding('qa', 'query_id', 'clean', 'eq')}, sd as (select query_id, chunk_id, sum(ec.c * eq.c) / (any_value(ec.norm) * any_value(eq.norm)) score from eq join ec using (dim) group by all),"
        f" sa as (select query_id, chunk_id, coalesce(score, 0) score from qa cross join cb left join sd using (query_id, chunk_id)),"
        f" sh as (select query_id, chunk_id, score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) rn from sa) where rn <= {k})"
    )


def candidates() -> str:
    """CTE cd(query_id, chunk_id, bm25_raw, semantic_raw, bm25, semantic) from h and sh."""
    norm = "(score - min(score) over w) / greatest(max(score) over w - min(score) over w, 1e-6)"
    return (
        f"hb as (select query_id, chunk_id, score, {norm} n from h window w as (partition by query_id)), hs as (select query_id, chunk_id, score, {norm} n from sh window w as (partition by query_id)),"
        " cd as (select coalesce(hb.query_id, hs.query_id) query_id, coalesce(hb.chunk_id, hs.chunk_id) chunk_id, coalesce(hb.score, 0) bm25_raw, coalesce(hs.score, 0) semantic_raw, coalesce(hb.n, 0) bm25, coalesce(hs.n, 0) semantic"
        " from hb full join hs on hb.query_id = hs.query_id and hb.chunk_id = hs.chunk_id)"
    )


def _aligned(clean: str, g: str) -> str:
    """Tokens in the places of their words; stop words are empty."""
    w = S.words(clean)
    one = lambda rx, stop: f"list_transform(list_transform({w}, lambda x: regexp_replace(x, '{rx}', '\\1')), lambda x: case when x in {S._in(stop)} then '' else x end)"
    return f"case {g} when 'en' then {one(S._EN, L.STOP_EN)} when 'es' then {one(S._ES, L.STOP_ES)} when 'hi' then list_transform({w}, lambda x: case when x in {S._in(L.STOP_HI)} then '' else x end) else {w} end"


def features(hits: str) -> str:
    """CTE ft: ``hits`` (query_id, chunk_id, ...) with every signal of the ranking."""
    share = "case when len(q) = 0 then 0 else len(list_filter(q, lambda x: contains(clean, x))) / len(q) end"
    cue = " or ".join(f"contains(clean, '{c}')" for c in L.VERB_CUES)
    starts = "len(q) > 0 and len(list_filter(q, lambda x: starts_with(clean, x))) = len(q)"
    width = "list_min(list_transform(flatten(p), lambda e: e - list_min(list_transform(p, lambda l: coalesce(list_max(list_filter(l, lambda x: x <= e)), -1000000))) + 1))"
    return (
        f"fj as (select c.*, qa.clean q_clean, qa.tokens q, intent, cb.clean, cb.lang, cb.tokens, {_aligned('cb.clean', 'cb.lang')} al from {hits} c join qa using (query_id) join cb using (chunk_id)),"
        f" fp as (select *, {share} share, list_transform(q, lambda t: list_filter(range(1, len(al) + 1), lambda i: al[i] = t)) p, intent = 'factual' f from fj),"
        f" ft as (select *, cast(q_clean <> '' and contains(clean, q_clean) as double) exact, cast(len(q) > 0 and contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') as double) phrase,"
        f" case when len(q) < 2 or len(list_filter(p, lambda l: len(l) = 0)) > 0 then 0 else 1 / (1 + {width}) end prox,"
        f" case when len(q) = 0 or clean = '' then 0 else (case when f then share * 0.45 + cast({cue} as int) * 0.25 else share * 0.2 end) * 0.5 end lead,"
        f" case when len(q) = 0 or clean = '' then 0 else (share * 0.25 + cast({starts} as int) * 0.35 + cast(clean = array_to_string(q, ' ') as int) * 0.75) * case when f then 1.4 else 1.0 end end title,"
        f" case when f and regexp_matches(clean, '^({'|'.join(L.NAMESPACES)}):') then -0.25 else 0 end namespace, case when f and (starts_with(clean, 'list of ') or contains(clean, ' list of ')) then -0.2 else 0 end listed from fp)"
    )


def combined() -> str:
    """CTE rk(query_id, chunk_id, bm25, semantic, exact, phrase, proximity, score, fallback, rank) from ft."""
    base = Weights()

    def w(name: str) -> str:
        return "case intent " + " ".join(f"when '{i}' then {getattr(base.for_intent(i), name)!r}" for i in ("factual", "list", "comparison")) + f" else {getattr(base, name)!r} end"

    return (
        f"ca as (select *, prox * ({w('proximity')}) + lead + title + namespace + listed proximity from ft),"
        f" cf as (select *, bm25 * ({w('bm25')}) + semantic * ({w('semantic')}) + exact * ({w('exact')}) + phrase * ({w('phrase')}) + proximity as total from ca),"
        " cg as (select *, max(total) over (partition by query_id) < 0.15 and max(cast(bm25_raw > 0 as int)) over (partition by query_id) = 1 fallback from cf),"
        " ch as (select query_id, chunk_id, bm25, semantic, exact, phrase, proximity, case when fallback then bm25 else total end score, fallback from cg where not fallback or bm25_raw > 0),"
        " rk as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as int) as rank from ch)"
    )


def answers(top: int = 10) -> str:
    """CTE an(query_id, chunk_id, pos, sentence, value): sentences of the best passages of rk."""
    sub = lambda cond: f"len(list_filter(subject, lambda t: {cond}))"
    count = lambda rx: f"len(regexp_extract_all(sentence, '{rx}'))"
    joined = "array_to_string(subject, ' ')"
    head = f"array_to_string(list_slice({S.words('c')}, 1, greatest(len(subject), 3)), ' ')"
    cue = " or ".join(f"contains(' ' || c || ' ', '{x}')" for x in L.VERB_CUES)
    defs = " or ".join(f"contains(c, '{x}')" for x in L.DEFINITION_CUES)
    return (
        f"a1 as (select rk.query_id, rk.chunk_id, rk.score passage, unnest({S.sentences('cb.text')}) sentence, generate_subscripts({S.sentences('cb.text')}, 1) - 1 pos from rk join cb using (chunk_id) where rank <= {top}),"
        f" a2 as (select a1.*, qa.clean q_clean, qa.tokens q, intent = 'factual' f, intent, list_filter(qa.tokens, lambda t: t not in {S._in(L.NO_SUBJECT)}) subject, {S.norm('sentence')} c, len({S.words_ws('sentence')}) ws from a1 join qa using (query_id)),"
        f" a3 as (select *, {S.tokens('c', S.lang('c'))} st, len({S.words('c')}) w, {count(chr(92) + '[|' + chr(92) + ']')} brackets from a2 where ws >= 5 and not (f and (starts_with(c, 'list of ') or contains(c, ' redirect ')))),"
        f" a4 as (select *, case when len(q) = 0 then 0 else len(list_filter(q, lambda x: list_contains(st, x))) / len(q) end ov, cast(q_clean <> '' and contains(c, q_clean) as int) ex, cast(pos = 0 as int) lead, cast({cue} as int) cue,"
        f" case when c = '' then 0 else cast({defs} as int) * 0.35 + case when {sub('starts_with(c, t)')} > 0 then 0.45 when {sub('contains(c, t)')} > 0 then 0.2 else 0 end + case when f and w <= 40 then 0.15 else 0 end end definition,"
        f" case when len(subject) = 0 or c = '' then 0 when {head} = {joined} then 0.8 when starts_with(c, {joined}) then 0.6 else {sub('contains(c, t)')} / greatest(len(subject), 1) * 0.4 end title,"
        f" case when c = '' then 0 else -(len(list_filter({S.words('c')}, lambda x: regexp_matches(x, '[0-9]'))) * 0.04 + {count('[|]')} * 0.12 + brackets * 0.03 + cast(regexp_matches(sentence, 'wikitable|sortable') as int) * 0.5) end noise,"
        f" case when c = '' then -1 else -(cast(w < 4 as int) * 0.7 + cast(w > 45 as int) * 0.35 + cast(brackets > 4 as int) * 0.35 + cast(regexp_matches(sentence, '<ref|ref>') as int) * 0.25"
        rf" + cast(len(regexp_extract_all(sentence, '[^\p{{L}}\p{{N}}{S._MARKS}\s]')) > w * 3 as int) * 0.2 + cast(starts_with(c, 'wikimedia ') or contains(c, ' wikimedia ') as int) * 0.08) end quality from a3),"
        " an as (select query_id, chunk_id, pos, sentence, (passage * 0.34 + ov * 0.3 + ex * 0.12 + lead * 0.12 + definition + lead * title + greatest(ov, ex) * 0.12 * cast(f as int) + cue * 0.2 * cast(f as int) + noise + quality)"
        " * case when f then 1 / (1 + abs(ws - 18) / 18) else 1 / (1 + ws / case intent when 'list' then 32.0 when 'comparison' then 28.0 else 25.0 end) end as value from a4)"
    )


def best(k: int = 3) -> str:
    return (
        "select query_id, cast(place as int) place, sentence as answer, round(greatest(0, least(1, value)), 6) confidence, case when value > 0.75 then 'high' when value > 0.5 then 'medium' else 'low' end as level, chunk_id as source"
        f" from (select *, row_number() over (partition by query_id order by round(value, 9) desc, chunk_id, pos) place from an) where place <= {k}"
    )


def web() -> str:
    """CTE rw(query_id, chunk_id, kind, score, rank): the web profile over the candidates cd."""
    unit = lambda c: f"case when max({c}) over w = min({c}) over w then cast({c} > 0 as int) else ({c} - min({c}) over w) / (max({c}) over w - min({c}) over w) end"

    def weight(name: str) -> str:
        over = " ".join(f"when '{k}' then {o[name]!r}" for k, o in WEB_OVERRIDES.items() if name in o)
        return f"case kind {over} else {WEB_WEIGHTS[name]!r} end" if over else repr(WEB_WEIGHTS[name])

    pad = lambda x: f"' ' || array_to_string({x}, ' ') || ' '"
    return (
        f"w1 as (select cd.query_id, cd.chunk_id, {S.intent_web('qv.text')} kind, {S.norm_web('qv.text')} qc, {S.tokens_web('qv.text')} q, {S.norm_web('cb.text')} c, {S.tokens_web('cb.text')} t, {unit('bm25_raw')} nb, {unit('semantic_raw')} ns"
        f" from cd join qv using (query_id) join cb using (chunk_id) window w as (partition by cd.query_id)),"
        f" w2 as (select *, cast(qc <> '' and contains(c, qc) as int) exact, cast(len(q) > 0 and contains({pad('t')}, {pad('q')}) as int) phrase from w1),"
        f" w3 as (select query_id, chunk_id, kind, nb * {weight('bm25')} + ns * {weight('semantic')} + exact * {weight('exact')} + phrase * {weight('phrase')} score from w2),"
        " rw as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as int) as rank from w3)"
    )


def web_answers(hits: str) -> str:
    """CTE wa(query_id, chunk_id, sentence, span, confidence): the best sentence of each query and its shortest covering span."""
    starts = "list_min(list_transform(q, lambda t: coalesce(list_max(list_filter(range(1, i + 1), lambda x: nw[x] = t)), -1000000)))"
    return (
        f"b1 as (select query_id, chunk_id, score, unnest({S.sentences_web('text')}) sentence, generate_subscripts({S.sentences_web('text')}, 1) - 1 pos from {hits}),"
        f" b2 as (select b1.*, {S.tokens_web('qv.text')} q, {S.tokens_web('sentence')} st, {S.words_ws('sentence')} ws from b1 join qv using (query_id)),"
        f" b3 as (select *, list_transform(ws, lambda x: {S.norm_web('x')}) nw, case when len(q) = 0 then 0 else len(list_filter(q, lambda x: list_contains(st, x))) / len(q) end overlap from b2),"
        f" b4 as (select *, len(q) > 0 and len(list_filter(q, lambda t: list_contains(nw, t))) = len(q) whole, list_transform(range(1, len(nw) + 1), lambda i: i - {starts} + 1) widths from b3),"
        " b5 as (select *, list_min(widths) width, list_position(widths, list_min(widths)) last from b4),"
        f" b6 as (select *, case when whole then array_to_string(list_slice(ws, last - width + 1, last), ' ') else {S.strip('sentence')} end span from b5),"
        f" b7 as (select *, len({S.words_ws('span')}) sw from b6),"
        " b8 as (select *, score + overlap confidence from (select *, row_number() over (partition by query_id, chunk_id order by overlap desc, sw, pos) rn from b7) where rn = 1),"
        " wa as (select query_id, chunk_id, sentence, span, confidence from (select *, row_number() over (partition by query_id order by round(confidence, 9) desc, chunk_id) r2 from b8) where r2 = 1)"
    )


def fingerprints() -> str:
    """CTE sg(doc_id, sig): 64-bit SimHash of the words of documents, as a signed number."""
    prime, wrap = "1099511628211", "18446744073709551616"
    h = f"list_reduce(list_prepend(cast(14695981039346656037 as hugeint), list_transform(range(0, cast(length(hx) / 2 as bigint)), lambda i: cast({_byte('hx', 'i')} as hugeint))), lambda a, b: (xor(a, b) * {prime}) % {wrap})"
    return (
        f"gw as (select doc_id, {S.words(S.norm('coalesce(text, ' + repr('') + ')'))} w from documents), ge as (select doc_id, len(w) n, unnest(w) word from gw), gd as (select word, {h} h from (select distinct word, hex(encode(word)) hx from ge)),"
        " gb as (select word, cast(i as int) bit, cast((h // power_of) % 2 as int) is_set from gd, (select i, cast(1 as hugeint) << cast(i as int) power_of from range(64) r(i))),"
        " gs as (select doc_id, bit, any_value(n) n, sum(is_set) ones from ge join gb using (word) group by doc_id, bit),"
        " gu as (select doc_id, sum(case when ones * 2 > n then cast(1 as hugeint) << bit else cast(0 as hugeint) end) u from gs group by doc_id),"
        f" sg as (select d.doc_id, cast(case when coalesce(u, 0) >= 9223372036854775808 then coalesce(u, 0) - {wrap} else coalesce(u, 0) end as bigint) sig from documents d left join gu using (doc_id))"
    )


def freshness(now: str) -> str:
    """Seconds of the first readable date of a document, then its freshness; for dates as the test tables write them."""
    v = "trim(coalesce(list_extract(map_extract(meta, '{0}'), 1), ''))"
    one = lambda k: (
        f"case when regexp_matches({v.format(k)}, '^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}$') then epoch(coalesce(try_strptime({v.format(k)}, '%Y-%m-%d'), try_strptime({v.format(k)}, '%Y/%m/%d')))"
        f" when regexp_matches({v.format(k)}, '^[0-9]{{13}}$') then cast({v.format(k)} as double) / 1000 when regexp_matches({v.format(k)}, '^[0-9]{{10}}$') then cast({v.format(k)} as double)"
        f" when regexp_matches({v.format(k)}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]') then epoch(coalesce(try_strptime({v.format(k)}, '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime({v.format(k)}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({v.format(k)}, '%Y-%m-%dT%H:%M:%S'), try_strptime({v.format(k)}, '%Y-%m-%d %H:%M:%S'))) end"
    )
    return f"select doc_id, round(case when t is null then 0 else 1 / (1 + greatest(({now} - t) / 86400, 0) / 30) end, 9) freshness from (select doc_id, coalesce({', '.join(one(k) for k in L.DATE_KEYS)}) t from documents)"


def corrected() -> str:
    """CTE qa from q0: tokens that no passage of cb holds become the nearest one that does."""
    return (
        "vt as (select distinct term from (select unnest(tokens) term from cb) where term <> ''), qk as (select query_id, unnest(tokens) term, generate_subscripts(tokens, 1) pos from q0),"
        " un as (select distinct term from qk where term not in (select term from vt) and strlen(term) >= 3),"
        " cc as (select un.term, vt.term cand, levenshtein(un.term, vt.term) d from un join vt on substr(vt.term, 1, 1) = substr(un.term, 1, 1) and abs(strlen(vt.term) - strlen(un.term)) <= 1 where levenshtein(un.term, vt.term) <= 2),"
        " nb as (select term, cand from (select *, row_number() over (partition by term order by d, length(cand), cand) rn from cc) where rn = 1),"
        " qf as (select query_id, list(coalesce(cand, qk.term) order by pos) fixed from qk left join nb using (term) group by query_id),"
        " qa as (select q0.* exclude (tokens), coalesce(fixed, tokens) tokens from q0 left join qf using (query_id))"
    )


def snippet(text: str, tokens: str, n: int = 180) -> str:
    """The stretch around the first token found, its tokens in brackets."""
    at = f"list_filter(list_transform({tokens}, lambda t: instr(lower({text}), t)), lambda p: p > 0)[1]"
    cut = f"case when length({text}) <= {n} then {text} else {S.strip(f'substr({text}, greatest(coalesce({at}, 1) - 40, 1), {n})')} end"
    return f"array_to_string(list_transform({S.words_ws(cut)}, lambda w: case when list_contains({tokens}, regexp_replace(lower(w), '[^a-z0-9]', '', 'g')) then '[' || w || ']' else w end), ' ')"


def greedy(bits: int = 16, radius: int = 3) -> str:
    """Query of the documents kept when each bucket of the fingerprints sg is gone through in order."""
    return (
        f"with recursive {fingerprints()}, fs as (select sig, min(doc_id) doc_id from sg group by sig), b0 as (select *, (sig >> {64 - bits}) & {(1 << bits) - 1} bucket from fs),"
        " b as (select *, row_number() over (partition by bucket order by doc_id) rn from b0),"
        f" g as (select bucket, rn, [sig] kept from b where rn = 1 union all select b.bucket, b.rn, case when len(list_filter(kept, lambda k: bit_count(xor(k, b.sig)) <= {radius})) = 0 then list_append(kept, b.sig) else kept end from g join b on b.bucket = g.bucket and b.rn = g.rn + 1),"
        " last as (select bucket, kept from (select *, row_number() over (partition by bucket order by rn desc) r from g) where r = 1)"
        " select doc_id from b join last using (bucket) where list_contains(kept, sig)"
    )
