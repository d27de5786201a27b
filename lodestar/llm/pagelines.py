"""Lines of crawled pages: path statistics and the split into main body and furniture, and stuffed pages.

Page texts come without tags, so what is left of the layout stands in for a root-to-leaf tag path.  A line
has four paths, from exact to general:

* leaf: host and the line with its digits masked,
* head and tail: its first and its last two words, over all hosts,
* place: the line above it that heads a run of titles (``Related reading`` and what follows).

Over the whole crawl each path is given its pages, hosts, text length and punctuation.  A leaf is template on a
host that shows it on a share of its pages; a head or tail is template where it is so on most of the hosts
that can tell; a line heads a run of titles where what follows it is short, without punctuation and ever
different; nine in ten of its runs give the length of the run.  These ratios are fused with link density (labels that are the page's own links) and smoothed
along the page, and a threshold decides.  Words of some languages serve as a prior for lines of which the
crawl says nothing; ``prior=None`` leaves it out.

Stuffed pages: phrases (one and two words of a line) are exploded and their distinct hosts counted, over all
pages and over those that repeat themselves or list tags and URLs.  A phrase found on such pages of several
hosts, and mostly on such pages, is a stuffing phrase; a page is flagged if more of its words stand in lines stitched of
such phrases, or in lists and repetition, than in sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import hash_words, mix
from lodestar.runtime import materialize

_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://([^/?#]+)", re.I)
_ENDS = re.compile(r"[.!?…][\"'”’)\]»]*$")
_MARK = re.compile(r"^(?:[-–*+·•›>»▪◦]|\d{1,2}[.)])\s+")
_BODY_MARK = re.compile(r"^(?:[-–*+]|\d{1,2}[.)])\s+")
_LABEL_SEP = re.compile(r"\s*[|·>»›]\s*|\s{2,}|\s+/\s+")
_CRUMB_SEP = re.compile(r"\s+[>»/›]\s+")
_TEASER = re.compile(r"^[^.:!?]{3,70}: \S")
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"(?i:https?://|www\.)|#\w|\b[A-Z]{2,}-?\d{3,}")
_PART = re.compile(r"(?<=[.!?])\s+")
_SENTENCE = re.compile(r"[.!?…)][\"'”’)\]»]*$")

#: Fixed: how consent notices, page tools and footers begin, and what heads a sidebar, in the languages of the crawl.
PRIOR_LINE = (
    r"(?i)^(?:©|copyright\b|we use cookies|cookies help|this (?:web)?site (?:uses|stores)|your privacy|powered by|betrieben mit|propulsé par|con la tecnología de|site (?:by|réalisé par)|sitio creado por|"
    r"all rights reserved|subscribe to|abonnez-vous|suscríbase|newsletter abonnieren|follow us|suivez-nous|síganos|folgen sie uns|share this|partager|compartir|teilen|back to top|haut de page|volver arriba|nach oben|"
    r"skip to content|print this page|last updated|updated on|mis à jour le|dernière mise à jour|actualizado el|última actualización|aktualisiert am|zuletzt geändert|ok, got it|accept all|advertisement|publicité|publicidad|anzeige)(?!\w)"
)
PRIOR_SIDE = r"(?i)^(?:related reading|you may also like|in this series|tags|recent posts|editor'?s picks|most read(?: this week)?|more from this section|see also|popular posts|latest news|à lire aussi|articles récents|les plus lus|dans cette série|mots-clés|te puede interesar|lo más leído|entradas recientes|en esta serie|etiquetas|mehr zum thema|neueste beiträge|meistgelesen|in dieser reihe|schlagwörter|das könnte sie auch interessieren)$"

#: A leaf on at least this share of a host's pages, and on so many of them, is template there.
HOST_SHARE, HOST_PAGES = 0.12, 3
#: Hosts of at least so many pages can tell template from content.
VOTERS = 10
#: A head, tail or leaf is template everywhere if so many hosts say so, and this share of those that can tell.
HOSTS, AGREE = 3, 0.5
#: Two lines that follow each other on so many pages of a host are template on any share of them, if words and punctuation are at most THIN.
REPEATS, THIN = 5, 9.0
#: Words of a window, the mean share of distinct words up to which a page repeats itself, and the share up to which a window does.
WINDOW, STALE_PAGE, STALE = 30, 0.6, 0.5
#: Share of a line's phrases from which on it is stitched of stuffing phrases.
STITCHED = 0.1
#: So many lines without sentences, and as many links, are a list of links.
LIST_LINES = 15

SENT, ENDS, BULLET, TAB, CRUMB, MENU, LINKED, HEAD, TEASER, FOLLOWED, P_LINE, P_SIDE, SHORT, TITLE = (1 << k for k in range(14))
#: The length of the run of titles below a line stands above the flags; what the field holds is the longest counted.
RUN, MOST_RUN = 14, (1 << 16) - 1


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


def mask(line: str) -> str:
    return _DIGITS.sub("0", " ".join(line.split()))


def path_hash(masked: str) -> int:
    return xxhash.xxh3_64_intdigest(masked.encode("utf-8", "replace")) - (1 << 63)


def _norm(s: str) -> str:
    return " ".join(_WORD.findall(s.lower()))


def _fold(s: str) -> str:
    return s.encode("ascii", "ignore").decode()


def _last_part(url: str) -> str:
    return re.sub(r"\.html?$", "", re.sub(r"[?#].*$", "", url).rstrip("/").rsplit("/", 1)[-1])


def slug_words(url: str | None, title: str | None, host: str) -> set[str]:
    """Normalised candidates for the article's own heading: the title, and the words of the URL's last part."""
    out = set()
    if title:
        t = title
        for sep in (" | ", " – ", " - ", " — ", " :: ", " » "):
            t = t.replace(sep, "\n")
        out |= {_norm(p) for p in t.split("\n") if host not in p.lower()} | {_norm(title)}
    if url:
        last = _last_part(url)
        if last.count("-") >= 2:
            out.add(_norm(last.replace("-", " ")))
    out.discard("")
    return out


def link_labels(links: list[str] | None) -> set[str]:
    """What the page's links are called: the words of their last part."""
    return {_norm(_last_part(x)) for x in links or () if x}


class Lines:
    """Features of lines, remembered for lines that come again."""

    CAPACITY = 200_000

    def __init__(self, prior: tuple[str, str] | None):
        self.prior = tuple(re.compile(p) for p in prior) if prior else None
        self.memo: dict[str, tuple] = {}

    def __call__(self, t: str) -> tuple:
        """(leaf, head, tail, words, flags, normalised, labels, last label) of a stripped line."""
        hit = self.memo.get(t)
        if hit is not None:
            return hit
        ws = _WORD.findall(t.lower())
        n = len(ws)
        masked = mask(t)
        parts = masked.lower().split(" ")
        ends = bool(_ENDS.search(t))
        f = (ENDS if ends else 0) | (SENT if ends and n >= 4 else 0) | (TAB if "\t" in t else 0)
        labels: tuple[str, ...] = ()
        last = ""
        if n <= 25 or not ends:
            f |= BULLET if _BODY_MARK.match(t) else 0
            split = [p for p in _LABEL_SEP.split(_MARK.sub("", t)) if p]
            labels = tuple(_norm(p) for p in split)
            if len(split) >= 3 and not f & (SENT | TAB) and len(set(split)) == len(split) and all(p.count(" ") <= 2 for p in labels):
                f |= MENU
            crumbs = _CRUMB_SEP.split(t)
            if len(crumbs) >= 2 and not f & SENT:
                last = _norm(crumbs[-1])
                if all(len(_WORD.findall(p)) <= 2 for p in crumbs[:-1]):
                    f |= CRUMB
        if n <= 40 and _TEASER.match(t) and f & SENT:
            f |= TEASER
        if n <= 9:
            f |= SHORT
            if not ends and not f & (BULLET | TAB) and not _MARK.match(t) and not t[0].islower() and not _TAG.search(t):
                f |= TITLE
        if self.prior and n <= 25:
            f |= (P_LINE if self.prior[0].search(t) else 0) | (P_SIDE if n <= 6 and self.prior[1].search(t) else 0)
        out = (path_hash(masked), path_hash(" ".join(parts[:2])), path_hash(" ".join(parts[-2:])), n, f, " ".join(ws), labels, last)
        if n <= 25:
            if len(self.memo) >= self.CAPACITY:
                self.memo.clear()
            self.memo[t] = out
        return out

    def page(self, url: str | None, title: str | None, links: list[str] | None, text: str) -> tuple[str, np.ndarray]:
        """Host and one row per filled line: place, leaf, head, tail, words, flags."""
        host = host_of(url)
        heads = slug_words(url, title, host)
        heads |= {_fold(h) for h in heads}
        names = link_labels(links)
        rows = []
        for i, line in enumerate(text.split("\n")):
            t = line.strip()
            if not t:
                continue
            leaf, head, tail, n, f, norm, labels, last = self(t)
            if norm in heads or _fold(norm) in heads:
                f |= HEAD
            if names and labels and not f & SENT and all(x in names for x in labels):
                f |= LINKED
            if last and last in heads and last != norm:
                f |= CRUMB | LINKED
            rows.append((i, leaf, head, tail, n, f))
        out = np.array(rows, dtype=np.int64).reshape(-1, 6)
        if len(out) > 1:
            child = ((out[:, 5] & (TITLE | TEASER)) != 0) & ((out[:, 5] & HEAD) == 0)
            run = 0
            for k in range(len(out) - 1, -1, -1):
                out[k, 5] |= (FOLLOWED | min(run, MOST_RUN) << RUN) if run else 0
                run = run + 1 if child[k] else 0
        return host, out


def thin_lines(words: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """True where a line's words, twice as many if it ends as a sentence, average at most THIN with those of the line before or after."""
    w = words * np.where(flags & ENDS, 2.0, 1.0)
    if not len(w):
        return np.zeros(0, dtype=bool)
    side = (w[1:] + w[:-1]) / 2
    return np.minimum(np.append(side, w[-1]), np.insert(side, 0, w[0])) <= THIN


FURNITURE, BODY, BLANK, HEADING = 1, 0, -1, 2
#: What the crawl says of a line: see ``Pages``.
SAYS = ("pages", "template", "path", "heads", "runs")


def split_lines(words: np.ndarray, flags: np.ndarray, says: dict[str, np.ndarray], n_pages: int) -> np.ndarray:
    """A class per filled line: FURNITURE, or body (HEADING for the article's own title, else BODY).

    ``says`` holds per line the host's pages with its leaf, whether the leaf is template on hosts, the share of
    hosts on which its head or tail is, how long a run of titles it heads (0: none), and the pages that show it with the
    same neighbour.  A page whose sentences are mostly on as many pages is a copy, not a template.
    """
    n = len(words)
    has = lambda bit: (flags & bit) != 0
    pages, sent, short = says["pages"], has(SENT), words <= 9
    share = pages / max(n_pages, 1)
    own = ((pages >= HOST_PAGES) & (share >= HOST_SHARE)) | ((n_pages < 2 * HOST_PAGES) & (pages >= 2) & (share >= 0.5))
    runs = np.zeros(n, dtype=bool)
    if (says["runs"] >= REPEATS).any() and (not sent.any() or np.median(pages[sent]) < REPEATS):
        runs = (says["runs"] >= REPEATS) & thin_lines(words, flags)
    silent = (pages < 2) & (says["path"] == 0) & (says["template"] == 0)
    plain = ~has(BULLET) & ~has(TAB) & ~has(HEAD)
    score = np.zeros(n)
    score[own & (short | ~sent)] = 1.0
    score[own & (words < 25) & (share >= 0.25)] = 1.0
    score[runs & ~sent & ~has(TAB) & ~has(HEAD)] = 1.0
    score[has(LINKED) & ~sent & ~has(BULLET)] = 1.0
    score[(says["template"] > 0) & plain] = 1.0
    score[(says["path"] >= AGREE) & (words <= 25) & plain & (~sent | (pages > 1) | (says["path"] > 1))] = 1.0
    score[silent & (has(P_LINE) | has(P_SIDE))] = 1.0
    # labels: a line of several, or one among template lines (smoothing along the page)
    near = np.zeros(n)
    for d in (1, 2):
        near[d:] += score[:-d]
        near[:-d] += score[d:]
    free = (score == 0) & ~sent & ~has(TAB)
    label = free & (words <= 3) & ~has(BULLET) & (near >= 3) & ~has(HEAD)
    score[free & has(MENU)] = 0.9
    score[free & has(CRUMB)] = np.maximum(score, 0.8)[free & has(CRUMB)]
    score[label] = np.maximum(score, 0.7)[label]
    # runs of titles below a line that heads them
    header = (score > 0) & ((says["heads"] > 0) | (silent & has(P_SIDE)))
    known = says["path"] >= AGREE
    stop = has(HEAD) | has(BULLET) | has(TAB) | header | ((score > 0) & (known | (words <= 2) | own))
    for at in np.nonzero(header)[0]:
        kind, most = None, int(says["heads"][at]) or n
        for j in range(at + 1, min(n, at + 1 + most)):
            teaser = bool(flags[j] & TEASER)
            if stop[j] or not (teaser or flags[j] & TITLE) or (kind is not None and kind != teaser):
                break
            kind = teaser
            score[j] = max(score[j], 0.8)
    out = np.where(score >= 0.5, FURNITURE, np.where(has(HEAD), HEADING, BODY))
    # headings alone are no body: they belong to whatever they head
    return out if (out == BODY).any() else np.where(out == HEADING, FURNITURE, out)


def stale_words(h: np.ndarray) -> tuple[np.ndarray, float]:
    """True for words in a window of WINDOW words of which at most STALE are distinct, and the windows' mean share; fewer words are one window."""
    n = len(h)
    if n < 8:
        return np.zeros(n, dtype=bool), 1.0
    size = min(WINDOW, n)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    starts = np.arange(n - size + 1)
    fresh = (np.lib.stride_tricks.sliding_window_view(before, size) < starts[:, None]).sum(1)
    low = np.zeros(n + 1, dtype=np.int64)
    bad = np.nonzero(fresh <= STALE * size)[0]
    np.add.at(low, bad, 1)
    np.add.at(low, bad + size, -1)
    return np.cumsum(low)[:n] > 0, float(fresh.mean() / size)


def content_measures(lines: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Word hashes; per filled line words, words in sentences, words that repeat, words of tags and URLs; and how fresh the windows are."""
    rows, ws, fresh = [], [], 1.0
    for line in lines:
        inside = tags = 0
        before = len(ws)
        tagged = _TAG.search(line) is not None
        for part in _PART.split(line):
            w = _WORD.findall(part.lower())
            ws += w
            if tagged and _TAG.search(part):
                tags += len(w)
            elif len(w) >= 5 and _SENTENCE.search(part):
                inside += len(w)
        rows.append((len(ws) - before, inside, 0, tags))
    h = hash_words(ws)
    out = np.array(rows, dtype=np.int64).reshape(-1, 4)
    if len(out):
        stale, fresh = stale_words(h)
        if stale.any():
            ends = np.cumsum(out[:, 0])
            total = np.concatenate([[0], np.cumsum(stale)])
            out[:, 2] = total[ends] - total[ends - out[:, 0]]
    return h, out, fresh


def phrases_of(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and two-word phrases of consecutive lines of ``counts`` words, and where each line's end."""
    ends = np.cumsum(counts)
    size = np.maximum(2 * counts - 1, 0)
    stops = np.cumsum(size)
    out = np.empty(int(size.sum()), dtype=np.uint64)
    at = 2 * np.arange(len(h)) - np.repeat(np.cumsum(counts > 0) - (counts > 0), counts)  # two a word, one less a line
    out[at] = h
    inner = np.ones(len(h), dtype=bool)
    inner[ends[counts > 0] - 1] = False
    k = np.nonzero(inner)[0]
    out[at[k] + 1] = mix(h[k] * np.uint64(3) + h[np.minimum(k + 1, len(h) - 1)])
    return out, stops


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


class Pages:
    """Classified pages: ``table`` holds crawl_id, host, n_lines and place and class of every filled line.

    Defined results: null text has no lines; blank lines have no class; a page fetched again counts
    once in the path statistics; null titles, URLs and links are tolerated; rows with a null crawl_id
    are ignored; an empty table gives an empty table; other columns are not read.
    """

    def __init__(self, pages: DataFrame, prior: tuple[str, str] | None = (PRIOR_LINE, PRIOR_SIDE)):
        ident = F.xxhash64(F.coalesce(F.col("id"), F.md5(F.coalesce("url", F.col("crawl_id").cast("string")))))
        self.source = pages.select(F.col("crawl_id").cast("bigint").alias("crawl_id"), ident.alias("id"), "url", "title", "text", "links").filter("crawl_id is not null and text is not null")

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lines = Lines(prior)
            for b in batches:
                hosts, tables, counts, ends = [], [np.zeros((0, 6), dtype=np.int64)], [], [0]
                for u, ti, te, li in zip(*[b.column(k).to_pylist() for k in range(2, 6)]):
                    host, rows = lines.page(u, ti, li, te)
                    hosts.append(host)
                    tables.append(rows)
                    counts.append(te.count("\n") + 1)
                    ends.append(ends[-1] + len(rows))
                flat = np.concatenate(tables)
                cols = [_lists(flat[:, k], np.array(ends), t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hosts, pa.string()), pa.array(counts, pa.int32()), *cols], names=["crawl_id", "id", "host", "n_lines", "pos", "leaf", "head", "tail", "words", "flags"])

        schema = "crawl_id bigint, id bigint, host string, n_lines int, pos array<int>, leaf array<bigint>, head array<bigint>, tail array<bigint>, words array<int>, flags array<int>"
        self.found = materialize(self.source.mapInArrow(features, schema), "lines").withColumn("h", F.xxhash64("host"))
        self.table = materialize(self._classes(), "pages")

    def _paths(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(leaf per host, leaf, head or tail, neighbours): what the crawl says of each path that says anything."""
        found = self.found
        each = found.select("h", "id", F.explode(F.array_distinct(F.arrays_zip("leaf", "head", "tail", "words"))).alias("x")).select("h", "id", "x.*")
        per_host = each.groupBy("h", "leaf", "id").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("words").alias("words")).groupBy("h", "leaf")
        per_host = per_host.agg(F.count(F.lit(1)).alias("pages"), F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("words").alias("words"))
        self.n_pages = materialize(found.select("h", "id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_pages")), "hosts")
        voters = F.col("n_pages") >= VOTERS
        per_host = materialize(per_host.join(self.n_pages, "h").withColumn("own", (F.col("pages") >= HOST_PAGES) & (F.col("pages") >= HOST_SHARE * F.col("n_pages"))), "leaves")
        leaf = per_host.filter("words <= 25").groupBy("leaf").agg(
            F.count(F.lit(1)).alias("hosts"), F.sum("pages").alias("shown"), F.count(F.when(voters, 1)).alias("voters"), F.count(F.when(voters & (F.col("pages") >= 2), 1)).alias("again"), F.count(F.when(voters & F.col("own"), 1)).alias("owners")
        ).filter(F.col("hosts") >= HOSTS)
        agreed = (F.col("voters") >= HOSTS) & ((F.col("again") >= AGREE * F.col("voters")) | (F.col("owners") >= AGREE * F.col("voters")))
        leaf = leaf.select("leaf", "shown", agreed.cast("int").alias("template")).filter("template = 1")
        leaf = materialize(leaf, "leaf")
        # heads and tails: on how many of the hosts that can tell are the lines that begin or end so template?
        votes = per_host.filter(voters & (F.col("words") <= 25)).join(leaf.select("leaf", F.lit(True).alias("t")), "leaf", "left").withColumn("yes", F.col("own") | F.coalesce("t", F.lit(False)))
        votes = votes.select("h", "pages", "yes", F.explode(F.array_distinct(F.array("head", "tail"))).alias("path"))
        votes = votes.groupBy("path", "h").agg(F.sum("pages").alias("all"), F.sum(F.when(F.col("yes"), F.col("pages"))).alias("yes")).groupBy("path")
        path = votes.agg(F.count(F.when(F.col("yes") >= 0.8 * F.col("all"), 1)).alias("yes"), F.count(F.lit(1)).alias("n")).filter((F.col("yes") >= HOSTS) & (F.col("yes") >= AGREE * F.col("n")))
        path = materialize(path.select("path", (F.col("yes") / F.col("n")).alias("ratio")), "ends")
        # lines that head runs of titles: what follows is a title or teaser, and another one each time
        nxt = F.transform("leaf", lambda x, i: F.struct(x.alias("leaf"), F.get("leaf", i + 1).alias("below"), F.get("flags", i).alias("f")))
        below = found.select("h", F.explode(nxt).alias("x")).filter(F.col("x.f").bitwiseAND(FOLLOWED | SHORT) == FOLLOWED | SHORT).filter(F.col("x.f").bitwiseAND(SENT | HEAD | BULLET | TAB) == 0)
        below = below.select("h", "x.leaf", "x.below", F.shiftright("x.f", RUN).alias("run")).groupBy("leaf", "h", "below").agg(F.max("run").alias("run"))
        below = below.groupBy("leaf").agg(F.count(F.lit(1)).alias("children"), F.percentile_approx("run", 0.9).alias("run"))
        shown = per_host.filter("words <= 9").groupBy("leaf").agg(F.sum("pages").alias("shown"), F.max("pages").alias("most")).filter("most >= 2")
        heads = materialize(below.join(shown, "leaf").filter((F.col("children") >= 0.5 * F.col("shown")) & (F.col("shown") >= 3)).select("leaf", F.col("run").alias("heads")), "heads")
        # neighbours that come together
        pair = F.transform("leaf", lambda x, i: F.struct(F.xxhash64(x, F.get("leaf", i + 1)).alias("pair"), (F.get("words", i) + F.get("words", i + 1) <= 2 * THIN).alias("thin"), F.get("pos", i).alias("pos"), F.get("pos", i + 1).alias("next")))
        pairs = found.select("crawl_id", "h", "id", F.explode(pair).alias("x")).select("crawl_id", "h", "id", "x.*").filter("thin")
        often = materialize(pairs.select("h", "pair", "id").distinct().groupBy("h", "pair").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= REPEATS), "pairs")
        runs = pairs.join(often, ["h", "pair"]).select("crawl_id", F.explode(F.array("pos", "next")).alias("pos"), "together")
        local = per_host.filter("pages > 1").select("h", "leaf", "pages")
        return local, leaf.join(heads, "leaf", "full_outer").select("leaf", F.coalesce("template", F.lit(0)).alias("template"), F.coalesce("heads", F.lit(0)).alias("heads")), path, runs

    def _classes(self) -> DataFrame:
        local, leaf, path, runs = self._paths()
        lines = self.found.select("crawl_id", "h", F.explode(F.arrays_zip("pos", "leaf", "head", "tail")).alias("x")).select("crawl_id", "h", "x.*")
        x = lines.join(local, ["h", "leaf"], "left").join(leaf, "leaf", "left")
        x = x.join(path.select(F.col("path").alias("head"), F.col("ratio").alias("r1")), "head", "left").join(path.select(F.col("path").alias("tail"), F.col("ratio").alias("r2")), "tail", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        # both ends agreeing counts more than one
        ratio = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), F.col("r1") + F.col("r2")).otherwise(F.coalesce("r1", "r2", F.lit(0.0)))
        x = x.select("crawl_id", "pos", zero("pages").alias("pages"), zero("template").alias("template"), ratio.cast("float").alias("path"), zero("heads").alias("heads"), F.lit(0).cast("bigint").alias("runs"))
        x = x.filter("pages > 0 or template > 0 or path > 0 or heads > 0")
        none = [F.lit(0).cast("bigint").alias("pages"), F.lit(0).alias("template"), F.lit(0).cast("float").alias("path"), F.lit(0).alias("heads")]
        x = x.unionByName(runs.select("crawl_id", "pos", *none, F.col("together").alias("runs")))
        says = x.groupBy("crawl_id").agg(F.collect_list(F.struct("pos", *SAYS)).alias("says"))
        full = self.found.select("crawl_id", "host", "h", "n_lines", "pos", "words", "flags").join(self.n_pages, "h").join(says, "crawl_id", "left").select("crawl_id", "host", "n_lines", "n_pages", "pos", "words", "flags", "says")

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ends = b.column(4).offsets.to_numpy()
                ends = ends - ends[0]
                pos, words, flags = (b.column(k).flatten().to_numpy() for k in (4, 5, 6))
                at = b.column(7).offsets.to_numpy()
                at, rows = at - at[0], b.column(7).flatten()
                given = {k: rows.field(k).to_numpy() for k in ("pos", *SAYS)}
                out = np.zeros(len(pos), dtype=np.int8)
                for k, n in enumerate(b.column(3).to_numpy()):
                    s, e = ends[k], ends[k + 1]
                    says = {c: np.zeros(e - s) for c in SAYS}
                    says["pages"] += 1
                    part = slice(at[k], at[k + 1])
                    where = np.searchsorted(pos[s:e], given["pos"][part])
                    for c in SAYS:
                        np.maximum.at(says[c], where, given[c][part])
                    out[s:e] = split_lines(words[s:e], flags[s:e], says, int(n))
                classes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), classes], names=["crawl_id", "host", "n_lines", "pos", "classes"])

        return full.mapInArrow(judge, "crawl_id bigint, host string, n_lines int, pos array<int>, classes array<tinyint>")

    def spam(self, hosts: int = 3) -> DataFrame:
        """(crawl_id, stuffed, prose): pages mostly of keywords, links or product tags, and their words in such lines and in sentences.

        A phrase is a stuffing phrase if at least ``hosts`` hosts show it on pages that repeat themselves or
        list tags, and at least half of its occurrences are on such pages.  A line of which a tenth of the
        phrases are such is stitched; a repetitive line or one of tags counts like it.  A page is flagged if
        its stitched body lines hold more words than its other sentences; so do the lines of a list of
        ``LIST_LINES`` or more, nearly all of the body, for each of which the page has a link.
        """

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cid, hs, pos, seeds = [], [], [], []
                rows, words = [np.zeros((0, 4), dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
                for c, u, t in zip(*[b.column(k).to_pylist() for k in range(3)]):
                    text = [(i, s) for i, line in enumerate(t.split("\n")) if (s := line.strip())]
                    hashes, m, fresh = content_measures([s for _, s in text])
                    total = m.sum(0)
                    rows.append(m)
                    words.append(hashes)
                    pos += [i for i, _ in text]
                    cid += [c] * len(text)
                    hs += [path_hash(host_of(u))] * len(text)
                    seeds += [bool(fresh <= STALE_PAGE or (total[0] >= 8 and total[3] >= 0.3 * total[0]))] * len(text)
                m = np.concatenate(rows)
                phrases, stops = phrases_of(np.concatenate(words), m[:, 0])
                cols = [pa.array(m[:, k], pa.int32()) for k in range(4)]
                lists = _lists(phrases.view(np.int64), np.concatenate([[0], stops]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(hs, pa.int64()), pa.array(pos, pa.int32()), pa.array(seeds, pa.bool_()), *cols, lists], names=["crawl_id", "h", "pos", "seed", "n", "inside", "stale", "tags", "phrases"])

        schema = "crawl_id bigint, h bigint, pos int, seed boolean, n int, inside int, stale int, tags int, phrases array<bigint>"
        lines = materialize(self.source.select("crawl_id", "url", "text").mapInArrow(measure, schema), "phrases")
        seen = lines.select("h", "seed", F.explode("phrases").alias("p")).groupBy("p", "h").agg(F.count(F.lit(1)).alias("shown"), F.count(F.when(F.col("seed"), 1)).alias("dense"))
        seen = seen.groupBy("p").agg(F.sum("shown").alias("shown"), F.sum("dense").alias("dense"), F.count(F.when(F.col("dense") > 0, 1)).alias("hosts"))
        stuffing = materialize(seen.filter((F.col("hosts") >= hosts) & (F.col("dense") >= 0.5 * F.col("shown"))).select("p"), "stuffing")
        hits = lines.select("crawl_id", "pos", F.size("phrases").alias("k"), F.explode("phrases").alias("p")).join(stuffing, "p").groupBy("crawl_id", "pos").agg((F.count(F.lit(1)) / F.first("k")).alias("stitched"))
        body = self.table.select("crawl_id", F.explode(F.arrays_zip("pos", "classes")).alias("x")).filter(F.col("x.classes") == BODY).select("crawl_id", "x.pos")
        x = lines.drop("phrases", "h", "seed").join(body, ["crawl_id", "pos"]).join(hits, ["crawl_id", "pos"], "left")
        stitched = F.coalesce(F.col("stitched"), F.lit(0.0)) >= STITCHED
        loaded = F.when(stitched, F.col("n")).otherwise(F.greatest("stale", "tags"))
        plain = ~stitched & (F.col("inside") == 0) & (loaded * 2 <= F.col("n"))
        sums = x.groupBy("crawl_id").agg(F.sum(loaded).alias("loaded"), F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("inside") == 0, 1)).alias("listed"), F.sum(F.when(plain, F.col("n"))).alias("titles"), F.sum(F.when(stitched | (F.greatest("stale", "tags") * 2 > F.col("n")), 0).otherwise(F.col("inside"))).alias("prose"), F.sum("n").alias("n"))
        # lines of a list that the page has a link for, each
        links = self.source.select("crawl_id", F.size(F.array_distinct(F.coalesce("links", F.array().cast("array<string>")))).alias("links")).filter(F.col("links") >= LIST_LINES)
        sums = sums.join(links, "crawl_id", "left")
        linked = (F.col("listed") >= LIST_LINES) & (F.col("listed") >= 0.8 * F.col("lines")) & (F.col("links") >= F.col("listed"))
        sums = sums.withColumn("stuffed", F.col("loaded") + F.when(linked, F.coalesce("titles", F.lit(0))).otherwise(0))
        return sums.filter((F.col("stuffed") > F.col("prose")) & (F.col("stuffed") >= 0.15 * F.col("n"))).select("crawl_id", "stuffed", "prose")

    def furniture(self) -> DataFrame:
        """(crawl_id, line_no): the lines that are not main body, of pages that are no spam."""
        rows = self.table.join(self.spam().select("crawl_id"), "crawl_id", "left_anti")
        each = rows.select("crawl_id", F.explode(F.arrays_zip("pos", "classes")).alias("x"))
        return each.filter(F.col("x.classes") == FURNITURE).select("crawl_id", F.col("x.pos").cast("bigint").alias("line_no"))


def main_text(pages: DataFrame, classified: Pages) -> DataFrame:
    """(crawl_id, body): the page's text without its furniture lines; null text stays null, a page without a body gets an empty one."""
    cut = F.transform(F.filter(F.arrays_zip("pos", "classes"), lambda x: x["classes"] == FURNITURE), lambda x: x["pos"])
    keep = classified.table.select("crawl_id", cut.alias("cut"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("cut", i))
    return pages.join(keep, "crawl_id", "left").select("crawl_id", F.when(F.col("text").isNotNull(), F.trim(F.array_join(kept, "\n"))).alias("body"))
