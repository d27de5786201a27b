"""Markup residue: which languages a text holds, and clean text that keeps its structure.

Every text is parsed into nodes (language, kind, content), which tell its languages, and into branches:
the elements of its markup as a tree, each with its root-to-leaf path, its text and its span in the source.
Branches of one site are merged into a style tree: per host, a path is held without and with the places of
its steps among their siblings (from the front, from the back), its content the texts that fill it.  A path's
importance is the normalised entropy of its contents over the site's documents: contents that change from
document to document are worth keeping, ones that stay the same are template.  Repeated branches of
low-importance paths are cut out of the source by their span before it is rendered as clean text.

Rendering: headings stand on a line of their own after "# ", list items after "- " or their number,
table rows as cells joined by tabs, code between lines of three backticks, formulas between dollar signs.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.runtime import materialize

LANGUAGES = ("html", "markdown", "wiki", "latex")
#: Fixed: element names of HTML.
_ELEMENTS = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button caption center cite code col dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol option p param pre q s samp script section select small span strike strong "
    "style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
#: Fixed: tags that belong to wiki text.
_WIKI_TAGS = "ref|references|nowiki|math|syntaxhighlight|source|gallery|includeonly|noinclude|onlyinclude|poem"
#: Fixed: LaTeX commands that are evidence of the language.
_COMMANDS = (
    "part|chapter|section|subsection|subsubsection|paragraph|textbf|textit|texttt|textsc|textrm|emph|underline|cite|citep|citet|ref|eqref|label|footnote|item|begin|end|frac|sqrt|hat|bar|vec|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|theta|omega|pi|phi|"
    "le|leq|ge|geq|neq|approx|cdot|times|infty|log|ln|exp|sum|prod|int|partial|documentclass|usepackage|maketitle|title|author|date|caption|includegraphics|href|url|noindent|newcommand|mathrm|mathbf|left|right|ldots|dots|hline|centering"
)
_TAG = re.compile(rf"</?({'|'.join(_ELEMENTS)})(?=[\s/>])[^<>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype[^>]*>", re.I | re.S)
_DROPPED = re.compile(r"<(script|style)(?=[\s>])[^<>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_WIKI_TAG = re.compile(rf"</?(?:{_WIKI_TAGS})(?=[\s/>])[^<>]*>", re.I)
_CODE = re.compile(
    r"(?P<wiki><(syntaxhighlight|source|nowiki)(?=[\s>])[^<>]*>(?P<wiki_c>.*?)</\2\s*>)"
    r"|(?P<html><pre(?=[\s>])[^<>]*>(?:\s*<code(?=[\s>])[^<>]*>)?(?P<html_c>.*?)(?:</code\s*>\s*)?</pre\s*>|<code(?=[\s>])[^<>]*>(?P<html_d>.*?)</code\s*>)"
    r"|(?P<latex>\\begin\{(verbatim|lstlisting)\*?\}(?P<latex_c>.*?)\\end\{(?:verbatim|lstlisting)\*?\})"
    r"|(?P<markdown>^(?P<f>`{3,}|~{3,})[^\n`]*\n(?P<markdown_c>.*?)(?:^(?P=f)[`~]*[ \t]*\r?$|\Z))",
    re.I | re.S | re.M,
)
_INDENTED = re.compile(r"(?:(?<=\n\n)|(?<=\r\n\r\n)|\A)((?:(?: {4}|\t)[^\n]*\S[^\n]*(?:\n|\Z))+)(?=\s*\n|\Z)")
_MATH = re.compile(
    r"(?P<wiki><math(?=[\s>])[^<>]*>(?P<wiki_c>.*?)</math\s*>)"
    r"|(?P<latex>\\begin\{(equation|align|displaymath|eqnarray|math|gather)\*?\}(?P<latex_a>.*?)\\end\{\4\*?\}|\$\$(?P<latex_b>[^$]+)\$\$|\\\[(?P<latex_c>.*?)\\\]|\\\((?P<latex_d>.*?)\\\)|(?<![\w$\\])\$(?P<latex_e>(?=[^$\n]*(?:\\[A-Za-z]|[_^]\{|[_^]\w\b))[^$\n]+)\$(?![\w$]))",
    re.S,
)
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*\r?$", re.M)
_WIKI_QUOTE = re.compile(r"'{2,5}(?=[^\s'])([^\n]*?[^\s'])'{2,5}")
_WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S)
_WIKI_EXT = re.compile(r"(?<!\[)\[(https?://[^\s\[\]]+)(?:\s([^\[\]\n]*))?\](?![\](])")
_LATEX_QUOTE = re.compile(r"``([^`'\n]+)''")
_LATEX_CMD = re.compile(rf"(?<![\w:\\])\\({_COMMANDS})(?![A-Za-z])\*?")
_LATEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}")
_LATEX_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z*]+\}(?:\{[^{}\n]*\}|\[[^\]\n]*\])?")
_LATEX_REF = re.compile(r"~?\\(?:cite[pt]?|ref|eqref|label|footnote|includegraphics|url)(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_LATEX_WRAP = re.compile(r"\\(?:text(?:bf|it|tt|sc|rm)|emph|underline|title|author|date|caption)\{([^{}\n]*)\}")
_MD_HEAD = re.compile(r"(?:\A|(?<=\n))(#{1,6}) ([^\n]*?)(?: #+)?[ \t]*\r?(?=\n|\Z)")
_MD_SETEXT = re.compile(r"^([^\s|>#=\-][^\n]*)\n(={3,}|-{3,})[ \t]*\r?$", re.M)
_MD_BOLD = re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*\*(?![\w*])|(?<!\w)__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?!\w)")
_MD_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
_MD_STRIKE = re.compile(r"~~(?=[^\s~])([^~\n]+?)~~")
_MD_CODE = re.compile(r"(?<![`\w])`([^`\n]+)`(?![`\w])")
_MD_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
_MD_LINK = re.compile(r"(?<![\[\w])\[([^\[\]\n]+)\](?:\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])(?!\])")
_MD_RULE = re.compile(r"^\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*\r?$|^\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*\r?$", re.M)
_MD_TASK = re.compile(r"^[ \t]*[-*+] \[[ xX]\] ", re.M)
_MD_BLOCKQUOTE = re.compile(r"^> ?(?=\S)", re.M)
_MD_REFDEF = re.compile(r"^\[[^\]\n]+\]:[ \t]+\S+.*$", re.M)
_HINT = re.compile(r"[<&\\`$]|\[\[|\{\{|''|\*\S|__|~~|\]\(|\]\[|(?:\A|\n)(?:#|>|\||={3}|-{3}|==)|- \[")


def parse(text: str, known: list[tuple[str, str, str]] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """(clean text, nodes): nodes are (language, kind, content); ``known`` are those of the whole text if this is what is left of it."""
    nodes: list[tuple[str, str, str]] = list(known or ())
    if not nodes and not _HINT.search(text):
        return text, nodes
    kept: list[str] = []

    def hold(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    def node(lang: str, kind: str, body: str = "") -> None:
        nodes.append((lang, kind, body))

    t = text.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")

    if "<" in t:
        def drop(m):
            node("html", (m.lastindex and m.group(1) or "comment").lower(), m.group())
            return ""

        t = _DROPPED.sub(drop, t)
        t = _COMMENT.sub(drop, t)

    def code(m):
        lang = next(x for x in ("wiki", "html", "latex", "markdown") if m.group(x) is not None)
        body = next((m.group(k) for k in ("wiki_c", "html_c", "html_d", "latex_c", "markdown_c") if m.group(k) is not None), "")
        node(lang, "code", body)
        if lang == "wiki" and m.group(2).lower() == "nowiki":
            return hold(body)
        if lang == "html":
            body = html.unescape(_TAG.sub("", body))
        if "\n" in body or lang != "html":
            return "\n" + hold("```\n" + body.strip("\n") + "\n```") + "\n"
        return hold("`" + body + "`")

    if "<" in t or "```" in t or "~~~" in t or "\\begin" in t:
        t = _CODE.sub(code, t)

    def math(m):
        lang = "wiki" if m.group("wiki") is not None else "latex"
        body = next((m.group(k) for k in ("wiki_c", "latex_a", "latex_b", "latex_c", "latex_d", "latex_e") if m.group(k) is not None), "")
        node(lang, "formula", body)
        return hold("$" + " ".join(body.split()) + "$")

    if "$" in t or "<math" in t or "\\" in t:
        t = _MATH.sub(math, t)

    # wiki
    if "<" in t:
        t = re.sub(r"<ref(?=[\s>])[^<>/]*>.*?</ref\s*>|<ref(?=[\s/])[^<>]*/>", lambda m: node("wiki", "ref", m.group()) or "", t, flags=re.S)
        t = _WIKI_TAG.sub(lambda m: node("wiki", "tag", m.group()) or "", t)
    if "{|" in t:
        t = _WIKI_TABLE.sub(lambda m: node("wiki", "table", m.group()) or _wiki_table(m.group()), t)
    while "{{" in t:
        new = _WIKI_TEMPLATE.sub(lambda m: node("wiki", "template", m.group()) or "", t)
        if new == t:
            break
        t = new
    if "[[" in t:
        t = _WIKI_LINK.sub(lambda m: node("wiki", "link", m.group(1)) or ("" if re.match(r"(?i)(?:file|image|category|kategorie|catégorie|categoría|datei|fichier|archivo):", m.group(1)) else m.group(1).split("|")[-1]), t)
    if "``" in t:
        t = _LATEX_QUOTE.sub(lambda m: node("latex", "quote", m.group(1)) or f"“{m.group(1)}”", t)
    if "''" in t:
        t = _WIKI_QUOTE.sub(lambda m: node("wiki", "emphasis", m.group(1)) or m.group(1), t)
    if "==" in t:
        t = _WIKI_HEAD.sub(lambda m: node("wiki", "heading", m.group(2)) or "\n" + hold("# " + m.group(2)) + "\n", t)
    # latex
    if "\\" in t:
        t = _LATEX_HEAD.sub(lambda m: node("latex", "heading", m.group(1)) or "\n" + hold("# " + m.group(1)) + "\n", t)
        t = _LATEX_REF.sub(lambda m: node("latex", "reference", m.group()) or "", t)
        for _ in range(4):
            t, n = _LATEX_WRAP.subn(lambda m: node("latex", "emphasis", m.group(1)) or m.group(1), t)
            if not n:
                break
        t = re.sub(r"[ \t]*\\item\b[ \t]*", lambda m: node("latex", "item") or "- ", t)
        in_table = "\\begin{tabular" in t
        t = _LATEX_ENV.sub(lambda m: node("latex", "environment", m.group()) or "", t)
        if in_table:
            t = re.sub(r"[ \t]*&[ \t]*(?=[^;\n]*\\\\)", "\t", t)
            t = re.sub(r"[ \t]*\\\\[ \t]*$", "", t, flags=re.M)
        t = _LATEX_CMD.sub(lambda m: node("latex", "command", m.group()) or "", t)
    if any(n[0] == "latex" for n in nodes):
        t = re.sub(r"^%[^\n]*\n?", "", t, flags=re.M).replace("~", " ")
    # html
    if "<" in t:
        def tag(m):
            name = m.group(1).lower()
            node("html", name, m.group())
            if m.group().startswith("</"):
                return "\n" if name in ("p", "div", "li", "tr", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else ""
            if re.fullmatch(r"h[1-6]", name):
                return "\n# "
            return {"li": "\n- ", "br": "\n", "p": "\n", "div": "\n", "tr": "\n", "td": "\t", "th": "\t", "hr": "\n"}.get(name, "")

        t = _TAG.sub(tag, t)
    if "&" in t:
        t = _ENTITY.sub(lambda m: m.group() if (u := html.unescape(m.group())) == m.group() else node("html", "entity", m.group()) or (" " if u == "\xa0" else u), t)
    # markdown
    wiki = any(n[0] == "wiki" for n in nodes)

    def head(m):
        before = t[: m.start()].rstrip(" ")
        after = t[m.end() : m.end() + 3].lstrip(" ")
        alone = (not before or before.endswith("\n\n")) and (not after or after.startswith("\n\n") or after == "\n")
        if wiki and not alone or not m.group(2).strip() or any(n[0] == "html" and re.fullmatch(r"h[1-6]", n[1]) and m.group(1) == "#" for n in nodes):
            return m.group()
        if not alone and re.search(r"(?:\A|\n)# ?[^\n]*\Z", before.rstrip("\n")):
            return m.group()
        node("markdown", "heading", m.group(2))
        return hold("# " + m.group(2))

    if "#" in t:
        t = _MD_HEAD.sub(head, t)
    if "===" in t or "---" in t:
        t = _MD_RULE.sub(lambda m: node("markdown", "table", m.group()) or "", t)
        t = _MD_SETEXT.sub(lambda m: node("markdown", "heading", m.group(1)) or hold("# " + m.group(1).strip()), t)
    if "](" in t or "][" in t:
        t = _MD_IMAGE.sub(lambda m: node("markdown", "image", m.group()) or m.group(1), t)
        t = _MD_LINK.sub(lambda m: node("markdown", "link", m.group()) or m.group(1), t)
    if "`" in t:
        t = _MD_CODE.sub(lambda m: node("markdown", "inline code", m.group(1)) or hold("`" + m.group(1) + "`"), t)
    for on, rx, kind in (("*" in t or "__" in t, _MD_BOLD, "bold"), ("~~" in t, _MD_STRIKE, "strike"), ("*" in t or "_" in t, _MD_EM, "emphasis")):
        if on:
            t = rx.sub(lambda m: node("markdown", kind, m.group()) or next(g for g in m.groups() if g is not None), t)  # noqa: B023
    if " [" in t:
        t = _MD_TASK.sub(lambda m: node("markdown", "task", m.group()) or "- ", t)
    if ">" in t:
        t = _MD_BLOCKQUOTE.sub(lambda m: node("markdown", "quote") or "", t)
    if any(n[0] == "markdown" for n in nodes):
        t = _INDENTED.sub(lambda m: node("markdown", "code", m.group(1)) or hold("```\n" + re.sub(r"(?m)^(?: {4}|\t)", "", m.group(1)).strip("\n") + "\n```") + "\n", t)
        if any(n[:2] == ("markdown", "table") for n in nodes):
            t = re.sub(r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", lambda m: re.sub(r"[ \t]*\|[ \t]*", "\t", m.group(1)), t, flags=re.M)
        t = re.sub(r"^[*+][ \t]+", "- ", t, flags=re.M)
    if wiki:
        t = re.sub(r"^\*+[ \t]*(?=\S)", "- ", t, flags=re.M)
        t = re.sub(r"^#+[ \t]*(?=\S)", "- ", t, flags=re.M)
    if not nodes:
        return text, nodes
    t = re.sub(r"[ \t]+\n", "\n", t)
    t = re.sub(r"\n{3,}", "\n\n", t).strip()
    for _ in range(3):  # held parts may hold others
        if "\x00" not in t:
            break
        t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], t)
    return t, nodes


def _wiki_table(s: str) -> str:
    rows = []
    for r in re.split(r"^\|-.*$", s, flags=re.M):
        cells = [c.split("|")[-1].strip() for x in re.findall(r"^[|!](?![}+-])(.*)$", r, flags=re.M) for c in re.split(r"\|\||!!", x)]
        if cells:
            rows.append("\t".join(cells))
    return "\n".join(rows)


def languages(text: str | None) -> set[str]:
    return {n[0] for n in parse(text)[1]} if text else set()


# -- branches ------------------------------------------------------------------------------------
_VOID = frozenset("area base br col embed frame hr img input link meta wbr".split())
_BLOCK = frozenset("address article aside blockquote body center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What an opening tag ends, and the elements that it cannot reach beyond.
_ENDED = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}} | {x: {"p"} for x in _BLOCK}
_WALL = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section select table ul".split())
_NAMED = re.compile(r"\b(class|id)\s*=\s*[\"']?([^\"'<>]*[^\"'<>\s/])", re.I)
_REF = re.compile(r"<ref(?=[\s>])[^<>/]*>.*?</ref\s*>|<ref(?=[\s/])[^<>]*/>", re.S)
_SPANS = (
    ("wiki", "ref", _REF), ("wiki", "table", _WIKI_TABLE), ("wiki", "link", _WIKI_LINK), ("wiki", "emphasis", _WIKI_QUOTE), ("wiki", "heading", _WIKI_HEAD),
    ("latex", "quote", _LATEX_QUOTE), ("latex", "heading", _LATEX_HEAD), ("latex", "reference", _LATEX_REF), ("latex", "emphasis", _LATEX_WRAP),
    ("markdown", "heading", _MD_HEAD), ("markdown", "heading", _MD_SETEXT), ("markdown", "image", _MD_IMAGE), ("markdown", "link", _MD_LINK), ("markdown", "inline code", _MD_CODE),
    ("markdown", "bold", _MD_BOLD), ("markdown", "strike", _MD_STRIKE), ("markdown", "emphasis", _MD_EM),
)


def _unix(text: str) -> str:
    return text.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")


def _elements(t: str) -> list[tuple[int, int, str, str]]:
    """(start, end, language, step) of every element; code, formulas, scripts and comments are closed to what looks like markup in them."""
    out: list[tuple[int, int, str, str]] = []
    hide = lambda m: re.sub(r"[^\n]", "\x01", m.group())
    seen = t

    def leaf(rx, lang, kind):
        nonlocal seen

        def take(m):
            out.append((*m.span(), lang or next(x for x in LANGUAGES if m.groupdict().get(x) is not None), kind or (m.lastindex and m.group(1) or "comment").lower()))
            return hide(m)

        seen = rx.sub(take, seen)

    leaf(_DROPPED, "html", None)
    leaf(_COMMENT, "html", None)
    leaf(_CODE, None, "code")
    leaf(_MATH, None, "formula")
    while (m := _WIKI_TEMPLATE.search(seen)) is not None:  # innermost first
        found = list(_WIKI_TEMPLATE.finditer(seen))
        out += [(*m.span(), "wiki", "template") for m in found]
        seen = _WIKI_TEMPLATE.sub(hide, seen)
    for lang, kind, rx in _SPANS:
        out += [(*m.span(), lang, kind) for m in rx.finditer(seen)]
    stack: list[tuple[int, str, str]] = []

    def close(n: int, end: int) -> None:
        while len(stack) > n:
            start, _, step = stack.pop()
            out.append((start, end, "html", step))

    for m in _TAG.finditer(seen):
        name = m.group(1).lower()
        if m.group().startswith("</"):
            n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] == name), None)
            if n is not None:
                start, _, step = stack[n]
                close(n + 1, m.start())
                stack.pop()
                out.append((start, m.end(), "html", step))
            continue
        if name in _ENDED:
            n = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][1] in _ENDED[name]:
                    n = i
                elif stack[i][1] in _WALL:
                    break
            if n is not None:
                close(n, m.start())
        if name not in _VOID:
            marks = sorted((k.lower(), re.sub(r"\d+", "0", " ".join(v.lower().split()))) for k, v in _NAMED.findall(m.group()))
            stack.append((m.start(), name, name + "".join((".", "#")[k == "id"] + v for k, v in marks)))
    close(0, len(t))
    return out


def branches(text: str) -> list[tuple[int, int, str, tuple[str, str, str], str]]:
    """(start, end, language, paths, content) of every branch of a text with markup; spans count in its Unix form.

    The paths are the steps from the root, then the same with each step's place among its like siblings
    from the front and from the back.  Text beside elements is a branch of its own, at the root line by line.
    """
    t = _unix(text)
    spans = sorted(set(_elements(t)), key=lambda x: (x[0], -x[1]))
    if not spans:
        return []
    kids: list[list[int]] = [[]]
    nodes = [(0, len(t), "", "")]
    open_ = [0]
    for s in spans:
        while len(open_) > 1 and nodes[open_[-1]][1] <= s[0]:
            open_.pop()
        if s[1] > nodes[open_[-1]][1] or s[0] == s[1]:  # crosses another one
            continue
        nodes.append(s)
        kids.append([])
        kids[open_[-1]].append(len(nodes) - 1)
        open_.append(len(nodes) - 1)
    for i in range(len(nodes)):
        if i and (not kids[i] or nodes[i][2] != "html"):
            continue
        start, end, lang, _ = nodes[i]
        edges = [start, *(e for k in kids[i] for e in nodes[k][:2]), end]
        for x, y in zip(edges[::2], edges[1::2]):
            for m in re.finditer(r"[^\n]+" if i == 0 else r"(?s).+", t[x:y]):
                if _TAG.sub("", m.group()).strip():
                    inner = [m.start() + x, m.end() + x]
                    if i:  # the element's own tags belong to it
                        inner[0] += next((g.end() for g in [_TAG.match(m.group())] if g), 0)
                        inner[1] -= next((len(g.group()) for g in [re.search(r"</[^<>]*>\Z", m.group())] if g), 0)
                    nodes.append((*inner, lang or "html", "#text"))
                    kids.append([])
                    kids[i].append(len(nodes) - 1)
        kids[i].sort(key=lambda k: nodes[k][0])
    out = []
    todo = [(0, ("", "", ""))]
    while todo:
        i, above = todo.pop()
        total = Counter(nodes[k][3] for k in kids[i])
        count: Counter = Counter()
        for k in kids[i]:
            start, end, lang, step = nodes[k]
            count[step] += 1
            paths = tuple(f"{a}/{x}" if a else x for a, x in zip(above, (step, f"{step}[{count[step]}]", f"{step}[-{total[step] + 1 - count[step]}]")))
            body = t[start:end]
            if lang == "html" and step not in ("script", "style", "comment", "code"):
                body = html.unescape(_TAG.sub(" ", body))
            if body := " ".join(body.split()):
                out.append((start, end, lang, paths, body))
            todo.append((k, paths))
    return out


#: Where a line of a page ends, and the branches that are lines of their own.
_EDGE = re.compile(rf"\n|</?(?:{'|'.join(sorted(_BLOCK | {'br', 'dd', 'dt', 'li', 'tr'}))})(?=[\s/>])[^<>]*>", re.I)
_STANDS = re.compile(rf"(?:{'|'.join(sorted(_BLOCK | {'comment', 'dd', 'dt', 'heading', 'li', 'script', 'style', 'table', 'tbody', 'template', 'tfoot', 'thead', 'tr'}))})(?![\w ])")
_WORDY = re.compile(r"[^\W_]")


def _digest(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def cut(text: str, gone: set[tuple[str, str, int]]) -> str:
    """Clean text without the branches whose (language, path, content hash) is in ``gone``.

    What stands within a line (links, emphasis, cells, text beside elements) goes only if the rest of the line goes.
    """
    nodes = parse(text)[1]
    found = [(s, e, paths[0].rsplit("/", 1)[-1]) for s, e, lang, paths, body in branches(text) if any((lang, p, _digest(body)) in gone for p in paths)]
    if not found:
        return parse(text)[0]
    t = _unix(text)
    gaps = bytearray(len(t))
    for s, e, _ in found:
        gaps[s:e] = b"\1" * (e - s)
    edges = [0, *sorted({x for m in _EDGE.finditer(t) for x in m.span()}), len(t)]
    whole = [not _WORDY.search(_TAG.sub("", "".join(c for c, g in zip(t[x:y], gaps[x:y]) if not g))) for x, y in zip(edges, edges[1:])]
    spans = []
    for s, e, step in found:
        if _STANDS.match(step) or all(whole[max(0, bisect_right(edges, s) - 1) : bisect_left(edges, e)]):
            spans.append((s, e))
    at, kept = 0, []
    for s, e in sorted(spans):
        kept.append(t[at : max(s, at)])
        at = max(at, e)
    return parse("".join([*kept, t[at:]]), nodes)[0]


class StyleTrees:
    """Branches of every text merged by site.

    Defined results: null and empty texts have no nodes and stay as they are; a null site is a site of
    its own; a key counts once, equal texts of a site count once, null keys not at all; texts without markup come out
    unchanged; other columns are not read.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, site: str):
        self.key = key
        self.src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"))
        self.kt = self.src.schema[0].dataType.simpleString()

    @cached_property
    def tree(self) -> DataFrame:
        """(k, site, doc, nodes): a document's distinct (lang, kind, content); doc is the hash of its text.

        Content nodes have their path as kind; presentation nodes, the marks themselves, have ``~`` and what they are.
        """
        item = pa.struct([("lang", pa.string()), ("kind", pa.string()), ("content", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out, keep, doc = [], [], []
                for i, t in enumerate(b.column(1)):
                    t = t.as_py()
                    marks = {(lang, "~" + kind, _digest(body)) for lang, kind, body in parse(t)[1]} if t else set()
                    if marks:
                        found = marks | {(lang, p, h) for _, _, lang, paths, body in branches(t) for h in [_digest(body)] for p in paths}
                        keep.append(i)
                        doc.append(_digest(t))
                        out.append([{"lang": x, "kind": y, "content": c} for x, y, c in sorted(found)])
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(doc, pa.int64()), pa.array(out, pa.list_(item))], names=["k", "site", "doc", "nodes"])

        return materialize(self.src.filter("t is not null").mapInArrow(run, f"k {self.kt}, site string, doc bigint, nodes array<struct<lang:string,kind:string,content:bigint>>"), "tree")

    def languages(self) -> DataFrame:
        """(key, markup): one row per language of whose presentation nodes a document holds any."""
        marks = F.array_distinct(F.transform(F.filter("nodes", lambda n: n["kind"].startswith("~")), lambda n: n["lang"]))
        return self.tree.select(F.col("k").alias(self.key), F.explode(marks).alias("markup")).distinct()

    @cached_property
    def forms(self) -> DataFrame:
        """(site, lang, kind, content, c): documents that hold a content under a path."""
        voters = self.tree.groupBy("site", "doc").agg(F.min("k").alias("k")).groupBy("k").agg(F.min(F.struct("site", "doc")).alias("v")).select("k", "v.site", "v.doc")
        each = self.tree.join(voters, ["site", "doc", "k"], "left_semi").dropDuplicates(["site", "doc"])
        rows = each.select("site", F.explode("nodes").alias("n")).select("site", "n.lang", "n.kind", "n.content")
        return materialize(rows.groupBy("site", "lang", "kind", "content").agg(F.count(F.lit(1)).alias("c")), "forms")

    def importance(self) -> DataFrame:
        """(site, lang, kind, docs, forms, importance): entropy of a path's contents, 1 for a path seen in one document."""
        docs = self.tree.select("site", "doc", F.explode(F.array_distinct(F.transform("nodes", lambda n: F.struct(n["lang"].alias("lang"), n["kind"].alias("kind"))))).alias("n"))
        docs = docs.select("site", "doc", "n.lang", "n.kind").distinct().groupBy("site", "lang", "kind").agg(F.count(F.lit(1)).alias("docs"))
        return self._entropy().join(docs, ["site", "lang", "kind"]).select("site", "lang", "kind", "docs", "forms", "importance")

    def _entropy(self) -> DataFrame:
        total = self.forms.groupBy("site", "lang", "kind").agg(F.sum("c").alias("uses"), F.count(F.lit(1)).alias("forms"), F.sum(F.col("c") * F.log2("c")).alias("clogc"))
        entropy = F.log2("uses") - F.col("clogc") / F.col("uses")
        return total.withColumn("importance", F.round(F.when(F.col("uses") < 2, 1.0).otherwise(entropy / F.log2("uses")), 9))

    def clean(self, least: float = 0.4, repeats: int = 3) -> DataFrame:
        """(key, text): clean text; contents seen in at least ``repeats`` documents under a path less important than ``least`` are cut out."""
        low = self._entropy().filter(~F.col("kind").startswith("~") & (F.col("importance") < least)).select("site", "lang", "kind")
        common = materialize(self.forms.filter(F.col("c") >= repeats).join(low, ["site", "lang", "kind"]).select("site", "lang", "kind", "content"), "common")
        each = self.tree.select("k", "site", F.explode("nodes").alias("n")).select("k", "site", "n.lang", "n.kind", "n.content")
        drop = each.join(common, ["site", "lang", "kind", "content"]).groupBy("k").agg(F.collect_set(F.struct("lang", "kind", "content")).alias("drop"))
        full = self.src.join(drop, "k", "left").select("k", "t", "drop")
        key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for t, gone in zip(b.column(1), b.column(2).to_pylist()):
                    t = t.as_py()
                    if t:
                        t = cut(t, {(g["lang"], g["kind"], g["content"]) for g in gone}) if gone else parse(t)[0]
                    out.append(t)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

        return full.mapInArrow(run, f"`{key}` {self.kt}, text string")
