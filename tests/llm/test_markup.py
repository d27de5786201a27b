import pytest

from lodestar.llm.markup import StyleTrees, branches, languages, parse


@pytest.mark.parametrize(
    "text,want",
    [
        ("a<br> b", {"html"}),
        ("x &amp; y", {"html"}),
        ("AT&T; a < b and b > 14, we <3 it, mail <ann@host.test>", set()),
        ("'''Bold''' text", {"wiki"}),
        ("[[Link|shown]] and <ref>note</ref>", {"wiki"}),
        ("near{{ref|7}} it", {"wiki"}),
        ("<nowiki><b>x</b></nowiki>", {"wiki"}),
        ("<syntaxhighlight>\nif (a < b) { $x_{1}$ }\n</syntaxhighlight>", {"wiki"}),
        ("<math>\\frac{a}{b}</math>", {"wiki"}),
        ("= '''x'''\n# one\n# two", {"wiki"}),
        ("# Title\n\ntext", {"markdown"}),
        ("Title\n=====\n\ntext", {"markdown"}),
        ("a **b** c", {"markdown"}),
        ("see [it](/x) there", {"markdown"}),
        ("```\n<b>\\section{x}</b>\n```", {"markdown"}),
        ("5 * 3 * 2, C# code, a_b_c_v2, issue #4, ~9 left [sic], {a, b}, $40 to $60, C:\\temp\\x", set()),
        ("the $c_{1}$ case", {"latex"}),
        ("``quoted'' and \\cite{x}", {"latex"}),
        ("\\begin{verbatim}\n**x** <b>\n\\end{verbatim}", {"latex"}),
        ("x<sub>1</sub> **b**", {"html", "markdown"}),
        ("", set()),
        (None, set()),
    ],
)
def test_languages(text, want):
    assert languages(text) == want


def test_structure_survives():
    html = "<h1>T</h1><p>One &amp; two</p><ul><li>a</li><li>b</li></ul><pre><code>x &lt; y\nz</code></pre><script>bad()</script>"
    assert parse(html)[0] == "# T\n\nOne & two\n\n- a\n\n- b\n\n```\nx < y\nz\n```"
    assert parse("\\section{S}\n\n\\begin{itemize}\n\\item a\n\\end{itemize}\n$$x_{1}$$")[0] == "# S\n\n- a\n\n$x_{1}$"
    assert parse("{{Box\n| a = {{b}}\n}}\n==H==\n* x\n[[File:a.jpg|t]]it is [[A|b]]")[0] == "# H\n\n- x\nit is b"
    assert parse("# H\n\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n~~~\ncode\n~~~")[0] == "# H\n\nq\n\na\tb\n\n1\t2\n\n```\ncode\n```"


def test_site_template_is_removed_and_edge_rows(spark):
    rows = [(i, f"<style>.x{{}}</style><h1>Head {i}</h1><b>Same banner</b><p>Body number {i}</p>", "w/h.test", "k") for i in range(6)]
    rows += [(90, None, None, "k"), (91, "", None, "k"), (92, "plain " * 50000, None, "k"), (93, "a <b>x</b>", None, "k"), (93, "a <b>x</b>", None, "k")]
    st = StyleTrees(spark.createDataFrame(rows, "doc_id bigint, text string, site string, markup string"), "doc_id", "text", "site")
    assert {tuple(r) for r in st.languages().collect()} == {(i, "html") for i in [0, 1, 2, 3, 4, 5, 93]}
    imp = {(r.kind): r.importance for r in st.importance().filter("site = 'w/h.test'").collect()}
    assert imp["style"] == 0.0
    clean = {}
    for r in st.clean().collect():
        clean.setdefault(r.doc_id, []).append(r.text)
    assert clean[90] == [None] and clean[91] == [""] and clean[92] == [rows[8][1]] and clean[93] == ["a x", "a x"]
    assert clean[3][0].startswith("# Head 3") and "Body number 3" in clean[3][0]
    empty = StyleTrees(spark.createDataFrame([], "doc_id bigint, text string, site string"), "doc_id", "text", "site")
    assert empty.languages().count() == 0 and empty.clean().count() == 0


def test_branches_leave_by_span(spark):
    page = lambda i, x: f"<div class=\"top\"><b>Same banner</b> <a href='/'>Home</a></div>\n<p>Keep {x} in H<sub>2</sub>O here</p>\n<p>Powered by {x}</p>\n<p>All rights kept</p>\n<pre>&lt;p&gt; and <p> {i}</pre>"
    rows = [(i, page(i, x), "w.test") for i, x in enumerate(["oak", "tin", "clay", "slate"])]
    rows += [(10 + i, f"# Town {x}\n\n**Same banner** [Home](/)\n\nThe **{x}** mill says Same banner.", "md.test") for i, x in enumerate(["oak", "tin", "clay", "slate"])]
    rows += [(20 + i, rows[0][1], "copies.test") for i in range(4)]
    st = StyleTrees(spark.createDataFrame(rows, "doc_id bigint, text string, site string"), "doc_id", "text", "site")
    got = {r.doc_id: r.text for r in st.clean().collect()}
    assert got[1] == "Keep tin in H2O here\n\nPowered by tin\n\n`<p> and  1`"
    assert got[12] == "# Town clay\n\nThe clay mill says Same banner."
    assert got[20] == got[23] and "Same banner" in got[20] and "All rights kept" in got[20]
    assert {x[3][0] for x in branches("<ul><li>a<li><b>b</b> c</ul>")} == {"ul", "ul/li", "ul/li/b", "ul/li/#text"}


def test_long_emphasis_and_quotes_are_marks_too():
    from lodestar.llm.markup import languages

    assert languages("*" + "word " * 60 + "end* and more") == {"markdown"} and languages("``" + "word " * 80 + "end''") == {"latex"}
