import gzip
import json
import struct
import zlib

from lodestar.sources import crawl, readers


def test_text_and_json(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a b.txt").write_text("one\ntwo")
    (tmp_path / "t/c.md").write_text("no")
    assert [tuple(r) for r in readers.text_dir(spark, str(tmp_path / "t")).collect()] == [("a b.txt", "one\ntwo")]
    arr, lines = tmp_path / "a.json", tmp_path / "b.jsonl"
    arr.write_text(" \n" + json.dumps([{"id": "1", "text": "x"}, {"id": "2", "text": "y"}]))
    lines.write_text('{"id": "1", "text": "x"}\nbroken\n{"id": "2", "text": "y"}\n')
    for p in (arr, lines):
        assert sorted(tuple(r) for r in readers.json_auto(spark, str(p)).collect()) == [("1", "x"), ("2", "y")]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_lenient_json(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps([{"id": "1", "text": "one"}, {"content": "two", "metadata": {"k": "v"}}, {"id": "x"}, {"text": " "}]))
    got = {r.text: (r.id, r.meta) for r in readers.json_any(spark, str(tmp_path / "a.json")).collect()}
    assert got["one"] == ("1", None) and got["two"][1] == {"k": "v"} and len(got) == 2
    (tmp_path / "o.json").write_text(json.dumps({"k1": "four", "k2": {"body": "five"}}))
    assert {(r.id, r.text) for r in readers.json_any(spark, str(tmp_path / "o.json")).collect()} == {("k1", "four"), ("k2", "five")}
    (tmp_path / "s.json").write_text(json.dumps({"id": "s", "body": "b"}))
    assert [(r.id, r.text) for r in readers.from_path(spark, str(tmp_path / "s.json")).collect()] == [("s", "b")]
    (tmp_path / "l.jsonl").write_text('{"text": "a"}\nbad\n{"x": 1}\n{"content": "b"}\n')
    assert [(r.id, r.text) for r in readers.json_lines_any(spark, str(tmp_path / "l.jsonl")).orderBy("id").collect()] == [("doc-0", "a"), ("doc-1", "b")]


def test_wiki(spark, tmp_path):
    page = lambda t, i, x: f"<page><title>{t}</title><id>{i}</id><revision><id>9</id><text>{x}</text></revision></page>"
    xml = "<mediawiki>" + page("Mill", 7, "{{Box|{{x}}}}The '''mill''' [[a|is]] old. It [[stands]]. Third &lt;b&gt;one&lt;/b&gt;.") + page("Category:X", 8, "text") + page("R", 9, "#REDIRECT [[Mill]]") + "</mediawiki>"
    p = tmp_path / "d.xml"
    p.write_text(xml)
    all_ = {r.id: r.text for r in readers.wiki_xml(spark, str(p)).collect()}
    assert set(all_) == {"wiki:7", "wiki:8", "wiki:9"} and all_["wiki:7"] == "Mill\nThe '''mill''' is old. It stands. Third one."
    assert [tuple(r) for r in readers.wiki_xml(spark, str(p), core=True).collect()] == [("wiki:7", "Mill\nThe mill is old. It stands.")]
    assert readers.wiki_plain("a [[File:x.png|y]] [[b]] {{c {{d}} e}} <i>f</i> [[open") == "a b f [[open"


def test_html_and_warc(spark, tmp_path):
    html = '<html><head><title> T </title></head><body>One <a href="/x#y">two</a><a href="mailto:a@b">m</a></body></html>'
    assert readers.parse_page(html, "http://h/p") == ("T", "One two m", ["http://h/x"])
    assert readers.parse_page("no body", "") == ("", "no body", [])
    rec = lambda kind, uri, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    data = gzip.compress(rec("warcinfo", "", b"x")) + gzip.compress(rec("response", "http://h/p", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + html.encode())) + gzip.compress(rec("response", "http://h/e", b"HTTP/1.1 200 OK\n\n"))
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = readers.warc(spark, str(tmp_path / "a.warc.gz")).collect()
    assert [r.text for r in got] == ["T One two m"] and got[0].id.startswith("web:") and len(got[0].id) == 36


def _v(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _f(k, v):
    return _v(k << 3 | 2) + _v(len(v)) + v if isinstance(v, bytes) else _v(k << 3) + _v(v)


def test_osm(spark, tmp_path):
    zig = lambda n: (n << 1) ^ (n >> 63)
    strings = [b"", b"name", b"Inn", b"addr:street", b"Mill Rd", b"shop", b"bakery", b"x", b"y"]
    table = b"".join(_f(1, s) for s in strings)
    dense = _f(1, _v(zig(5)) + _v(zig(-2))) + _f(10, b"\x01\x02\x03\x04\x00\x07\x08\x00")
    way = _f(1, 9) + _f(2, b"\x05\x01") + _f(3, b"\x06\x02")
    block = _f(1, table) + _f(2, _f(2, dense)) + _f(2, _f(3, way))
    blob = _f(2, len(block)) + _f(3, zlib.compress(block))
    head = _f(1, b"OSMData") + _f(3, len(blob))
    (tmp_path / "m.osm.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    assert sorted(tuple(r) for r in readers.osm_pbf(spark, str(tmp_path / "m.osm.pbf")).collect()) == [("osm:node:5", "Inn addr:street=Mill Rd"), ("osm:way:9", "Inn shop=bakery")]


def test_crawl(spark):
    pages = [("http://a/1", "t", "x", ["http://a/2", "http://a/no/3", "http://a/1#z"]), ("http://a/2", "t", "x", ["http://b/4"]), ("http://a/no/3", "t", "x", []), ("http://b/4", "t", "x", ["http://b/5"]), ("http://b/5", "t", " ", [])]
    snap = spark.createDataFrame(pages, "url string, title string, text string, links array<string>")
    rules = crawl.robots_rules(spark.createDataFrame([("a", "User-agent: *\nDisallow: /no\nDisallow:\n")], "host string, body string"))
    seeds = spark.createDataFrame([("http://a/1",)], "url string")
    assert [(r.url, r.depth) for r in crawl.crawl(snap, seeds, rules).collect()] == [("http://a/1", 0), ("http://a/2", 1), ("http://b/4", 2)]
    assert crawl.crawl(snap, seeds, rules, max_depth=1).count() == 2


def test_crawl_follows_relative_links_and_every_page_comes_out(spark, tmp_path):
    rows = [(7, "http://a/x/1", "t", "x", ["2?p=1", "/z#top", "../y", "mailto:m@a", None, "//b/4"]), (8, "http://a/x/2?p=1", "t", "x", None), (9, "http://a/z", "t", " ", []), (10, "http://a/z", "t", "x", []), (11, "http://a/y", "t", "x", []), (12, "http://b/4", "t", "x", [])]
    snap = spark.createDataFrame(rows, "crawl_id bigint, url string, title string, text string, links array<string>")
    got = {(r.url, r.depth) for r in crawl.crawl(snap, snap.filter("crawl_id = 7").select("url")).collect()}
    assert got == {("http://a/x/1", 0), ("http://a/x/2?p=1", 1), ("http://a/z", 1), ("http://a/y", 1), ("http://b/4", 1)}
    snap.write.parquet(str(tmp_path / "raw_pages.parquet"))
    from lodestar.plans.catalog import queries

    assert {r.url for r in queries()["src_crawl"](spark, str(tmp_path)).collect()} == {u for u, _ in got}


def test_folders_and_raw_dir(spark, tmp_path):
    (tmp_path / "f/sub").mkdir(parents=True)
    (tmp_path / "f/a b.txt").write_text("one")
    (tmp_path / "f/sub/b.json").write_text(json.dumps([{"id": "2", "text": "two"}]))
    (tmp_path / "f/c.jsonl").write_text('{"id": "3", "text": "three"}\n')
    (tmp_path / "f/d.md").write_text("no")
    got = {r.id: (r.text, r.meta) for r in readers.from_path(spark, str(tmp_path / "f")).collect()}
    assert got == {"a b.txt": ("one", {"source": "a b.txt"}), "2": ("two", None), "3": ("three", None)}
    assert {r.id for r in readers.raw_dir(spark, str(tmp_path / "f")).collect()} == {"a b.txt", "2"}
    (tmp_path / "empty").mkdir()
    assert readers.from_path(spark, str(tmp_path / "empty")).count() == 0


def test_bytes_are_cut_between_characters(spark):
    rows = spark.createDataFrame([("ééé",), ("abc",), ("aé€b",)], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(readers.cut_bytes(F.col("t"), 3)).collect()] == ["é", "abc", "aé"]


def test_an_archive_of_many_records_is_streamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "_FLUSH", 1000)
    rec = lambda i: (b := f"HTTP/1.1 200 OK\r\n\r\n<p>page {i} {'x' * 200}</p>".encode()) and f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{i}\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n"
    for k in range(2):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(gzip.compress(rec(100 * k + i)) for i in range(40)))
    got = readers.warc(spark, str(tmp_path)).collect()
    assert len(got) == 80 and len({r.id for r in got}) == 80


def test_clicks_and_pending(spark, tmp_path):
    from lodestar import sinks
    from lodestar.operators import feedback

    clicks = spark.createDataFrame([(" Old Mill", "1"), ("old mill", "1"), (None, "2"), ("x", None)], "query string, doc_id string")
    sinks.write_clicks(clicks, str(tmp_path / "c"))
    sinks.write_clicks(clicks, str(tmp_path / "c"))
    g, q = feedback.click_counts(sinks.read_clicks(spark, str(tmp_path / "c")), "query", "doc_id")
    assert {r.doc_id: r.clicks for r in g.collect()} == {"1": 4, "2": 2} and q.filter("query = 'old mill'").first().clicks == 4
    sinks.write_pending(spark.createDataFrame([("http://a",), ("http://b",)], "url string"), str(tmp_path / "p"))
    pages = spark.createDataFrame([("http://a", "text"), ("http://b", " ")], "url string, text string")
    assert [tuple(r) for r in sinks.sync_pending(spark, str(tmp_path / "p"), pages).collect()] == [("http://a", "text")]
    assert sinks.sync_pending(spark, str(tmp_path / "p"), pages).count() == 0 and sinks.sync_pending(spark, str(tmp_path / "none"), pages).count() == 0
