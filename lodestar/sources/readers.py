"""Readers for plain text, JSON in its many shapes, dumps and archives.  Every reader yields (id, text) or more."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestar.functions.text import clean_ws, is_namespace_title, is_redirect, sentences, slugify
from lodestar.functions.text import poly31

#: Bytes of records a task gathers before it hands them on.
_FLUSH = 8 << 20
DOCUMENT = StructType([StructField("id", StringType()), StructField("text", StringType())])


def _file_name() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


# -- text and JSON -----------------------------------------------------------------------------
def text_file(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one document named after it."""
    return spark.read.text(path, wholetext=True).select(F.url_decode(_file_name()).alias("id"), F.col("value").alias("text"))


def text_dir(spark: SparkSession, path: str) -> DataFrame:
    """The .txt files of a folder, not of its sub-folders; unreadable ones are skipped."""
    df = spark.read.option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    return df.select(F.url_decode(_file_name()).alias("id"), F.col("value").alias("text"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """An array of documents; an unreadable file yields nothing."""
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path, multiLine=True).filter("id is not null or text is not null")


def json_lines(spark: SparkSession, path: str, schema: StructType = DOCUMENT) -> DataFrame:
    """Typed lines; bad ones are dropped; a missing file is an empty table."""
    from lodestar.runtime import path_exists

    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_auto(spark: SparkSession, path: str) -> DataFrame:
    """An array if the first character that is not blank is "[", else lines."""
    head = spark.read.text(path).filter(F.trim("value") != "").select(F.ltrim(F.regexp_replace("value", "^﻿", "")).alias("v")).limit(1).collect()
    return json_array(spark, path) if head and head[0].v.startswith("[") else json_lines(spark, path)


def _fields(v: Column) -> tuple[Column, Column, Column]:
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    meta = F.coalesce(F.try_variant_get(v, "$.meta", "map<string,string>"), F.try_variant_get(v, "$.metadata", "map<string,string>"))
    return get("id"), F.coalesce(get("text"), get("content"), get("body")), meta


def json_any(spark: SparkSession, path: str, reader=None) -> DataFrame:
    """(id, text, meta) from an array of objects, one object, or an object of documents by id.

    Text is text, content or body; meta is meta or metadata; a document without id gets the file's
    name and its place; documents without text are dropped.
    """
    raw = (reader or spark.read).text(path, wholetext=True).select(_file_name().alias("file"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v")).filter("v is not null")
    kind = F.substring(F.schema_of_variant("v"), 1, 5)
    one_id, one_text, one_meta = _fields(F.col("v"))
    single = raw.filter((kind == "OBJEC") & one_text.isNotNull()).select("file", F.lit(0).alias("pos"), one_id.alias("id"), one_text.alias("text"), one_meta.alias("meta"))
    many = raw.filter(~((kind == "OBJEC") & one_text.isNotNull()))
    ex = many.alias("m").lateralJoin(spark.tvf.variant_explode(F.col("m.v").outer()).alias("e")).select("file", "e.pos", "e.key", "e.value")
    i, t, m = _fields(F.col("value"))
    rest = ex.select("file", "pos", F.coalesce(i, "key").alias("id"), F.coalesce(t, F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))).alias("text"), m.alias("meta"))
    out = single.unionByName(rest).filter("text is not null and trim(text) <> ''")
    return out.select(F.coalesce("id", F.concat_ws("-", "file", "pos")).alias("id"), "text", "meta")


def json_lines_any(spark: SparkSession, path: str, source: str = "doc", reader=None) -> DataFrame:
    """Lines with the same lenient fields; bad lines are dropped; ids count kept rows only, per file in line order."""
    from pyspark.sql.window import Window

    raw = (reader or spark.read).text(path).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("o"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v")).filter("v is not null")
    i, t, m = _fields(F.col("v"))
    kept = raw.select("f", "o", i.alias("id"), t.alias("text"), m.alias("meta")).filter("text is not null and trim(text) <> ''")
    n = F.row_number().over(Window.partitionBy("f").orderBy("o")) - 1
    return kept.select(F.coalesce("id", F.concat(F.lit(source + "-"), n.cast("string"))).alias("id"), "text", "meta")


def _files(spark: SparkSession, path: str, suffix: str):
    return spark.read.option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true")


def _named_texts(df: DataFrame) -> DataFrame:
    name = F.url_decode(_file_name())
    return df.select(name.alias("id"), F.col("value").alias("text"), F.create_map(F.lit("source"), name).alias("meta"))


def raw_dir(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, text, meta) of the .txt and .json files of a folder and its sub-folders; with ``lines`` of .jsonl files too.  Other files are passed over."""
    from lodestar.runtime import list_suffixes

    there = list_suffixes(spark, path)
    parts = []
    if "txt" in there:
        parts.append(_named_texts(_files(spark, path, "txt").text(path, wholetext=True)))
    if "json" in there:
        parts.append(json_any(spark, path, _files(spark, path, "json")))
    if lines and "jsonl" in there:
        parts.append(json_lines_any(spark, path, reader=_files(spark, path, "jsonl")))
    if not parts:
        return spark.createDataFrame([], "id string, text string, meta map<string,string>")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def from_path(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, meta) by suffix; of a folder all files of known kinds."""
    from lodestar.runtime import is_folder

    low = path.lower()
    if is_folder(spark, path):
        return raw_dir(spark, path, lines=True)
    if low.endswith(".txt"):
        return _named_texts(spark.read.text(path, wholetext=True))
    if low.endswith(".jsonl"):
        return json_lines_any(spark, path)
    if low.endswith(".json"):
        return json_any(spark, path)
    raise ValueError(f"unknown kind of file: {path}")


def wiki_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of wiki extracts: id as given, else slug of the title, else a hash of the text."""
    df = spark.read.schema("id string, title string, text string, content string").option("mode", "DROPMALFORMED").json(path)
    body = F.coalesce("text", "content")
    slug = slugify("title")
    ident = F.coalesce("id", F.when(slug != "", slug), F.lower(F.hex(poly31(body))))
    return df.filter(body.isNotNull()).select(ident.alias("id"), body.alias("text"), F.create_map(F.lit("title"), F.col("title")).alias("meta"))


# -- wiki dumps --------------------------------------------------------------------------------
def _balanced(text: str, opening: str, closing: str) -> str:
    """Drop everything between matching marks, nested ones included."""
    out, depth, i = [], 0, 0
    while i < len(text):
        if text.startswith(opening, i):
            depth += 1
            i += len(opening)
        elif depth and text.startswith(closing, i):
            depth -= 1
            i += len(closing)
        else:
            if not depth:
                out.append(text[i])
            i += 1
    return "".join(out)


def wiki_plain(text: str) -> str:
    """Templates, tags and media links dropped, links replaced by their label, white space collapsed."""
    s = _balanced(text, "{{", "}}")
    out, i = [], 0
    while i < len(s):
        if s.startswith("[[", i):
            end = s.find("]]", i + 2)
            if end < 0:
                out.append(s[i])
                i += 1
                continue
            inner = s[i + 2 : end]
            if not inner.startswith(("File:", "Image:", "Category:")):
                out.append(inner.rsplit("|", 1)[-1])
            i = end + 2
        elif s[i] == "<":
            end = s.find(">", i)
            i = end + 1 if end >= 0 else len(s)
        else:
            out.append(s[i])
            i += 1
    return " ".join("".join(out).split())


def clean_wiki(df: DataFrame, key: str, text: str, out: str = "clean") -> DataFrame:
    src = df.select(key, text)
    kt = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if (t := x.as_py()) is None else wiki_plain(t) for x in b.column(1)], pa.string())], names=[key, out])

    return src.mapInArrow(run, f"`{key}` {kt}, `{out}` string")



def cut_bytes(text: Column, n: int) -> Column:
    """The first n bytes in UTF-8, without a character that is cut in two."""
    cut = F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


def wiki_xml(spark: SparkSession, path: str, limit: int | None = None, core: bool = False, n_sentences: int = 2, max_chars: int = 900) -> DataFrame:
    """(id, text) of the pages of a dump, compressed or not: id ``wiki:<page>``, text title and clean body.

    With ``core`` namespace pages, pages without id and redirects are left out, and the body is its
    first sentences, cut at ``max_chars`` bytes of UTF-8 (a character cut in two is dropped), with quote marks of emphasis removed.
    """
    raw = spark.read.format("xml").option("rowTag", "page").schema("title string, id string, revision struct<text string>").load(path)
    pages = raw.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("id", F.lit("")).alias("pid"), F.coalesce("revision.text", F.lit("")).alias("body"))
    if core:
        pages = pages.filter(~is_namespace_title("title") & (F.col("pid") != "") & ~is_redirect("body"))
    clean = clean_wiki(pages.withColumn("k", F.struct("title", "pid")), "k", "body")
    text = F.col("clean")
    if core:
        text = F.regexp_replace(text, "'{2,3}", "")
        text = cut_bytes(F.array_join(F.slice(sentences(text), 1, n_sentences), " "), max_chars)
    out = clean.select(F.concat(F.lit("wiki:"), "k.pid").alias("id"), F.concat_ws("\n", "k.title", text).alias("text")).filter(F.trim("text") != "")
    return out if limit is None else out.limit(limit)


# -- HTML --------------------------------------------------------------------------------------
class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.body, self.all, self.links = [], [], [], []
        self._in_title = self._in_body = self._seen_body = False

    def handle_starttag(self, tag, attrs):
        if tag == "title" and not self.title:
            self._in_title = True
        elif tag == "body":
            self._in_body = self._seen_body = True
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag == "title":
            self._in_title = False
        elif tag == "body":
            self._in_body = False

    def handle_data(self, data):
        (self.title if self._in_title else self.all).append(data)
        if self._in_body:
            self.body.append(data)


def parse_page(html: str, base: str) -> tuple[str, str, list[str]]:
    """(title, text, links): text of the body, or of everything if there is none; links resolved, fragments dropped."""
    p = _Page()
    p.feed(html)
    p.close()
    join = lambda xs: " ".join(" ".join(xs).split())
    links = []
    for h in p.links:
        try:
            u = urljoin(base, h).split("#")[0]
        except ValueError:
            continue
        if u.startswith(("http://", "https://")):
            links.append(u)
    return join(p.title), join(p.body if p._seen_body else p.all), links


def parse_html(df: DataFrame, url: str, html: str) -> DataFrame:
    """(url, title, text, links)."""
    src = df.select(F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_page(h or "", u or "") for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["url", "title", "text", "links"])

    return src.mapInArrow(run, "url string, title string, text string, links array<string>")


def html_documents(df: DataFrame, url: str, html: str) -> DataFrame:
    """(id, text): ``web:`` and the URL's md5; title and text; empty pages dropped."""
    p = parse_html(df, url, html)
    text = clean_ws(F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), F.when(F.col("text") != "", F.col("text"))))
    return p.select(F.concat(F.lit("web:"), F.md5("url")).alias("id"), text.alias("text")).filter("text <> ''")


# -- WARC --------------------------------------------------------------------------------------
def _opened(uri: str):
    """A stream over a file of any file system the cluster's Arrow knows; unpacked if it is gzip, one member after another."""
    import pyarrow.fs

    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    f = io.BufferedReader(fs.open_input_stream(path, compression=None), 1 << 20)
    return gzip.GzipFile(fileobj=f) if f.peek(2)[:2] == b"\x1f\x8b" else f


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files: their content is not read here, tasks open them as streams."""
    return spark.read.format("binaryFile").load(path).select("path")


def warc_records(data) -> Iterator[tuple[str, str, bytes]]:
    """(type, target URI, payload) of every record of an archive, given as bytes or as a stream; one record is held at a time."""
    if isinstance(data, bytes):
        data = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    f = data
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (h := f.readline()).strip():
            k, _, v = h.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        yield head.get("warc-type", ""), head.get("warc-target-uri", ""), f.read(int(head.get("content-length") or 0))


def split_http(payload: bytes) -> bytes:
    for sep in (b"\r\n\r\n", b"\n\n"):
        if sep in payload:
            return payload.split(sep, 1)[1]
    return payload


def warc(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Documents of the response records of archives.  A task streams its files and hands on a few records at a time, so the size of an archive does not matter."""
    files = _paths(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda r: pa.RecordBatch.from_arrays([pa.array([x[0] for x in r], pa.string()), pa.array([x[1] for x in r], pa.string())], names=["url", "html"])
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, size = [], 0
                with _opened(uri) as f:
                    for kind, target, payload in warc_records(f):
                        if kind == "response":
                            rows.append((target or "unknown", split_http(payload).decode("utf-8", "replace")))
                            size += len(payload)
                            if size > _FLUSH:
                                yield out(rows)
                                rows, size = [], 0
                yield out(rows)

    out = html_documents(files.mapInArrow(run, "url string, html string"), "url", "html")
    return out if limit is None else out.limit(limit)


# -- OSM ---------------------------------------------------------------------------------------
def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        x = b[i]
        i += 1
        v |= (x & 127) << shift
        if x < 128:
            return v, i
        shift += 7


def _message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            v, i = _varint(b, i)
        elif wire == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif wire == 5:
            v, i = b[i : i + 4], i + 4
        else:
            v, i = b[i : i + 8], i + 8
        yield key >> 3, v


def _packed(b: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        v, i = _varint(b, i)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def osm_elements(data) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(kind, id, tags) of the nodes and ways in a PBF file, given as bytes or as a stream; other elements are passed over.  One block is held at a time."""
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    while len(size := f.read(4)) == 4:
        head = dict(_message(f.read(struct.unpack(">I", size)[0])))
        blob = dict(_message(f.read(head[3])))
        if head[1] != b"OSMData":
            continue
        block = list(_message(blob[1] if 1 in blob else zlib.decompress(blob[3])))
        strings = [v.decode("utf-8", "replace") for n, s in block if n == 1 for k, v in _message(s) if k == 1]
        for n, group in block:
            if n != 2:
                continue
            for kind, e in _message(group):
                if kind in (1, 3):
                    m = dict(_message(e))
                    ident = m.get(1, 0)
                    ident = (ident >> 1) ^ -(ident & 1) if kind == 1 else ident
                    tags = {strings[k]: strings[v] for k, v in zip(_packed(m.get(2, b"")), _packed(m.get(3, b"")))}
                    yield ("node" if kind == 1 else "way"), ident, tags
                elif kind == 2:
                    m = dict(_message(e))
                    kv, at, last = _packed(m.get(10, b"")), 0, 0
                    for delta in _packed(m.get(1, b""), signed=True):
                        last += delta
                        tags = {}
                        while at < len(kv) and kv[at]:
                            tags[strings[kv[at]]] = strings[kv[at + 1]]
                            at += 2
                        at += 1
                        yield "node", last, tags


def osm_text(tags: dict[str, str]) -> str | None:
    """Name and address, amenity, place and shop tags; None without a name."""
    if "name" not in tags:
        return None
    return " ".join([tags["name"], *(f"{k}={v}" for k, v in tags.items() if k.startswith("addr:") or k in ("amenity", "place", "shop"))])


def osm_pbf(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Named nodes and ways as documents.  A task streams its files block by block."""
    files = _paths(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda r: pa.RecordBatch.from_arrays([pa.array([x[0] for x in r], pa.string()), pa.array([x[1] for x in r], pa.string())], names=["id", "text"])
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows = []
                with _opened(uri) as f:
                    for kind, i, tags in osm_elements(f):
                        if (t := osm_text(tags)) is not None:
                            rows.append((f"osm:{kind}:{i}", t))
                            if len(rows) >= 10_000:
                                yield out(rows)
                                rows = []
                yield out(rows)

    out = files.mapInArrow(run, "id string, text string")
    return out if limit is None else out.limit(limit)
