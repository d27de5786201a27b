"""python -m lodestar.cli COMMAND: the engine from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from lodestar import packs
from lodestar.engine import Engine
from lodestar.index import Index
from lodestar.operators import evaluation
from lodestar.runtime import build_session
from lodestar.sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar")
    s = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options) -> None:
        c = s.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)

    add("build-index", "input", "index")
    add("load-index", "index")
    add("search-index", "index", "query")
    add("rank-debug", "index", "query")
    add("merge-index", "index", "input")
    add("update", "index", "input")
    add("crawl", "snapshot", "seeds", "output", depth=3)
    add("search-packs", "root", "query", lang="en")
    add("delete", "index", "ids")
    add("compact", "index")
    add("process", "input", "output")
    add("pack", "input", "output", lang="en", max_docs=50_000, base="")
    add("pack-info", "root")
    add("validate-pack", "root", smoke=None)
    add("export-packs", "root", "output")
    add("eval", "input", "queries")
    for name in ("import-wiki", "import-wiki-core", "import-osm", "import-warc"):
        add(name, "input", "output", limit=0)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session("lodestar-cli")
    docs = lambda p: readers.from_path(spark, p).select(F.col("id").alias("doc_id"), "text")
    if a.command == "build-index":
        print(Index(spark, a.index).add(docs(a.input)))
    elif a.command == "load-index":
        print(Index(spark, a.index).health().toJSON().first())
    elif a.command == "search-index":
        print(json.dumps(Engine(Index(spark, a.index)).search(a.query), ensure_ascii=False, indent=2))
    elif a.command == "rank-debug":
        print(json.dumps(Engine(Index(spark, a.index)).debug(a.query), ensure_ascii=False, indent=2))
    elif a.command == "update":
        print(Index(spark, a.index).update(docs(a.input)))
    elif a.command == "crawl":
        from lodestar.sources.crawl import crawl

        pages = spark.read.parquet(a.snapshot)
        crawl(pages, spark.read.text(a.seeds).withColumnRenamed("value", "url"), max_depth=a.depth).write.mode("overwrite").json(a.output)
    elif a.command == "search-packs":
        print(json.dumps(packs.ShardedEngine(spark, a.root, a.lang).search(a.query), ensure_ascii=False, indent=2))
    elif a.command == "merge-index":
        print(Index(spark, a.index).add(docs(a.input)))
    elif a.command == "delete":
        print(Index(spark, a.index).delete(spark.createDataFrame([(x,) for x in a.ids.split(",")], "id string")))
    elif a.command == "compact":
        Index(spark, a.index).compact()
    elif a.command == "process":
        from lodestar.config import Config
        from lodestar.operators import chunking, dedup

        kept = dedup.exact_dedup(docs(a.input), "text", "doc_id")
        near = dedup.near_dedup(dedup.simhash(kept, "doc_id", "text"), "doc_id").select("doc_id")
        out = chunking.build(chunking.chunk(kept.join(near, "doc_id", "left_semi"), Config().page_chunking, merge=False))
        out.select(F.col("chunk_id").alias("id"), "text", "tokens").write.mode("append").json(a.output)
    elif a.command == "pack":
        packs.pack(spark, docs(a.input), a.output, a.lang, a.max_docs, base=a.base)
    elif a.command == "pack-info":
        print(packs.pack_info(spark, a.root).toJSON().first())
    elif a.command == "validate-pack":
        problems = packs.validate_pack(spark, a.root, a.smoke)
        print("\n".join(problems) or "ok")
        return bool(problems)
    elif a.command == "export-packs":
        print("\n".join(packs.export_packs(a.root, a.output)))
    elif a.command == "eval":
        from lodestar.runtime import scratch_path

        ix = Index(spark, scratch_path(spark, "eval"))
        ix.add(docs(a.input))
        q = spark.read.json(a.queries, multiLine=True).select(F.posexplode("queries").alias("query_id", "q")).select("query_id", F.col("q.query").alias("text"), F.col("q.relevant_docs").alias("relevant"), F.col("q.expected_answer").alias("expected"))
        print(evaluation.measured(Engine(ix), q).toJSON().first())
    else:
        read = {"import-wiki": readers.wiki_xml, "import-wiki-core": lambda *x: readers.wiki_xml(*x, core=True), "import-osm": readers.osm_pbf, "import-warc": readers.warc}[a.command]
        read(spark, a.input, a.limit or None).write.mode("overwrite").json(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
