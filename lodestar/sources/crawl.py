"""Breadth-first crawl over a table of fetched pages: frontier, seen set and robots rules as joins."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import normalize_url, url_host, url_path
from lodestar.runtime import materialize


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, rule) from (host, body): every Disallow prefix, whatever agent it is meant for."""
    lines = robots.select("host", F.explode(F.split("body", r"\r?\n")).alias("line"))
    rule = F.trim(F.regexp_replace(F.regexp_extract("line", r"(?i)^\s*disallow\s*:\s*([^#]*)", 1), r"\s+$", ""))
    return lines.select(F.lower("host").alias("host"), rule.alias("rule")).filter("rule <> ''").distinct()


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    u = urls.withColumn("_h", url_host(url)).withColumn("_p", url_path(url))
    return u.join(rules, (F.col("_h") == rules.host) & F.col("_p").startswith(rules.rule), "left_anti").drop("_h", "_p")


def resolved(pages: DataFrame) -> DataFrame:
    """(url) of every link of (url, links), taken against its page, without fragments; only http and https."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for base, links in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in links or ():
                    try:
                        out.add(urljoin(base, x or "").split("#")[0])
                    except ValueError:
                        continue
            yield pa.RecordBatch.from_arrays([pa.array(sorted(u for u in out if u.lower().startswith(("http://", "https://"))), pa.string())], names=["url"])

    return pages.select("url", "links").mapInArrow(run, "url string")


def crawl(snapshot: DataFrame, seeds: DataFrame, rules: DataFrame | None = None, max_depth: int = 3, limit: int | None = None) -> DataFrame:
    """(url, title, text, links, depth): pages reachable from the seeds, nearest first; with ``limit`` at most so many.

    Each level joins the frontier with the snapshot and removes what has been seen; its result is
    written before the next level, so that plans and lineages stay short.
    """
    pages = snapshot.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_u", normalize_url("url")).dropDuplicates(["_u"])
    seen = materialize(seeds.select(normalize_url("url").alias("url")).distinct(), "seen")
    frontier, out = seen, None
    for depth in range(max_depth + 1):
        ok = frontier if rules is None else allowed(frontier, rules)
        level = pages.join(ok.withColumnRenamed("url", "_u"), "_u").select("url", "title", "text", "links", F.lit(depth).alias("depth"))
        level = materialize(level, "level")
        out = level if out is None else out.unionByName(level)
        if depth == max_depth:
            break
        found = resolved(level).distinct()
        frontier = materialize(found.join(seen, "url", "left_anti"), "frontier")
        if frontier.isEmpty() or limit is not None and out.count() >= limit:
            break
        seen = seen.unionByName(frontier)
    return out if limit is None else out.orderBy("depth", "url").limit(limit)
