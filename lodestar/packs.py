"""Sharded indexes with a manifest, and their export."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.engine import Engine
from lodestar.functions import text as T
from lodestar.index import Index
from lodestar.operators import chunking, shards, vectors
from lodestar.runtime import list_names, materialize, move, read_small_text, scratch_path, write_small_text

EMPTY = {"version": 1, "download_base": "", "languages": []}


def load_manifest(spark: SparkSession, root: str) -> dict:
    """The manifest, or an empty one if it is absent or unreadable."""
    try:
        return json.loads(read_small_text(spark, f"{root}/manifest.json") or "null") or dict(EMPTY)
    except ValueError:
        return dict(EMPTY)


def manifest_rows(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(x["code"], i, s["name"], s["path"], s["docs"], s["bytes"]) for x in manifest["languages"] for i, s in enumerate(x["shards"])]
    return spark.createDataFrame(rows, "code string, pos int, name string, path string, docs bigint, bytes bigint")


def pack(spark: SparkSession, docs: DataFrame, root: str, lang: str = "en", per_shard: int | None = None, cfg: Config = Config(), base: str = "") -> dict:
    """One index per run of ``per_shard`` documents, listed in the manifest under the language."""
    per_shard = per_shard or cfg.shard_docs
    placed = materialize(shards.assign(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("o")), "o", per_shard).drop("o"), "pack")
    sizes = {r.shard: (r.n, r.b) for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}  # one row a shard
    build_indexes(spark, placed, f"{root}/{lang}", cfg)
    entries = [{"name": name, "path": f"{lang}/{name}", "docs": sizes[name][0], "bytes": sizes[name][1] or 0} for name in sorted(sizes)]
    m = load_manifest(spark, root)
    profiles = [{"name": "default", "max_bytes": 1_000_000_000}, {"name": "power", "max_bytes": 5_000_000_000}]
    m["languages"] = [x for x in m["languages"] if x["code"] != lang] + [{"code": lang, "profiles": profiles, "shards": entries}]
    m["download_base"] = base or m.get("download_base", "")
    write_small_text(spark, f"{root}/manifest.json", json.dumps(m, indent=2))
    return m


def build_indexes(spark: SparkSession, placed: DataFrame, root: str, cfg: Config) -> None:
    """The indexes of all shards of (shard, doc_id, text): each table is written once for all, then its folders are moved to their shards."""
    names = placed.select("shard", F.col("doc_id").cast("string").alias("d")).dropDuplicates(["d"])
    built = chunking.build(chunking.chunk(placed.dropDuplicates(["doc_id"]), cfg.chunking)).join(names, F.col("doc_id") == F.col("d")).drop("d")
    chunks = materialize(built.select("shard", "chunk_id", "doc_id", "chunk_no", "text", "clean", "lang", "tokens"), "chunks")
    each = chunks.select("shard", "chunk_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    post = materialize(each.groupBy("shard", "term", "chunk_id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf")), "postings")
    terms = post.groupBy("shard", "term").agg(F.count(F.lit(1)).alias("df")).select("shard", "term", F.substring("term", 1, 1).alias("first"), F.octet_length("term").alias("bytes"), "df")
    none = chunks.limit(0).select("shard", F.lit(0).alias("cid"), "chunk_id", F.array().cast("array<tinyint>").alias("q"), F.lit(1.0).alias("scale"))
    vecs = none
    if cfg.vector_enabled:
        z = vectors.embed(chunks.withColumn("k", F.struct("shard", "chunk_id")), "k", "text", cfg).select("k", vectors.quantize("v").alias("z"))
        vecs = z.select("k.shard", F.lit(0).alias("cid"), "k.chunk_id", "z.q", "z.scale")
    order = {"chunks": ["chunk_id"], "postings": ["term", "chunk_id"], "terms": ["term"], "vectors": ["chunk_id"]}
    shard_names = []
    for table, rows in (("chunks", chunks), ("postings", post), ("terms", terms), ("vectors", vecs)):
        target = scratch_path(spark, table)
        rows.repartition("shard").sortWithinPartitions("shard", *order[table]).write.partitionBy("shard").parquet(target)
        found = [n.removeprefix("shard=") for n in list_names(spark, target) if n.startswith("shard=")]
        shard_names = shard_names or found
        for name in found:
            move(spark, f"{target}/shard={name}", f"{root}/{name}/{table}/layer=1")
        for name in set(shard_names) - set(found):  # a shard without rows of this table
            rows.limit(0).drop("shard").write.mode("overwrite").parquet(f"{root}/{name}/{table}/layer=1")
    figures = chunks.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.greatest(F.size("tokens"), F.lit(0))), F.lit(0)).alias("t")).collect()  # one row a shard
    for r in figures:
        Index(spark, f"{root}/{r.shard}", cfg).adopt(r.n, r.t, "pack")


def select_shards(spark: SparkSession, manifest: dict, lang: str, profile: str) -> DataFrame:
    budget = next((p["max_bytes"] for x in manifest["languages"] if x["code"] == lang for p in x["profiles"] if p["name"] == profile), 0)
    return shards.within_budget(manifest_rows(spark, manifest).filter(F.col("code") == lang), budget)


def pack_info(spark: SparkSession, root: str) -> DataFrame:
    return manifest_rows(spark, load_manifest(spark, root)).agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"))


def validate_pack(spark: SparkSession, root: str, smoke: str | None = None, cfg: Config = Config()) -> list[str]:
    out = []
    for k, r in enumerate(manifest_rows(spark, load_manifest(spark, root)).orderBy("code", "pos").collect()):  # one row a shard
        out += [f"{r.path}: {x}" for x in Index(spark, f"{root}/{r.path}", cfg).validate(smoke if k == 0 else None)]
    return out


def export_packs(root: str, out: str, compressed: bool = True) -> list[str]:
    """A zip per shard of a pack on a local disk."""
    os.makedirs(out, exist_ok=True)
    with open(f"{root}/manifest.json", encoding="utf-8") as f:
        m = json.load(f)
    done = []
    for x in m["languages"]:
        for s in x["shards"]:
            target = f"{out}/{x['code']}-{s['name']}.zip"
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as z:
                for folder, _, files in os.walk(f"{root}/{s['path']}"):
                    for name in files:
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, f"{root}/{s['path']}"))
            done.append(target)
    return done


def shard_paths(spark: SparkSession, root: str) -> list[str]:
    return [f"{root}/{n}" for n in list_names(spark, root) if n.startswith("shard_")]


class ShardedEngine:
    """Search over the shards of a pack: a query asks a few of them, from one its words pick onwards, and merges what they find."""

    def __init__(self, spark: SparkSession, root: str, lang: str = "en", cfg: Config = Config(), keep: int = 10):
        names = [s["path"] for x in load_manifest(spark, root)["languages"] if x["code"] == lang for s in x["shards"]]
        self.spark, self.paths, self.cfg, self.keep = spark, [f"{root}/{n}" for n in sorted(names)], cfg, keep
        self._engines: dict[str, Engine] = {}

    def shards_of(self, query: str) -> list[str]:
        """Three shards, two if the query's intent is open, from hash % n onwards, wrapping round."""
        if not self.paths:
            return []
        row = self.spark.range(1).select(T.normalize(F.lit(query)).alias("clean"), T.intent(F.lit(query)).alias("intent")).first()
        seed = 0
        for b in row.clean.encode("utf-8"):
            seed = (seed * 31 + b) % (1 << 64)
        budget = max(1, min(2 if row.intent == "other" else 3, len(self.paths)))
        return [self.paths[(seed + k) % len(self.paths)] for k in range(budget)]

    def search(self, query: str) -> dict:
        """{answer, answers, results}: the best results of the shards asked, a passage once; the three surest answers."""
        results, answers, best = [], [], None
        for path in self.shards_of(query):
            if path not in self._engines:
                self._engines[path] = Engine(Index(self.spark, path, self.cfg))
            out = self._engines[path].search(query)
            results += out["results"]
            if out["answer"]:
                answers.append(out["answer"])
                best = out["answer"] if best is None or out["answer"]["confidence"] > best["confidence"] else best
            answers += out["answers"]
        seen: dict = {}
        for r in sorted(results, key=lambda r: (-r["score"], r["id"])):
            seen.setdefault(r["id"], r)
        top = list(seen.values())[: self.keep]
        answers = sorted(answers, key=lambda a: -a["confidence"])[:3]
        if best is None and top:
            best = {"text": top[0]["text"], "confidence": 0.35, "source": top[0]["id"]}
        return {"answer": best, "answers": answers, "results": top}
