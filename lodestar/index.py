"""The index on disk: versioned Parquet tables behind a manifest, with adds, deletes and compaction.

A version is a list of layers.  Adding documents writes a new layer (passages, postings, dictionary,
vectors); deleting writes tombstones; compaction folds the live passages into one layer and keeps their
ids.  ``manifest-N.json`` names the layers of version N and is published as the last step, so readers see a
whole version or the one before.  A batch id makes adds idempotent.

Tombstones and layers are numbered together: a tombstone hides its passages in the layers before it, so a
document can be deleted and added again.  A passage that is added again replaces its deleted row at once.

The dictionary (term, df) and the corpus figures are written with each layer, so that a search sums them up
for its own terms and reads no other postings: they are sorted by term, and the terms are pushed to the scan.
Vectors are sorted by their list of an inverted file whose centres are trained with the first layer, and the
lists probed are pushed down likewise.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.operators import bm25, chunking, vectors
from lodestar.runtime import delete_path, latest_version, publish_version

TABLES = ("chunks", "postings", "terms", "vectors", "replaced")
_SCHEMA = {
    "chunks": "chunk_id string, doc_id string, chunk_no int, text string, clean string, lang string, tokens array<string>",
    "postings": "term string, chunk_id string, len int, tf int",
    "terms": "term string, first string, bytes int, df bigint",
    "vectors": "cid int, chunk_id string, q array<tinyint>, scale double",
    "replaced": "chunk_id string",
    "deleted": "chunk_id string",
}
_EMPTY = {"version": 0, "layers": [], "tombstones": [], "replaced": [], "batches": [], "next": 1, "figures": {}, "centres": None}


class Index:
    def __init__(self, spark: SparkSession, path: str, cfg: Config = Config()):
        self.spark, self.path, self.cfg = spark, path.rstrip("/"), cfg
        text = latest_version(spark, self.path)
        self.state = {**_EMPTY, "chunking": self._chunking(), **(json.loads(text) if text else {})}
        if self.state["layers"] and self.state["chunking"] != self._chunking():
            raise ValueError(f"the index was chunked with {self.state['chunking']}, asked for {self._chunking()}; rebuild it")

    def _chunking(self) -> list[int]:
        c = self.cfg.chunking
        return [c.min_words, c.max_words, c.target_words]

    @property
    def version(self) -> int:
        return self.state["version"]

    # -- tables --------------------------------------------------------------------------------
    def _layers(self, table: str, layers: list[int]) -> DataFrame:
        """Rows of some layers, with the column ``layer``."""
        paths = [f"{self.path}/{table}/layer={k}" for k in layers]
        schema = _SCHEMA[table] + ", layer int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _before(self, table: str, layers: list[int]) -> DataFrame:
        """(chunk_id, before): passages named by a table, and the layer up to which it holds."""
        return self._layers(table, layers).groupBy("chunk_id").agg(F.max("layer").alias("before"))

    def _read(self, table: str) -> DataFrame:
        """Rows of a table without those that a later layer has replaced."""
        rows = self._layers(table, self.state["layers"])
        if self.state["replaced"]:
            r = self._before("replaced", self.state["replaced"])
            rows = rows.join(r, (rows.chunk_id == r.chunk_id) & (rows.layer < r.before), "left_anti")
        return rows

    def chunks(self) -> DataFrame:
        """All passages, deleted ones included: those count in the statistics until compaction."""
        return self._read("chunks").drop("layer")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self._read("postings").drop("layer")
        return rows if terms is None else rows.filter(F.col("term").isin(terms))

    def vectors(self, lists: list[int] | None = None) -> DataFrame:
        rows = self._read("vectors").drop("layer")
        return rows if lists is None else rows.filter(F.col("cid").isin(lists))

    def centres(self) -> np.ndarray | None:
        return np.array(self.state["centres"]) if self.state["centres"] else None

    def deleted(self) -> DataFrame:
        """(chunk_id) of hidden passages: deleted, and not added again since."""
        if not self.state["tombstones"]:
            return self.spark.createDataFrame([], _SCHEMA["deleted"])
        t = self._before("deleted", self.state["tombstones"])
        if not self.state["replaced"]:
            return t.select("chunk_id")
        again = self._before("replaced", self.state["replaced"]).withColumnRenamed("before", "again")
        return t.join(again, "chunk_id", "left").filter("again is null or again < before").select("chunk_id")

    def live(self) -> DataFrame:
        return self.chunks().join(self.deleted(), "chunk_id", "left_anti")

    def terms(self) -> DataFrame:
        """(term, first, bytes, df) of all layers, one row a layer."""
        return self._layers("terms", self.state["layers"]).drop("layer")

    def term_stats(self, terms: list[str] | None = None) -> DataFrame:
        rows = self.terms() if terms is None else self.terms().filter(F.col("term").isin(terms))
        return rows.groupBy("term").agg(F.sum("df").alias("df"))

    def corpus_stats(self) -> DataFrame:
        """One row from the manifest: no table is read."""
        n, total = (sum(self.state["figures"][str(k)][i] for k in self.state["layers"]) for i in (0, 1))
        return self.spark.createDataFrame([(n, total, total / n if n else 0.0)], "n bigint, total_len bigint, avg_len double")

    def health(self) -> DataFrame:
        return self.chunks().agg(
            F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("text_bytes"),
            F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens"),
        ).crossJoin(self.deleted().agg(F.count(F.lit(1)).alias("deleted"))).withColumn("ok", F.col("chunks") > 0)  # one row each

    def memory(self) -> DataFrame:
        """(part, bytes): what the index would take if it were held in memory, by part: texts, clean texts, tokens, positions (eight bytes each) and vectors."""
        octets = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("bigint")
        c = self.chunks().agg(octets("text").alias("text"), octets("clean").alias("clean"), F.coalesce(F.sum(F.octet_length(F.array_join("tokens", ""))), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.sum(F.size("tokens") * 8), F.lit(0)).cast("bigint").alias("positions"))
        v = self.vectors().agg(F.coalesce(F.sum(F.size("q") + 4), F.lit(0)).cast("bigint").alias("vectors"))
        return c.crossJoin(v).selectExpr("stack(5, 'text', text, 'clean', clean, 'tokens', tokens, 'positions', positions, 'vectors', vectors) as (part, bytes)")  # one row each

    # -- changes -------------------------------------------------------------------------------
    def _publish(self, **change) -> None:
        state = {**self.state, **change, "version": self.state["version"] + 1}
        publish_version(self.spark, self.path, state["version"], json.dumps(state))
        self.state = state

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> int:
        """Adds documents; passages whose id is live, or a batch already applied, are skipped.  Returns how many passages are new."""
        if batch is not None and batch in self.state["batches"]:
            return 0
        return self._add(docs, doc_id, text, batch, None)

    def update(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None, gone: DataFrame | None = None, replace: bool = True) -> int:
        """Deletes the documents of ``gone`` (id) and adds others, in one version; with ``replace`` those added are deleted first."""
        if batch is not None and batch in self.state["batches"]:
            return 0
        ids = docs.select(F.col(doc_id).cast("string").alias("id")) if replace else docs.limit(0).select(F.lit("").alias("id"))
        return self._add(docs, doc_id, text, batch, ids if gone is None else ids.unionByName(gone.select(F.col("id").cast("string").alias("id"))))

    def _add(self, docs: DataFrame, doc_id: str, text: str, batch: str | None, gone: DataFrame | None) -> int:
        """One new layer; ``gone`` (id) are documents or passages deleted just before it, in the same version."""
        k, change = self.state["next"], {}
        before = self.state
        if gone is not None:
            self._bury(gone, k)
            change["tombstones"] = self.state["tombstones"] + [k]
            k += 1
        new = chunking.build(chunking.chunk(docs.dropDuplicates([doc_id]), self.cfg.chunking, doc_id, text))
        new = new.select("chunk_id", "doc_id", "chunk_no", "text", "clean", "lang", "tokens")
        if self.state["layers"]:
            self.state = {**before, **change}  # what is live once the documents are gone
            try:
                new = new.join(self.live().select("chunk_id"), "chunk_id", "left_anti")
            finally:
                self.state = before
        layer = f"{self.path}/chunks/layer={k}"
        new.write.mode("overwrite").parquet(layer)
        new = self.spark.read.schema(_SCHEMA["chunks"]).parquet(layer)
        figures = bm25.corpus_stats(new).first()
        again = False
        if self.state["layers"]:
            new.select("chunk_id").join(self._layers("chunks", self.state["layers"]).select("chunk_id"), "chunk_id", "left_semi").write.mode("overwrite").parquet(f"{self.path}/replaced/layer={k}")
            again = not self._layers("replaced", [k]).isEmpty()
        change |= self._write_derived(new, k)
        change |= {"layers": self.state["layers"] + [k], "replaced": self.state["replaced"] + [k] * again, "next": k + 1, "batches": self.state["batches"] + ([batch] if batch is not None else [])}
        self._publish(**change, figures={**self.state["figures"], str(k): [figures.n, figures.total_len]})
        return figures.n

    def _write_derived(self, chunks: DataFrame, k: int) -> dict:
        post = bm25.postings(chunks)
        # sorted by term, so that a look-up reads the row groups it needs
        post.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").select("term", "chunk_id", "len", "tf").write.mode("overwrite").parquet(f"{self.path}/postings/layer={k}")
        stored = self.spark.read.schema(_SCHEMA["postings"]).parquet(f"{self.path}/postings/layer={k}")
        terms = bm25.term_stats(stored).select("term", F.substring("term", 1, 1).alias("first"), F.octet_length("term").alias("bytes"), "df")
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/terms/layer={k}")
        target, centres = f"{self.path}/vectors/layer={k}", self.state["centres"]
        if not self.cfg.vector_enabled:
            self.spark.createDataFrame([], _SCHEMA["vectors"]).write.mode("overwrite").parquet(target)
            return {}
        v = vectors.embed(chunks, "chunk_id", "text", self.cfg)
        if centres is None:
            v.write.mode("overwrite").parquet(f"{target}.raw")
            v = self.spark.read.schema(v.schema).parquet(f"{target}.raw")
            trained = vectors.train_lists(v, "chunk_id", "v", self.cfg)
            centres = trained.tolist() if len(trained) else None
        v = vectors.ivf_assign(v, np.array(centres), "chunk_id") if centres else v.withColumn("cid", F.lit(0))
        z = v.select("cid", "chunk_id", vectors.quantize("v").alias("z")).select("cid", "chunk_id", "z.q", "z.scale")
        z.repartitionByRange("cid", "chunk_id").sortWithinPartitions("cid", "chunk_id").write.mode("overwrite").parquet(target)
        delete_path(self.spark, f"{target}.raw")
        return {"centres": centres}

    def _bury(self, ids: DataFrame, k: int, column: str = "id") -> int:
        ids = ids.select(F.col(column).cast("string").alias("id")).distinct()
        c = self.live().select("chunk_id", "doc_id")
        hit = c.join(ids, c.chunk_id == ids.id, "left_semi").unionByName(c.join(ids, c.doc_id == ids.id, "left_semi")).select("chunk_id").distinct()
        hit.write.mode("overwrite").parquet(f"{self.path}/deleted/layer={k}")
        return self.spark.read.parquet(f"{self.path}/deleted/layer={k}").count()

    def adopt(self, n: int, total_len: int, batch: str) -> None:
        """Publishes layer 1, whose tables another job has written, as the first version."""
        if self.state["layers"]:
            return
        self._publish(layers=[1], next=2, batches=[batch], figures={"1": [n, total_len]})

    def delete(self, ids: DataFrame, column: str = "id") -> int:
        """Tombstones for passage ids or document ids."""
        k = self.state["next"]
        n = self._bury(ids, k, column)
        self._publish(tombstones=self.state["tombstones"] + [k], next=k + 1)
        return n

    def compact(self) -> None:
        """One layer of the live passages; ids stay as they are."""
        old, k = dict(self.state), self.state["next"]
        layer = f"{self.path}/chunks/layer={k}"
        self.live().select(*[f.name for f in self.spark.createDataFrame([], _SCHEMA["chunks"]).schema]).write.mode("overwrite").parquet(layer)
        kept = self.spark.read.schema(_SCHEMA["chunks"]).parquet(layer)
        figures = bm25.corpus_stats(kept).first()
        self.state = {**self.state, "centres": None}
        derived = self._write_derived(kept, k)
        self._publish(layers=[k], tombstones=[], replaced=[], next=k + 1, figures={str(k): [figures.n, figures.total_len]}, **derived)
        for t in TABLES:
            for x in old["layers"]:
                delete_path(self.spark, f"{self.path}/{t}/layer={x}")
        for x in old["tombstones"]:
            delete_path(self.spark, f"{self.path}/deleted/layer={x}")

    def validate(self, smoke: str | None = None) -> list[str]:
        """Problems found; an empty list means the index is sound."""
        out = []
        if not self.state["layers"]:
            return ["no layers"]
        n = self.chunks().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("d")).first()
        if not n.n:
            out.append("no passages")
        if n.n != n.d:
            out.append("repeated passage ids")
        if self.postings().join(self.chunks(), "chunk_id", "left_anti").limit(1).count():
            out.append("postings without passage")
        if smoke:
            from lodestar.engine import Engine

            if Engine(self).search(smoke)["results"] == []:
                out.append(f"no result for {smoke!r}")
        return out
