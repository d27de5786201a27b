"""Occurrences and record counts of every distinct term, kept up to date by signed deltas.

State lives in a folder (``path``) and consists of layers, never rewritten in place:

* ``records/layer=k``  one row per record whose version changed in batch k: key, stamp, tie
  breaker, liveness and its own (term, n) list;
* ``counts/layer=k/bucket=b``  the signed change of (occurrences, records) per term that batch k
  caused, hash-partitioned by term;
* ``manifest-N.json``  the committed layers and the number of live records.  A batch becomes visible
  only when its manifest is published, so a lost job leaves the old state intact.

A batch is reduced to one version a key and written first, so that its size is known: a small one is
sent to the stored records, which are then read (columns only) but not shuffled, and what is not among its
keys is dropped before anything else; a large one meets them by a shuffle on the key.  Only the terms of added,
changed or deleted records reach the counts.  ``compact()`` folds the layers into one.

Skew: the newest version of a key is chosen with a rank-limited window (Spark prunes each map task
to one row per key before the shuffle), and hot terms are summed map-side before they are shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.runtime import delete_path, latest_version, materialize, publish_version, scratch_path

BUCKETS = 16
_TERMS = "array<struct<term:string,n:bigint>>"


class TermCountStore:
    """Persistent term statistics.

    Defined results: null and empty strings are no terms; a record with null or empty tokens counts
    as a record without terms; rows with a null key are ignored; of several rows with one key the
    largest (stamp, content hash) is valid, so equal repeats are harmless; a row older than the
    stored version is ignored; an empty batch changes nothing.  Columns beyond those named are not
    read, so clashing names cannot matter.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, max_layers: int = 32):
        """``buckets`` cut the counts by term; more than ``max_layers`` of them are folded into one."""
        self.spark, self.path, self.buckets, self.max_layers = spark, path.rstrip("/"), buckets, max_layers
        text = latest_version(spark, self.path)
        self.state = json.loads(text) if text else {"records": [], "counts": [], "n_records": 0, "seq": 0}

    # -- reading -------------------------------------------------------------------------------
    def n_records(self) -> int:
        return self.state["n_records"]

    def _layers(self, kind: str) -> DataFrame | None:
        layers = self.state[kind]
        if not layers:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/layer={k}" for k in layers])

    def counts(self) -> DataFrame:
        """(term, occurrences, records) over the live versions of all records."""
        df = self._layers("counts")
        if df is None:
            return self.spark.createDataFrame([], "term string, occurrences bigint, records bigint")
        out = df.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return out.filter("records <> 0 or occurrences <> 0")

    def marked(self, rare_at_most: int = 2, common_share: float = 0.1) -> DataFrame:
        """counts() with ``mark``: rare, common or null.  Rare wins in tiny collections where both hold."""
        n = self.n_records()
        return self.counts().withColumn(
            "mark",
            F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > common_share * n, "common"),
        )

    # -- changing ------------------------------------------------------------------------------
    def apply(self, batch: DataFrame, key: str, tokens: str, stamp: str, deleted: Column | None = None) -> dict:
        """Merge a batch of record versions; ``deleted`` marks tombstones.  Returns what changed."""
        spark, seq = self.spark, self.state["seq"] + 1
        rows = batch.select(
            F.col(key).cast("string").alias("key"),
            F.col(stamp).alias("stamp"),
            F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")).alias("toks"),
            (F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)).alias("gone"),
        ).filter("key is not null")
        rows = rows.withColumn("tie", F.xxhash64("toks", "gone"))
        w = Window.partitionBy("key").orderBy(F.col("stamp").desc_nulls_last(), F.col("tie").desc())
        newest = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
        # hash-partitioned by key already: the per-record term counts need no further shuffle
        terms = (
            newest.select("key", "stamp", "tie", "gone", F.explode_outer(F.when(F.col("gone"), F.array().cast("array<string>")).otherwise(F.col("toks"))).alias("term"))
            .groupBy("key", "term")
            .agg(F.count(F.lit(1)).alias("n"), F.first("stamp").alias("stamp"), F.first("tie").alias("tie"), F.first("gone").alias("gone"))
            .groupBy("key")
            .agg(
                F.first("stamp").alias("stamp"),
                F.first("tie").alias("tie"),
                F.first("gone").alias("gone"),
                F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "n"))).cast(_TERMS).alias("terms"),
            )
        )
        if self.state["records"]:
            terms = materialize(terms, "delta")
        stored = self._current_records(terms.select("key"))
        if stored is None:
            changed = terms.select("*", F.lit(None).cast(_TERMS).alias("old_terms"), F.lit(True).alias("old_gone"))
        else:
            old = stored.select("key", F.col("stamp").alias("o_stamp"), F.col("tie").alias("o_tie"), F.col("gone").alias("o_gone"), F.col("terms").alias("old_terms"))
            changed = (
                terms.join(old, "key", "left")
                .filter(
                    F.col("o_tie").isNull()
                    | (
                        (F.col("tie") != F.col("o_tie"))
                        & (
                            F.coalesce(F.col("stamp") > F.col("o_stamp"), F.col("o_stamp").isNull() & F.col("stamp").isNotNull())
                            | (F.col("stamp").eqNullSafe(F.col("o_stamp")) & (F.col("tie") > F.col("o_tie")))
                        )
                    )
                )
                .select("key", "stamp", "tie", "gone", "terms", "old_terms", F.coalesce("o_gone", F.lit(True)).alias("old_gone"))
            )
        layer = f"{self.path}/records/layer={seq}"
        changed.write.mode("overwrite").parquet(layer)
        changed = spark.read.schema(changed.schema).parquet(layer)
        signed = F.concat(
            F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["n"].alias("n"), F.lit(1).cast("bigint").alias("r"))),
            F.transform(F.coalesce("old_terms", F.array().cast(_TERMS)), lambda t: F.struct(t["term"].alias("term"), (-t["n"]).alias("n"), F.lit(-1).cast("bigint").alias("r"))),
        )
        (
            changed.select(F.explode(signed).alias("d"))
            .groupBy(F.col("d.term").alias("term"))
            .agg(F.sum("d.n").alias("occurrences"), F.sum("d.r").alias("records"))
            .filter("occurrences <> 0 or records <> 0")
            .withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{self.path}/counts/layer={seq}")
        )
        n = changed.agg(
            F.count(F.lit(1)).alias("changed"),
            F.coalesce(F.sum(F.col("old_gone").cast("int") - F.col("gone").cast("int")), F.lit(0)).alias("grown"),
            F.max("gone").alias("any_gone"),
        ).first()
        has_counts = n["changed"] > 0
        self.state = {
            "records": self.state["records"] + [seq] * (n["changed"] > 0),
            "counts": self.state["counts"] + [seq] * self._has_rows(f"{self.path}/counts/layer={seq}") if has_counts else self.state["counts"],
            "n_records": self.state["n_records"] + int(n["grown"]),
            "seq": seq,
        }
        publish_version(spark, self.path, seq, json.dumps(self.state))
        if len(self.state["counts"]) > self.max_layers:
            self.compact()
        return {"changed": n["changed"], "n_records": self.state["n_records"]}

    def _has_rows(self, path: str) -> bool:
        from lodestar.runtime import list_names

        return any(x.startswith("bucket=") for x in list_names(self.spark, path))

    def _current_records(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The newest version of every record, or of those named by ``keys``."""
        df = self._layers("records")
        if df is None:
            return None
        if keys is not None:
            df = df.join(keys, "key", "left_semi")
        if len(self.state["records"]) == 1:
            return df
        w = Window.partitionBy("key").orderBy(F.col("layer").desc())
        return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")

    def compact(self) -> None:
        """Fold all layers into one; results do not change."""
        if len(self.state["records"]) <= 1 and len(self.state["counts"]) <= 1:
            return
        seq, old = self.state["seq"] + 1, dict(self.state)
        recs = self._current_records()
        recs = recs.select("key", "stamp", "tie", "gone", "terms", F.lit(None).cast(_TERMS).alias("old_terms"), F.lit(True).alias("old_gone"))
        recs.write.mode("overwrite").parquet(f"{self.path}/records/layer={seq}")
        c = self.counts().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        c.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/layer={seq}")
        has = self._has_rows(f"{self.path}/counts/layer={seq}")
        self.state = {**old, "records": [seq], "counts": [seq] * has, "seq": seq}
        publish_version(self.spark, self.path, seq, json.dumps(self.state))
        for kind in ("records", "counts"):
            for k in old[kind]:
                delete_path(self.spark, f"{self.path}/{kind}/layer={k}")


def build_from_history(spark: SparkSession, rows: DataFrame, key: str, tokens: str, stamp: str, path: str | None = None) -> TermCountStore:
    """Load a whole table in two batches, the older half of its time span first.

    The second batch then consists of additions and changes to stored records, as in production.
    """
    store = TermCountStore(spark, path or scratch_path(spark, "termcounts"))
    lo, hi = rows.agg(F.min(stamp).cast("double"), F.max(stamp).cast("double")).first()
    if lo is None or lo == hi:
        store.apply(rows, key, tokens, stamp)
        return store
    cut = F.timestamp_micros(F.lit(int((lo + hi) / 2 * 1_000_000)))
    store.apply(rows.filter(F.col(stamp) <= cut), key, tokens, stamp)
    store.apply(rows.filter((F.col(stamp) > cut) | F.col(stamp).isNull()), key, tokens, stamp)
    return store


def reconcile(stored: DataFrame, records: DataFrame, key: str, tokens: str, stamp: str, part: str = "shard", term: str = "term", df: str = "df") -> DataFrame:
    """(part, term, stored, true, state): a stored dictionary against the counts of the valid records of each part.

    ``state`` is ok, stale (another count), unset (no count), repeated (several rows, whatever they say), missing (a
    term without a row) or left_over (a row whose term no record holds).  A key belongs to the part of its valid
    row; ``stored`` is the largest of the stored counts; null terms and keys are ignored.
    """
    w = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), F.xxhash64(tokens, part).desc())
    valid = records.select(key, part, stamp, tokens).filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    terms = valid.select(F.col(part).alias("p"), F.explode(F.array_distinct(tokens)).alias("t")).filter("t is not null and t <> ''").groupBy("p", "t").agg(F.count(F.lit(1)).alias("true"))
    s = stored.select(F.col(part).alias("sp"), F.col(term).alias("st"), F.col(df).alias("d")).filter("st is not null").groupBy("sp", "st").agg(F.max("d").alias("stored"), F.count(F.lit(1)).alias("n"))
    j = terms.join(s, terms.p.eqNullSafe(F.col("sp")) & (F.col("t") == F.col("st")), "full_outer")
    state = (
        F.when(F.col("n").isNull(), "missing").when(F.col("true").isNull(), "left_over").when(F.col("n") > 1, "repeated").when(F.col("stored").isNull(), "unset").when(F.col("stored") != F.col("true"), "stale").otherwise("ok")
    )
    return j.select(F.coalesce("p", "sp").alias(part), F.coalesce("t", "st").alias(term), "stored", F.coalesce("true", F.lit(0)).cast("bigint").alias("true"), state.alias("state"))
