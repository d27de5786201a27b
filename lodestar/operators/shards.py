"""Shards: assignment, manifest budget, merging of shard results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_rows(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """Adds ``row_no`` from 0 by ``order``, without a global sort in one task.

    Rows are cut into blocks by approximate quantiles, blocks are counted, and a row's number is its
    block's offset plus its rank in the block.  Null keys come last.
    """
    cuts = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("cuts"))
    x = df.crossJoin(F.broadcast(cuts))  # one row
    x = x.withColumn("_b", F.when(F.col(order).isNull() | F.col("cuts").isNull(), F.lit(parts)).otherwise(F.size(F.filter("cuts", lambda c: c < F.col(order))))).drop("cuts")
    sizes = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    off = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    x = x.join(F.broadcast(off), "_b")  # at most parts + 1 rows
    return x.withColumn("row_no", F.col("_off") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1).drop("_b", "_off")


def assign(docs: DataFrame, order: str, per_shard: int, parts: int = 64) -> DataFrame:
    """Adds ``shard`` (shard_0000, ...): consecutive runs of ``per_shard`` rows by ``order``, a number."""
    if per_shard < 1:
        raise ValueError("per_shard must be at least 1")
    return number_rows(docs, order, parts).withColumn("shard", F.format_string("shard_%04d", F.floor(F.col("row_no") / per_shard).cast("int"))).drop("row_no")


def within_budget(shards: DataFrame, budget: int, order: str = "pos", size: str = "bytes") -> DataFrame:
    """The first shards in order whose running size stays within the budget; at least one."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = shards.withColumn("running", F.sum(size).over(w)).withColumn("_rn", F.row_number().over(Window.orderBy(order)))
    return out.filter((F.col("running") <= budget) | (F.col("_rn") == 1)).drop("_rn")


def merge_results(results: DataFrame, k: int) -> DataFrame:
    """Results of all shards (query_id, chunk_id, score) as one list, the best row per passage."""
    one = results.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pick(shards: DataFrame, query_hash: int, budget: int) -> DataFrame:
    """``budget`` consecutive shards from hash % n on, wrapping round."""
    w = Window.orderBy("shard")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    at = F.pmod(F.row_number().over(w) - 1 - F.pmod(F.lit(query_hash), n), n)
    return shards.withColumn("_at", at).filter(F.col("_at") < budget).drop("_at")
