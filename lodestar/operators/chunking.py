"""Documents to passages of words, in closed form: no loop, no UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import Chunking
from lodestar.functions import text as T


def chunk(docs: DataFrame, cfg: Chunking = Chunking(), doc_id: str = "doc_id", text: str = "text", merge: bool = True) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, text, total_chunks), chunk_no from 1.

    While more than max words remain, min(target, max) are taken; the rest is one chunk, or with
    ``merge`` joins the chunk before it if it is shorter than min.  Null and blank texts give no chunk.
    """
    t = min(cfg.target_words, cfg.max_words)
    base = docs.select(F.col(doc_id).cast("string").alias("doc_id"), T.words_ws(text).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    full = F.greatest(F.lit(0), F.ceil((F.col("n") - cfg.max_words) / t)).cast("int")
    base = base.withColumn("f", full).withColumn("r", F.col("n") - F.col("f") * t)
    merged = (F.col("f") > 0) & (F.col("r") < cfg.min_words) if merge else F.lit(False)
    total = F.when(merged, F.col("f")).otherwise(F.col("f") + 1)
    base = base.withColumn("total", total)
    piece = lambda i: F.array_join(F.slice("w", (i - 1) * t + 1, F.when(i < F.col("total"), F.lit(t)).otherwise(F.col("n") - (F.col("total") - 1) * t)), " ")
    out = base.select("doc_id", F.col("total").alias("total_chunks"), F.posexplode(F.transform(F.sequence(F.lit(1), F.col("total")), piece)).alias("p", "text"))
    out = out.withColumn("chunk_no", (F.col("p") + 1).cast("int")).drop("p")
    return out.select("doc_id", "chunk_no", F.concat_ws("::", "doc_id", F.concat(F.lit("chunk"), F.col("chunk_no"))).alias("chunk_id"), "text", "total_chunks")


def build(chunks: DataFrame, positions: bool = False) -> DataFrame:
    """Adds clean text, language and tokens; positions on demand."""
    out = chunks.withColumn("clean", T.normalize("text")).withColumn("lang", T.detect_language("clean")).withColumn("tokens", T.tokens_of("clean", "lang"))
    return out.withColumn("positions", T.position_map("clean", "lang")) if positions else out


def live(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Passages that are neither deleted nor empty, as documents named by their passage id."""
    kept = chunks.join(deleted.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return kept.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.col("chunk_id").alias("id"), "text")
