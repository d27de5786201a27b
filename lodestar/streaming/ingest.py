"""Incremental ingestion: a folder of JSON change files feeds the index through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.index import Index

CHANGE = "op string, id string, text string"


def apply_changes(index: Index, batch: DataFrame, batch_id: str) -> None:
    """Deletes, then adds of one batch, in one version; ``update`` is both.  A batch that was applied before is skipped."""
    if batch_id in index.state["batches"]:
        return
    gone = batch.filter("lower(op) in ('delete', 'update') and id is not null").select("id")
    docs = batch.filter("lower(coalesce(op, 'add')) in ('add', 'update') and id is not null and text is not null").select(F.col("id").alias("doc_id"), "text")
    index.update(docs, batch=batch_id, gone=gone, replace=False)


def follow(spark: SparkSession, index: Index, folder: str, checkpoint: str, files_per_batch: int = 500) -> StreamingQuery:
    """Processes all change files there are and stops; run it again for the next ones.

    The checkpoint remembers the files, the manifest remembers the batch: together each change is
    applied once, whichever step a failure interrupts.
    """
    src = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            apply_changes(index, batch, f"stream-{batch_id}")
        finally:
            batch.unpersist()

    return src.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def click_stream(spark: SparkSession, folder: str, lateness: str = "1 hour") -> DataFrame:
    """Clicks per document and hour from event files (event_id, ts, user_id, event_type, value, props); late events are dropped after ``lateness``."""
    src = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").json(folder)
    return src.filter("event_type = 'click'").withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "user_id").count()
