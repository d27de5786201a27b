"""Writers besides the index: appended JSON lines, datasets, change files and pending URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_PAGE = ["id", "url", "title", "text", "links"]
PROCESSED = ["id", "text", "tokens", "source_url"]


def append_json(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Rows as JSON lines added to a folder."""
    (df.select(*columns) if columns else df).write.mode("append").json(path)


def write_raw(pages: DataFrame, path: str) -> None:
    append_json(pages.withColumn("id", F.coalesce("id", F.md5("url"))), path, RAW_PAGE)


def write_processed(chunks: DataFrame, path: str) -> None:
    append_json(chunks, path, PROCESSED)


def write_dataset(docs: DataFrame, path: str, doc_id: str = "id", text: str = "text") -> None:
    """(id, text) rows, replacing what was there."""
    docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).write.mode("overwrite").json(path)


def write_changes(docs: DataFrame, path: str, op: str = "add", doc_id: str = "id", text: str = "text") -> None:
    """Change files for ``streaming.ingest``."""
    body = F.col(text) if op == "add" else F.lit(None).cast("string")
    append_json(docs.select(F.lit(op).alias("op"), F.col(doc_id).cast("string").alias("id"), body.alias("text")), path)


def write_pending(failed: DataFrame, path: str) -> None:
    """Distinct URLs to be tried again, added to those already pending."""
    from lodestar.operators.feedback import pending
    from lodestar.runtime import materialize, path_exists

    spark = failed.sparkSession
    stored = spark.read.schema("url string").json(path) if path_exists(spark, path) else failed.limit(0)
    materialize(pending(stored, failed), "pending").write.mode("overwrite").json(path)


def write_clicks(clicks: DataFrame, path: str, query: str = "query", doc: str = "doc_id") -> None:
    """Clicks as events added to a folder: query in lower case and trimmed, document, time.  Clicks without a document are dropped."""
    q = F.trim(F.lower(F.coalesce(F.col(query), F.lit(""))))
    rows = clicks.select(q.alias("query"), F.col(doc).cast("string").alias("doc_id"), F.current_timestamp().alias("at"))
    append_json(rows.filter("doc_id is not null and doc_id <> ''"), path)


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc_id, at), to be counted by ``operators.feedback.click_counts``; none if nothing was written."""
    from lodestar.runtime import path_exists

    schema = "query string, doc_id string, at timestamp"
    return spark.read.schema(schema).json(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def sync_pending(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """(id, text) of the pending URLs that ``pages`` (url, text) now has; the others stay pending."""
    from lodestar.runtime import materialize, path_exists

    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string, text string")
    waiting = materialize(spark.read.schema("url string").json(path).distinct(), "waiting")
    have = pages.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("url", "text").dropDuplicates(["url"])
    found = materialize(waiting.join(have, "url"), "found")
    waiting.join(found.select("url"), "url", "left_anti").write.mode("overwrite").json(path)
    return found.select(F.col("url").alias("id"), "text")
