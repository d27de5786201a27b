"""Queries over the training-data tables, one or more per problem, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.runtime import load


# -- problems 1 and 7: page lines ----------------------------------------------------------------
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.pagelines import Pages

    return Pages(load(spark, d, "raw_pages", spread=True)).furniture()


def p1_body(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.pagelines import Pages, main_text

    pages = load(spark, d, "raw_pages", spread=True)
    return main_text(pages, Pages(pages))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.pagelines import Pages

    return Pages(load(spark, d, "raw_pages", spread=True)).spam().select("crawl_id")


# -- problem 2: term frequencies ---------------------------------------------------------------
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.term_counts import build_from_history

    store = build_from_history(spark, load(spark, d, "chunks"), "chunk_id", "tokens", "indexed_at")
    return store.marked().filter("mark is not null").select("term", "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.term_counts import build_from_history

    return build_from_history(spark, load(spark, d, "chunks"), "chunk_id", "tokens", "indexed_at").marked()


def p2_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The stored dictionary of each shard against the counts of its valid chunks."""
    from lodestar.llm.term_counts import reconcile

    return reconcile(load(spark, d, "term_meta"), load(spark, d, "chunks"), "chunk_id", "tokens", "indexed_at")


_P2_DICTIONARY = """
with valid as (select shard, tokens from (select *, row_number() over (partition by chunk_id order by indexed_at desc nulls last) rn from chunks where chunk_id is not null) where rn = 1),
 c as (select shard, term, count(*) n from (select shard, unnest(list_distinct(tokens)) term from valid) where term is not null and term <> '' group by all),
 s as (select shard, term, max(df) stored, count(*) k from term_meta where term is not null group by all)
select coalesce(c.shard, s.shard) shard, coalesce(c.term, s.term) term, stored, coalesce(n, 0) as "true",
 case when k is null then 'missing' when n is null then 'left_over' when k > 1 then 'repeated' when stored is null then 'unset' when stored <> n then 'stale' else 'ok' end state
from c full join s on c.shard is not distinct from s.shard and c.term = s.term
"""

_P2_SQL = """
with valid as (select chunk_id, tokens from (select *, row_number() over (partition by chunk_id order by indexed_at desc nulls last) rn from chunks where chunk_id is not null) where rn = 1),
 t as (select chunk_id, unnest(tokens) term from valid),
 c as (select term, count(*) occurrences, count(distinct chunk_id) records from t where term is not null and term <> '' group by term),
 n as (select count(*) n from valid),
 m as (select term, cast(occurrences as bigint) occurrences, cast(records as bigint) records,
   case when records <= 2 then 'rare' when records > 0.1 * (select n from n) then 'common' end mark from c)
"""


# -- problem 3: one ranking --------------------------------------------------------------------
_SIGNALS = ["bm25", "semantic", "exact", "proximity"]


def _ranked_runs(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    from lodestar.llm.leximin import latest, leximin_top

    rows = load(spark, d, "score_breakdown")
    valid = latest(rows, ["query_id", "chunk_id"], "scored_at", _SIGNALS)
    return leximin_top(valid, "query_id", "chunk_id", _SIGNALS, k, sizes_from=rows)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_runs(spark, d, 5).select("query_id", "chunk_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    df = _ranked_runs(spark, d, None)
    return df.select("query_id", "chunk_id", F.round(F.col("percentiles")[0], 6).alias("weakest"), F.col("place").cast("bigint").alias("place"))


_P3_SQL = """
with valid as (select * from (select *, row_number() over (partition by query_id, chunk_id order by scored_at desc nulls last) rn from score_breakdown) where rn = 1),
 v as (select query_id, chunk_id, count(*) over (partition by query_id) n,
  {ranks} from valid),
 p as (select query_id, chunk_id, list_sort([{pcts}]) pc from v),
 r as (select *, row_number() over (partition by query_id order by pc[1] desc, pc[2] desc, pc[3] desc, pc[4] desc, chunk_id) place from p)
""".format(
    ranks=", ".join(f"rank() over (partition by query_id order by case when {c} is null or isnan({c}) then '-infinity'::double else {c} end desc) r_{c}" for c in _SIGNALS),
    pcts=", ".join(f"1 - (r_{c} - 1) / n::double" for c in _SIGNALS),
)


# -- problem 4: near-duplicates ----------------------------------------------------------------
def _near_duplicates(spark: SparkSession, d: str, shingle: int, least: float):
    from lodestar.llm.neardup import NearDuplicates

    docs = load(spark, d, "documents", spread=True).select(F.lit("documents").alias("kind"), F.col("doc_id").alias("key"), "text")
    chunks = load(spark, d, "processed_chunks", spread=True).select(F.lit("processed_chunks").alias("kind"), F.col("chunk_ord").alias("key"), "text")
    return NearDuplicates(docs.unionByName(chunks), shingle, least)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = _near_duplicates(spark, d, 3, 0.6).pairs()
    return found.select(F.col("kind").alias("record_kind"), F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    found = _near_duplicates(spark, d, 5, 0.8).members()
    return found.select(F.col("kind").alias("record_kind"), "key", F.col("rep").alias("class_key"), "links")


# -- problem 5: nearest vectors ----------------------------------------------------------------
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.knn_graph import nearest

    near = nearest(load(spark, d, "vector_persist"), "vec_id", "vectors_i8", 384, 5, least=0.6)
    return near.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()


# -- problem 6: markup -------------------------------------------------------------------------
def _style_trees(spark: SparkSession, d: str):
    from lodestar.llm.markup import StyleTrees

    docs = load(spark, d, "documents", spread=True).withColumn("site", F.element_at(F.split("source", "/"), -1))
    return StyleTrees(docs, "doc_id", "text", "site")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _style_trees(spark, d).languages()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return _style_trees(spark, d).clean()


# -- problem 8: token ids ----------------------------------------------------------------------
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.bpe import encode_column

    return encode_column(load(spark, d, "documents", spread=True), "doc_id", "text")


# -- problem 9: leaked evaluation texts ----------------------------------------------------------
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.leaks import find_leaks

    hits = find_leaks(load(spark, d, "documents", spread=True), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "expected_answer")
    return hits.select("doc_id", "item_id")


# -- problem 10: personal information ------------------------------------------------------------
def _scanned(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.llm.pii import scan

    return scan(load(spark, d, "documents", spread=True), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    each = _scanned(spark, d).select("doc_id", F.explode(F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("pii_kind"), s["value"].alias("pii_value"))))).alias("p"))
    return each.select("doc_id", "p.pii_kind", "p.pii_value")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("doc_id", F.col("redacted").alias("text"), F.size("spans").cast("bigint").alias("n_spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2_SQL + "select term, mark from m where mark is not null",
        "p2_counts": _P2_SQL + "select * from m",
        "p2_dictionary": _P2_DICTIONARY,
        "p3_found": _P3_SQL + "select query_id, chunk_id from r where place <= 5",
        "p3_ranking": _P3_SQL + "select query_id, chunk_id, round(pc[1], 6) weakest, place from r",
    }
