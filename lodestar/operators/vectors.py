"""Hashed n-gram vectors and similarity search: exact, 8-bit, inverted lists, product codes and graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.config import Config
from lodestar.functions.text import normalize
from lodestar.operators import graphs
from lodestar.operators.shards import number_rows
from lodestar.runtime import materialize


# -- embedding ---------------------------------------------------------------------------------
def _fnv_ngrams(data: np.ndarray, n: int) -> np.ndarray:
    """FNV-1a 32 of every byte n-gram."""
    h = np.full(len(data) - n + 1, 2166136261, dtype=np.uint64)
    for k in range(n):
        h = ((h ^ data[k : len(data) - n + 1 + k]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return h


def embed_one(clean: str, dims: int, lo: int, hi: int) -> np.ndarray:
    """Counts of hashed byte n-grams of the blank-padded text, at unit length."""
    v = np.zeros(dims, dtype=np.float64)
    data = np.frombuffer(f" {clean} ".encode(), dtype=np.uint8).astype(np.uint64)
    for n in range(lo, hi + 1):
        if len(data) >= n:
            v += np.bincount((_fnv_ngrams(data, n) % np.uint64(dims)).astype(np.int64), minlength=dims)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm > 0 else v


def embed(df: DataFrame, key: str, text: str, cfg: Config = Config()) -> DataFrame:
    """(key, v): null texts are embedded as empty ones."""
    src = df.select(F.col(key), normalize(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    kt = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([embed_one(t.as_py(), cfg.dims, cfg.ngram_min, cfg.ngram_max) for t in b.column(1)]) if b.num_rows else np.zeros((0, cfg.dims))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * cfg.dims), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "v"])

    return src.mapInArrow(run, f"`{key}` {kt}, v array<double>")


# -- scores as expressions ---------------------------------------------------------------------
def dot(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def quantize(v) -> Column:
    """struct<q array<tinyint>, scale>: scale is the largest magnitude / 127, or 1 for a zero vector."""
    v = F.col(v) if isinstance(v, str) else v
    top = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0.0)).cast("double")
    scale = F.when(top / 127 < 1e-6, F.lit(1.0)).otherwise(top / 127)
    q = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale))).cast("tinyint"))
    return F.struct(q.alias("q"), scale.alias("scale"))


def quantize_fixed(v, scale: float = 127.0) -> Column:
    """The web profile: one scale for all, halves rounded up."""
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * scale + 0.5))).cast("tinyint"))


def top_k(scored: DataFrame, k: int, key: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """The query set (query_id, q) on the driver, at most ``size`` at a time: a larger set is cut by hash of its ids."""
    n = queries.count()
    parts = max(1, -(-n * 5 // (size * 4)))
    for i in range(parts if n else 0):
        part = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        rows = part.select("query_id", "q", *[c for c in ("lists",) if c in queries.columns]).collect()
        for at in range(0, len(rows), size):
            yield rows[at : at + size]


def _best(kept: list, scores: np.ndarray, keys: list, k: int) -> None:
    """Merges a batch into ``kept``, per query the k best (score to 9 digits, then key) so far."""
    r = np.round(scores, 9)
    floor = np.partition(r, -k, axis=0)[-k] if len(r) > k else np.full(r.shape[1], -np.inf)
    for j in range(r.shape[1]):
        full = len(kept[j]) == k
        at = np.nonzero(r[:, j] >= max(floor[j], kept[j][-1][0] if full else -np.inf))[0]
        if len(at):
            kept[j] = sorted(kept[j] + [(r[i, j], keys[i], scores[i, j]) for i in at], key=lambda x: (-x[0], x[1]))[:k]


def _floats(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def scan(vectors: DataFrame, queries: DataFrame, k: int, key: str, score, columns: list[str], max_queries: int = 2000) -> DataFrame:
    """The k best rows of a table for each query of a stated set, by matrix products over Arrow batches.

    The set reaches the tasks in blocks of at most ``max_queries`` vectors; every task sends on no more than k
    rows a query.  ``score(batch, q)`` gives the scores of a batch's rows (columns key, *columns) for the
    queries.  With a column ``lists`` a query sees only rows whose ``cid`` is among them.
    """
    qt, kt = queries.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    listed = "lists" in queries.columns
    src = vectors.select(key, *columns, *(["cid"] if listed else []))
    schema = f"query_id {qt}, `{key}` {kt}, score double"
    parts = None
    for rows in query_blocks(queries, max_queries):
        shared = vectors.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.q for r in rows], dtype=np.float64), [set(r.lists) for r in rows] if listed else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, lists = shared.value
            kept: list = [[] for _ in ids]
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    keys = b.column(0).to_pylist()
                    if lists is None:
                        for lo in range(0, len(ids), 512):
                            part = kept[lo : lo + 512]
                            _best(part, score(b, q[lo : lo + 512]), keys, k)
                            kept[lo : lo + 512] = part
                        continue
                    cid = b.column(len(columns) + 1).to_numpy()
                    for c in np.unique(cid):
                        asked = [j for j, own in enumerate(lists) if int(c) in own]
                        if asked:
                            rows_of = np.nonzero(cid == c)[0]
                            part = [kept[j] for j in asked]
                            _best(part, score(b.take(pa.array(rows_of)), q[asked]), [keys[i] for i in rows_of], k)
                            for j, x in zip(asked, part):
                                kept[j] = x
            out = [(i, x[1], float(x[2])) for i, best in zip(ids, kept) for x in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(_arrow(qt, kt, key))], schema=_arrow(qt, kt, key))

        found = src.mapInArrow(run, schema)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    return top_k(parts, k, key)


def _arrow(qt: str, kt: str, key: str) -> pa.Schema:
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([("query_id", kind[qt]), (key, kind[kt]), ("score", pa.float64())])


def search_full(vectors: DataFrame, queries: DataFrame, k: int, key: str, v: str = "v", max_queries: int = 2000) -> DataFrame:
    """Exact search of a stated query set (query_id, q) against all rows."""
    return scan(vectors, queries, k, key, lambda b, q: _floats(b.column(1)) @ q.T, [v], max_queries)


def _score_i8(b: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
    return (_floats(b.column(1)) @ q.T) * b.column(2).to_numpy()[:, None]


def search_i8(vectors: DataFrame, queries: DataFrame, k: int, key: str, max_queries: int = 2000) -> DataFrame:
    """(q, scale) rows: the query stays in floats."""
    return scan(vectors, queries, k, key, _score_i8, ["q", "scale"], max_queries)


# -- trained layouts ---------------------------------------------------------------------------
def systematic_sample(vectors: DataFrame, key: str, v: str, size: int) -> np.ndarray:
    """Every floor(n / size)-th vector by key, at most ``size``: a bounded sample for training."""
    n = vectors.count()
    step = max(1, n // size)
    picked = vectors.select(key, v) if step == 1 else number_rows(vectors.select(key, v), key).filter(F.col("row_no") % step == 0)
    rows = picked.orderBy(key).limit(size).select(v).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def kmeans_dot(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids from every floor(n / k)-th sample; assignment by the largest dot product; an empty cluster keeps its centroid."""
    if not len(x):
        return np.zeros((0, x.shape[1] if x.ndim == 2 else 0))
    k = min(k, len(x))
    step = max(1, len(x) // k)
    c = x[[min(i * step, len(x) - 1) for i in range(k)]].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(0)
    return c


def ivf_assign(vectors: DataFrame, centroids: np.ndarray, key: str, v: str = "v") -> DataFrame:
    """Adds ``cid``, the centroid of the largest dot product."""
    return _nearest(vectors, centroids, key, v, 1).select(key, v, F.col("cids")[0].alias("cid"))


def _nearest(df: DataFrame, centroids: np.ndarray, key: str, v: str, n: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    src = df.select(key, v)
    kt, vt = (f.dataType.simpleString() for f in src.schema)
    n = min(n, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), dtype=np.float64)
            top = np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :n]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(top.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=[key, v, "cids"])

    return src.mapInArrow(run, f"`{key}` {kt}, `{v}` {vt}, cids array<int>")


def train_lists(vectors: DataFrame, key: str, v: str, cfg: Config) -> np.ndarray:
    """Centres of the inverted lists from a sample of at most ``cfg.train_sample`` rows; none if there are fewer rows than lists."""
    if vectors.count() < cfg.ivf_lists:
        return np.zeros((0, cfg.dims))
    return kmeans_dot(systematic_sample(vectors, key, v, cfg.train_sample), cfg.ivf_lists, cfg.kmeans_rounds)


def probes_of(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Adds ``lists``, the best ``probes`` lists of each query (query_id, q)."""
    return _nearest(queries, centroids, "query_id", "q", probes).withColumnRenamed("cids", "lists")


def search_ivf(assigned: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, key: str, probes: int, v: str = "v", quantized: bool = False) -> DataFrame:
    """The lists of the ``probes`` best centroids only, pushed to the scan; queries whose lists are all empty search all rows.

    ``assigned``: key, cid and v, or with ``quantized`` q and scale: then codes are scored, as they are stored.
    """
    q = materialize(probes_of(queries, centroids, probes), "probes")
    lists = [r.c for r in q.select(F.explode("lists").alias("c")).distinct().collect()]  # at most the number of centres
    near = assigned.filter(F.col("cid").isin(lists))
    score, columns = (_score_i8, ["q", "scale"]) if quantized else (lambda b, m: _floats(b.column(1)) @ m.T, [v])
    hits = materialize(scan(near, q, k, key, score, columns), "ivf")
    lost = q.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "q")
    return hits if lost.isEmpty() else hits.unionByName(scan(assigned, lost, k, key, score, columns))


def pq_train(x: np.ndarray, parts: int, codes: int, rounds: int) -> list[np.ndarray]:
    sub = x.shape[1] // parts
    return [kmeans_dot(x[:, i * sub : (i + 1) * sub], codes, rounds) for i in range(parts)]


def pq_encode(vectors: DataFrame, books: list[np.ndarray], key: str, v: str = "v") -> DataFrame:
    """(key, codes), with ``cid`` if the rows have one: the nearest code of every part by squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    listed = "cid" in vectors.columns
    src = vectors.select(key, v, *(["cid"] if listed else []))
    kt = src.schema[0].dataType.simpleString()
    m = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), dtype=np.float64)
            out = np.empty((len(x), m), dtype=np.int32)
            for i, c in enumerate(shared.value):
                p = x[:, i * c.shape[1] : (i + 1) * c.shape[1]]
                out[:, i] = ((c * c).sum(1)[None] - 2 * p @ c.T).argmin(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * m), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, *b.columns[2:]], names=[key, "codes", *(["cid"] if listed else [])])

    return src.mapInArrow(run, f"`{key}` {kt}, codes array<int>" + (", cid int" if listed else ""))


def search_pq(encoded: DataFrame, books: list[np.ndarray], queries: DataFrame, k: int, key: str, max_queries: int = 2000) -> DataFrame:
    """Sums of table look-ups: a query brings the dot products of its parts with all codes.  With a column ``lists`` only those lists."""
    shared = encoded.sparkSession.sparkContext.broadcast(books)

    def score(b: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        codes = np.array(b.column(1).to_pylist(), dtype=np.int64)
        out = np.zeros((len(codes), len(q)))
        for i, c in enumerate(shared.value):
            out += (c @ q[:, i * c.shape[1] : (i + 1) * c.shape[1]].T)[codes[:, i]]
        return out

    return scan(encoded, queries, k, key, score, ["codes"], max_queries)


def build(vectors: DataFrame, key: str, v: str = "v", cfg: Config = Config(), pq: bool = False, ivf: bool = True, quantized: bool = True, graph: bool = False) -> dict:
    """The layout a mode asks for: a graph, else product codes, else 8-bit codes, else floats; in lists if there are enough rows."""
    n = vectors.count()
    dims = len(vectors.select(v).first()[0]) if n else cfg.dims
    out: dict = {"mode": "graph" if graph else "pq" if pq and dims % cfg.pq_parts == 0 else "i8" if quantized else "f32", "key": key, "v": v, "vectors": vectors}
    if out["mode"] == "graph":
        out["graph"] = graphs.build(vectors, key, v, cfg.graph_degree, cfg.graph_build, cfg.graph_shard)
        return out
    listed = ivf and n >= cfg.ivf_lists
    sample = systematic_sample(vectors, key, v, cfg.train_sample) if n and (out["mode"] == "pq" or listed) else None
    if listed:
        out["centroids"] = kmeans_dot(sample, cfg.ivf_lists, cfg.kmeans_rounds)
        out["vectors"] = ivf_assign(vectors, out["centroids"], key, v)
    if out["mode"] == "pq":
        out["books"] = pq_train(sample, cfg.pq_parts, cfg.pq_codes, cfg.kmeans_rounds)
        out["codes"] = pq_encode(out["vectors"], out["books"], key, v)
    if out["mode"] == "i8":
        z = out["vectors"].select("*", quantize(v).alias("z"))
        out["i8"] = z.select(*[c for c in out["vectors"].columns if c != v], "z.q", "z.scale")
    return out


def search(index: dict, queries: DataFrame, k: int, cfg: Config = Config()) -> DataFrame:
    """The k best of each query (query_id, q) in a layout of ``build``."""
    key, v, mode, centres = index["key"], index["v"], index["mode"], index.get("centroids")
    if mode == "graph":
        return graphs.search(index["graph"], queries, k, key, cfg.graph_search)
    if mode == "pq":
        return search_pq(index["codes"], index["books"], queries if centres is None else probes_of(queries, centres, cfg.ivf_probe), k, key)
    if centres is not None:
        return search_ivf(index["i8"] if mode == "i8" else index["vectors"], centres, queries, k, key, cfg.ivf_probe, v, mode == "i8")
    return search_i8(index["i8"], queries, k, key) if mode == "i8" else search_full(index["vectors"], queries, k, key, v)


def sparse_cosine(chunks: DataFrame, qterms: DataFrame, chunk_id: str = "chunk_id", tokens: str = "tokens") -> DataFrame:
    """(query_id, chunk_id, score): cosine of term-frequency vectors, positive ones only."""
    tf = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(tokens).alias("term")).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    norm = tf.groupBy("chunk_id").agg(F.sqrt(F.sum((F.col("tf") * F.col("tf")).cast("double"))).alias("dn"))
    q = qterms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum((F.col("qf") * F.col("qf")).cast("double"))).alias("qn"))
    dots = tf.join(q, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("tf") * F.col("qf")).alias("d"))
    return dots.join(norm, "chunk_id").join(qn, "query_id").select("query_id", "chunk_id", (F.col("d") / (F.col("dn") * F.col("qn"))).alias("score")).filter("score > 0")
