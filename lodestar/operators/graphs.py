"""Layered small-world graphs over vectors, one per shard, built and searched inside Arrow groups.

A node's level is drawn from its key's hash, so a rebuilt graph is the same.  From the top level down a search
walks greedily to the nearest node, then keeps the best ``width`` nodes of the lowest level.  New nodes are
linked to their nearest ones that are nearer to them than to a link already taken, which keeps links in all
directions.  Shards are formed by hash of the key, of at most about ``shard`` rows: memory and time of a task
are bounded, and cost grows with the rows.  A query visits every shard and the shards' best are merged.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.runtime import materialize


class Graph:
    """Vectors of unit length, levels, and the links of each level."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, degree: int, width: int):
        self.x, self.levels, self.degree = x, levels, degree
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(levels.max(initial=0)) + 1)]
        self.entry = -1
        for i in range(len(x)):
            self._insert(i, width)

    def _nearest(self, q: np.ndarray, start: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The best ``width`` nodes found from ``start``, best first, as (similarity, node)."""
        links, seen = self.links[level], set(start)
        best = [(float(self.x[i] @ q), i) for i in start]
        todo = [(-s, i) for s, i in best]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [j for j in links.get(i, ()) if j not in seen]
            if not new:
                continue
            seen.update(new)
            for j, t in zip(new, self.x[new] @ q):
                if len(best) < width or t > best[0][0]:
                    heapq.heappush(best, (float(t), j))
                    heapq.heappush(todo, (-float(t), j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted(best, reverse=True)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, those nearer to the node than to one already taken; the rest fills up."""
        taken: list[int] = []
        for s, i in found:
            if len(taken) == most:
                break
            if not taken or (self.x[taken] @ self.x[i]).max() < s:
                taken.append(i)
        return taken + [i for _, i in found if i not in taken][: most - len(taken)]

    def _insert(self, i: int, width: int) -> None:
        top = int(self.levels[i])
        if self.entry < 0:
            self.entry = i
            for level in range(top + 1):
                self.links[level][i] = []
            return
        q, at = self.x[i], [self.entry]
        for level in range(int(self.levels[self.entry]), -1, -1):
            found = self._nearest(q, at, width if level <= top else 1, level)
            at = [j for _, j in found]
            if level > top:
                continue
            most = self.degree * (2 if level == 0 else 1)
            self.links[level][i] = self._spread(found, self.degree)
            for j in self.links[level][i]:
                back = self.links[level][j]
                back.append(i)
                if len(back) > most:
                    sims = self.x[back] @ self.x[j]
                    self.links[level][j] = self._spread(sorted(zip(sims.tolist(), back), reverse=True), most)
        if top > int(self.levels[self.entry]):
            for level in range(int(self.levels[self.entry]) + 1, top + 1):
                self.links[level][i] = []
            self.entry = i

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for level in range(int(self.levels[self.entry]), 0, -1):
            at = [self._nearest(q, at, 1, level)[0][1]]
        return self._nearest(q, at, max(width, k), 0)[:k]

    # -- as columns ------------------------------------------------------------------------------
    def rows(self) -> tuple[list[list[list[int]]], int]:
        """Links of every node, level by level, and the entry node."""
        return [[self.links[v].get(i, []) for v in range(int(self.levels[i]) + 1)] for i in range(len(self.x))], self.entry

    @classmethod
    def restore(cls, x: np.ndarray, links: list[list[list[int]]], entry: int) -> Graph:
        g = cls.__new__(cls)
        g.x, g.levels, g.degree, g.entry = x, np.array([len(n) - 1 for n in links]), 0, entry
        g.links = [{} for _ in range(int(g.levels.max(initial=0)) + 1)]
        for i, n in enumerate(links):
            for v, to in enumerate(n):
                g.links[v][i] = to
        return g


def draw_levels(seeds: np.ndarray, degree: int) -> np.ndarray:
    """Level of each node from a 64-bit hash: one in ``degree`` reaches the next."""
    u = (seeds.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(np.maximum(u, 1e-18)) / math.log(degree)).astype(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def build(vectors: DataFrame, key: str, v: str = "v", degree: int = 16, width: int = 100, shard: int = 4096) -> DataFrame:
    """(part, node, key, v, links, entry): graphs of about ``shard`` rows each, written to the shared folder."""
    parts = max(1, -(-vectors.count() // shard))
    src = vectors.filter(F.col(v).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.xxhash64(key, F.lit(7)).alias("seed"), key, F.col(v).cast("array<double>").alias("v"))
    kt = src.schema[key].dataType.simpleString()

    def run(table):
        table = table.sort_by("seed")
        x = _unit(np.array(table["v"].to_pylist(), dtype=np.float64))
        links, entry = Graph(x, draw_levels(table["seed"].to_numpy().view(np.uint64), degree), degree, width).rows()
        n = table.num_rows
        return pa.table({"part": table["part"], "node": pa.array(range(n), pa.int32()), key: table[key], "v": table["v"], "links": pa.array(links, pa.list_(pa.list_(pa.int32()))), "entry": pa.array([entry] * n, pa.int32())})

    out = src.groupBy("part").applyInArrow(run, f"part int, node int, `{key}` {kt}, v array<double>, links array<array<int>>, entry int")
    return materialize(out, "graphs")


def search(graph: DataFrame, queries: DataFrame, k: int, key: str, width: int = 64, block: int = 2000) -> DataFrame:
    """The k best of each query (query_id, q): every shard is searched by every query, in blocks of ``block`` queries."""
    from lodestar.operators.vectors import query_blocks

    qt, kt = queries.schema["query_id"].dataType.simpleString(), graph.schema[key].dataType.simpleString()
    schema = f"query_id {qt}, `{key}` {kt}, score double"
    out = None
    for rows in query_blocks(queries, block):
        shared = graph.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.q for r in rows], dtype=np.float64)))
        found = graph.groupBy("part").applyInArrow(_searcher(shared, k, key, width, qt), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return graph.sparkSession.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _searcher(shared, k: int, key: str, width: int, qt: str):
    def run(table):
        ids, q = shared.value
        table = table.sort_by("node")
        raw = np.array(table["v"].to_pylist(), dtype=np.float64)
        g = Graph.restore(_unit(raw), table["links"].to_pylist(), table["entry"][0].as_py())
        keys = table[key].to_pylist()
        found = [(i, keys[j], float(raw[j] @ v)) for i, v in zip(ids, q) for _, j in g.search(v, k, width)]
        cols = list(zip(*found)) or [(), (), ()]
        kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[qt]
        return pa.table({"query_id": pa.array(cols[0], kind), key: pa.array(cols[1], table.schema.field(key).type), "score": pa.array(cols[2], pa.float64())})

    return run
