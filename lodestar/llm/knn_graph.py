"""The k most similar vectors of every vector, by a tree of pivots and exact products within its cells.

1. First pivots are fitted on a bounded sample (``SAMPLE`` vectors by hash order).  A cell that would hold more than ``shard_rows``
   vectors is split by pivots of its own, and so on, level by level.  The tree is grown on a sample that stays in proportion
   to the cells (``DRAWN`` vectors a cell), so the vectors themselves are read once for it and are not moved.
2. Equal vectors are one node.  Every node goes down the tree, at each level to the ``BEAM`` nearest cells below those it has come to,
   and is sent once to each of the ``overlap`` nearest cells it ends in.  The number of cells grows with the vectors, while the cells a
   vector is in and the members a cell has do not.  What the tree cannot split is salted into sub-shards by hash, which every
   vector of the cell visits.
3. In each cell every member is compared with every other by one matrix product.  Products of int8 values are whole numbers that
   the floats hold exactly, so the cosines are exact and no member of a cell is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.neardup import _small
from lodestar.runtime import materialize

#: Documented bound of the sample the pivots of one cell are fitted on.
SAMPLE = 20_000
SHARD_ROWS = 2048
#: Cells are made for ``shard_rows / SPLIT`` members; how often cells are split.
SPLIT, LEVELS = 2, 4
#: Cells a vector keeps on its way down the tree; it is sent only to the nearest ``overlap`` at the end.
BEAM = 8
#: Vectors a cell that the tree is grown on.
DRAWN = 32
#: Pivots a tree has at most, that it can be broadcast; beyond, cells grow, and those above four shards are salted.
TREE = 400_000
#: Copies of equal vectors up to which they are broadcast.
_COPIES = 2_000_000
_BLOCK = 1024


def unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_pivots(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        used = np.bincount(own, minlength=k) > 0
        c[used] = unit(total[used])
    return c


class Tree:
    """Pivots, one a cell: the first ``roots`` are the top; the children of cell ``c`` are the rows ``lo[c]`` to ``hi[c]``, none if equal."""

    def __init__(self, roots: np.ndarray):
        self.roots = len(roots)
        self.pivots = roots.astype(np.float16)
        self.lo = self.hi = np.zeros(len(roots), dtype=np.int64)

    def split(self, parts: dict[int, np.ndarray]) -> None:
        at, n = len(self.pivots), sum(map(len, parts.values()))
        self.lo, self.hi = (np.concatenate([v, np.zeros(n, dtype=np.int64)]) for v in (self.lo, self.hi))
        for cell, c in parts.items():
            self.lo[cell], self.hi[cell] = at, at + len(c)
            at += len(c)
        self.pivots = np.concatenate([self.pivots, *(c.astype(np.float16) for c in parts.values())])

    def route(self, x: np.ndarray, take: int) -> np.ndarray:
        """The ``take`` nearest leaves found for each row, of ``BEAM`` cells a level; -1 where there are fewer."""
        beam = max(BEAM, take)
        cells, sims = _best(x @ self.pivots[: self.roots].astype(np.float32).T, beam)
        while True:
            r, c = np.nonzero((cells >= 0) & (self.hi[cells] > 0))
            if not len(r):
                return np.take_along_axis(cells, _best(sims, take)[0], 1)
            wide = np.full((len(x), cells.shape[1], beam), -1, dtype=np.int64)
            near = np.full(wide.shape, -np.inf, dtype=np.float32)
            wide[:, :, 0], near[:, :, 0] = cells, sims
            order = np.argsort(cells[r, c], kind="stable")
            r, c = r[order], c[order]
            for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(cells[r, c])) + 1):
                i, j = r[part], c[part]
                lo, hi = (int(v[cells[i[0], j[0]]]) for v in (self.lo, self.hi))
                kids, s = _best(x[i] @ self.pivots[lo:hi].astype(np.float32).T, beam)
                wide[i, j, : kids.shape[1]], near[i, j, : kids.shape[1]] = kids + lo, s
            at, sims = _best(near.reshape(len(x), -1), beam)
            cells = np.where(sims > -np.inf, np.take_along_axis(wide.reshape(len(x), -1), at, 1), -1)


def _best(s: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    take = min(take, s.shape[1])
    at = np.argpartition(-s, take - 1, axis=1)[:, :take]
    return at.astype(np.int64), np.take_along_axis(s, at, 1)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.frombuffer(b"".join(v for c in chunks for v in c.to_pylist()), dtype=np.int8).reshape(-1, dims)


def _pack(dims: int, vectors: bool):
    """(id, v, h) or (id, h) of the usable rows: a vector's bytes and their 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(1) if flat.null_count else True
            raw = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int8).reshape(-1, dims)
            ok = raw.any(1) & whole
            rows = [r.tobytes() for r in raw[ok]]
            cols = {"id": b.column(0).filter(pa.array(ok)), "v": pa.array(rows, pa.binary()), "h": pa.array([xxhash.xxh3_128_digest(r) for r in rows], pa.binary())}
            yield pa.RecordBatch.from_pydict(cols if vectors else {k: cols[k] for k in ("id", "h")})

    return run


def _answer(k: int, dims: int, least: float | None):
    kind = np.float32 if dims * 128 * 128 < 1 << 24 else np.float64  # sums of products stay whole numbers

    def run(cell: pa.Table) -> pa.Table:
        ids, x = cell["id"].to_numpy(), _matrix(cell["v"], dims).astype(kind)
        salted = "owned" in cell.column_names
        own, asks = (np.flatnonzero(cell[c].to_numpy()) if salted else np.arange(len(ids)) for c in ("owned", "asks"))
        sq = np.einsum("ij,ij->i", x, x, dtype=np.float64)
        members, by = x[own], (1 / np.sqrt(sq[own])).astype(kind)
        here = np.full(len(ids), -1)
        here[own] = np.arange(len(own))
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(0, len(asks) if len(own) else 0, _BLOCK):
            rows = asks[i : i + _BLOCK]
            dot = x[rows] @ members.T
            s = dot * by
            self_at = here[rows]
            s[np.flatnonzero(self_at >= 0), self_at[self_at >= 0]] = -np.inf
            # what may be among the best, with room for the rounding of s; the exact cosines decide
            norm = np.sqrt(sq[rows])
            may = s >= ((-2 if least is None else least - 1e-6) * norm).astype(kind)[:, None]
            many = np.flatnonzero(may.sum(1) > 4 * k)
            if len(many):
                t = s[many]
                may[many] &= t >= (np.partition(t, -k, axis=1)[:, -k] - 1e-6 * norm[many]).astype(kind)[:, None]
            r, c = np.nonzero(may)
            cos = np.round(dot[r, c].astype(np.float64) / np.sqrt(sq[rows[r]] * sq[own[c]]), 9)
            if least is not None:
                r, c, cos = (v[cos >= least] for v in (r, c, cos))
            q, nb = ids[rows[r]], ids[own[c]]
            order = np.lexsort((nb, -cos, r))
            r = r[order]
            order = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
            out.append((q[order], nb[order], cos[order]))
        q, nb, cos = (np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"q": q, "nb": nb, "cos": cos})

    return run


def nearest(df: DataFrame, key: str, vector: str, dims: int, k: int = 5, overlap: int = 3, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, least: float | None = None) -> DataFrame:
    """(key, neighbour, cos): for every usable vector its k most similar other vectors, ties to the smaller key; with ``least``, those of at least that cosine.

    Defined results: null, wrongly long and all-zero vectors and null elements or keys are left out;
    equal vectors are each other's neighbours; of rows with one key the first by content counts; a
    single vector has no neighbours; other columns are not read.  Approximate: a true neighbour that shares
    no cell may be missing (measured recall is in the README); every returned cosine is exact.

    The vectors are read from ``df`` in each of three passes (keys, sample, cells) and moved once, to their cells.
    """
    usable = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == dims))
    keys = materialize(usable.mapInArrow(_pack(dims, False), "id bigint, h binary"), "keys")
    vectors = usable.mapInArrow(_pack(dims, True), "id bigint, v binary, h binary")
    twice = materialize(keys.groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("id"), "twice")
    if not twice.isEmpty():
        first = vectors.join(_small(twice, _COPIES), "id").groupBy("id").agg(F.min(F.struct("v", "h")).alias("x")).select("id", "x.v", "x.h")
        first = materialize(first, "first")
        keys = keys.join(_small(twice, _COPIES), "id", "left_anti").unionByName(first.select("id", "h"))
        vectors = vectors.join(_small(twice, _COPIES), "id", "left_anti").unionByName(first)
    # equal vectors are one node, named by its smallest id
    equal = keys.groupBy("h").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("h", "node")
    equal = materialize(equal, "equal")
    copies = materialize(keys.join(_small(equal, _COPIES), "h").select("id", "node"), "copies")
    later = copies.filter("id <> node").select("id")
    n, extra = keys.count(), later.count()
    packed = vectors.select("id", "v")
    if extra:
        packed = packed.join(_small(later, _COPIES), "id", "left_anti")
    tree, crowded = grow(packed, n - extra, dims, overlap, shard_rows, sample)
    placed = _placed(packed, tree, overlap, dims)
    left = {c: -(-m // shard_rows) for c, m in crowded.items() if m > 4 * shard_rows}
    if left:
        asked = _salted(placed, left)
        found = asked.groupBy("cell", "part", "block").applyInArrow(_answer(k, dims, least), "q bigint, nb bigint, cos double")
    else:
        found = placed.groupBy("cell").applyInArrow(_answer(k, dims, least), "q bigint, nb bigint, cos double")
    if extra:
        # back to rows: the neighbours of a node are the first copies of the neighbouring nodes and its own (k + 1 are all that ties can ask for)
        w = Window.partitionBy("node").orderBy("id")
        firsts = copies.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1).groupBy("node").agg(F.collect_list("id").alias("ids"))
        firsts = materialize(firsts, "firsts")
        near = found.join(_small(firsts.withColumnRenamed("node", "nb"), _COPIES), "nb", "left").select("q", F.explode(F.coalesce("ids", F.array("nb"))).alias("nb"), "cos")
        near = near.unionByName(firsts.select(F.col("node").alias("q"), F.explode("ids").alias("nb"), F.lit(1.0).alias("cos")))
        members = copies.select(F.col("node").alias("q"), "id")
        found = near.join(_small(members, _COPIES), "q", "left").select(F.coalesce("id", "q").alias("q"), "nb", "cos").filter("q <> nb")
    return top_neighbours(found, k).select(F.col("q").alias(key), F.col("nb").alias("neighbour"), "cos")


def cells_of(packed: DataFrame, n: int, dims: int, overlap: int, shard_rows: int, sample: int) -> DataFrame:
    """(cell, id, v): the cells each of ``n`` vectors (id, v) is in."""
    return _placed(packed, grow(packed, n, dims, overlap, shard_rows, sample)[0], overlap, dims)


def grow(packed: DataFrame, n: int, dims: int, overlap: int, shard_rows: int, sample: int) -> tuple[Tree, dict[int, int]]:
    """The tree for ``n`` vectors (id, v), and the cells that it leaves with more than ``shard_rows`` members: how many, by the sample."""
    cells = max(1, min(-(-SPLIT * n * overlap // shard_rows), sample // 8))
    if n * overlap <= shard_rows:
        return Tree(np.zeros((1, dims))), {}
    rate = min(1.0, max(sample, -(-DRAWN * SPLIT * n // shard_rows)) / n)
    drawn = materialize(packed.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20)), "sample")
    rate = max(1, drawn.count()) / n
    rows = drawn.orderBy(F.xxhash64("id", F.lit(1))).limit(sample).collect()
    tree = Tree(fit_pivots(unit(np.frombuffer(b"".join(bytes(r.v) for r in rows), dtype=np.int8).reshape(len(rows), dims)), min(cells, len(rows))))
    for level in range(LEVELS + 1):
        routed = _placed(drawn, tree, overlap, dims)
        load = {r.cell: r.m for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > shard_rows * rate).collect()}
        subs = {c: -(-int(SPLIT * m / rate) // shard_rows) for c, m in load.items()}
        subs = {c: min(s, load[c]) for c, s in subs.items() if s <= sample // 8}  # a cell that the sample has too few pivots for stays whole
        room = min(1.0, (TREE - len(tree.pivots)) / max(1, sum(subs.values())))
        subs = {c: int(s * room) for c, s in subs.items() if s * room >= 2}
        if not subs or level == LEVELS:
            return tree, {c: int(m / rate) for c, m in load.items()}
        spark = packed.sparkSession
        # a cell's pivots are fitted in one task on at most ``sample`` of its members
        share = spark.createDataFrame([(c, s, min(1.0, min(sample, DRAWN * s) / load[c])) for c, s in subs.items()], "cell bigint, subs int, share double")
        some = routed.join(F.broadcast(share), "cell").filter(F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 20)) < F.col("share") * (1 << 20))

        def fit(table):
            x = unit(_matrix(table["v"], dims))
            c = fit_pivots(x, min(table["subs"][0].as_py(), len(x)))
            return pa.table({"cell": table["cell"][:1], "pivots": pa.array([c.astype(np.float16).tobytes()], pa.binary())})

        fitted = some.groupBy("cell").applyInArrow(fit, "cell bigint, pivots binary").collect()
        tree.split({r.cell: np.frombuffer(bytes(r.pivots), dtype=np.float16).reshape(-1, dims) for r in fitted})


def _placed(packed: DataFrame, tree: Tree, overlap: int, dims: int) -> DataFrame:
    """(cell, id, v): each vector (id, v) in the cells it ends in."""
    shared = packed.sparkSession.sparkContext.broadcast(tree)  # at most TREE rows of dims half floats

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = shared.value.route(unit(_matrix(b.column(1), dims)), overlap)
                r, c = np.nonzero(cells >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(cells[r, c]), b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r))], names=["cell", "id", "v"])

    return packed.mapInArrow(route, "cell bigint, id bigint, v binary")


def _salted(placed: DataFrame, left: dict[int, int]) -> DataFrame:
    """What cannot be split, in sub-shards: a member belongs to one of its cell's ``parts`` and asks in each, in blocks of questions."""
    parts = F.broadcast(placed.sparkSession.createDataFrame(list(left.items()), "cell bigint, parts int"))
    placed = placed.join(parts, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    visits = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (p == F.pmod(F.xxhash64("id", "cell"), "parts")).alias("owned")))
    asked = placed.select("id", "v", "cell", F.explode(visits).alias("x"), F.ceil(F.col("parts") / 8).cast("int").alias("blocks"))
    ask = F.pmod(F.xxhash64("cell", "id"), F.col("blocks")).cast("int")
    asked = asked.select("id", "v", "cell", "x.part", "x.owned", ask.alias("ask"), F.explode(F.when(F.col("x.owned"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(ask))).alias("block"))
    return asked.select("id", "v", "cell", "part", "block", "owned", (F.col("ask") == F.col("block")).alias("asks"))


def top_neighbours(df: DataFrame, k: int) -> DataFrame:
    """The k neighbours of the largest ``cos`` per ``q``, ties to the smaller ``nb``; equal rows count once."""
    w = Window.partitionBy("q").orderBy(F.col("cos").desc(), "nb")
    return df.withColumn("rn", F.dense_rank().over(w)).filter(F.col("rn") <= k).drop("rn").dropDuplicates(["q", "nb"])
