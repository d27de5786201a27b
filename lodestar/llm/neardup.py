"""Near-duplicate texts by one-permutation hashing.

1. Equal word sequences are one class, named by a hash of the words; a task sends a class's bands
   once, and every later step works on classes, so copies cost next to nothing.
2. A class's word shingles are hashed once, the hash range is cut into ``bins``, and the
   minimum of each bin is kept.  Empty bins borrow from non-empty ones by optimal densification: an
   empty bin probes bins by a universal hash of (bin, attempt), so donors are independent and the
   collision chance of a bin equals the Jaccard similarity.
3. ``rows`` bins at a time form a band; equal bands share a bucket.
4. A bucket yields star-shaped edges only: every member to the bucket's smallest and largest key.
   Edges are linear in the bucket's size; both centres are streaming aggregates over the exchange
   that also feeds the join.  Of a bucket that is hot within a batch of rows (``HOT`` classes) only the batch's smallest
   and largest key are exchanged; its other members are held back and get the whole bucket's centres by a join of their own,
   so a bucket that holds a third of all texts reaches its task as two rows a batch, and none of its members is lost.
5. Edges are verified on the exact shingle sets.  Stars, however weak, are then closed over two hops, so any two members of a bucket are compared:
   leaves of one centre are compared if what is known of them allows it: Jaccard distance is a
   metric, so |d(x) - d(y)| bounds d(x, y) from below, and the sizes of the sets and of what they share with the
   centre bound what they can share.  The pairs of a centre's leaves are dealt out to many tasks.

With 84 bins in 28 bands of 3, a pair of similarity 0.6 shares a bucket with probability
1 - (1 - 0.6^3)^28 = 0.9989, one of 0.8 with 1 - 1e-9; pairs missed there are found over two hops if
they have a common neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import _M1, hash_words, mix, shingle_hashes, words
from lodestar.runtime import materialize

BINS, ROWS = 84, 3
#: Classes a task remembers to send their bands once; only a saving.
_SEEN = 500_000
#: A bucket of so many classes in one batch of rows sends on only the batch's centres; the others meet the bucket's centres where they are.
HOT = 64
#: Leaves of a centre that a task meets at once.
_LEAVES = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(hashes: np.ndarray, doc: np.ndarray, n_docs: int, bins: int = BINS) -> np.ndarray:
    """One-permutation signatures (n_docs x bins); every document must have a shingle."""
    h = mix(hashes * _M1)
    sig = np.full(n_docs * bins, _EMPTY, dtype=np.uint64)
    at = doc * bins + ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
    np.minimum.at(sig, at, h)
    sig = sig.reshape(n_docs, bins)
    full = sig != _EMPTY
    docs, holes = np.nonzero(~full)
    out = sig.copy()
    attempt = 0
    while len(docs):
        attempt += 1
        if attempt > 40 * bins:  # cannot matter in practice; keeps the loop finite
            out[docs, holes] = sig[docs].min(axis=1)
            break
        donor = (mix((holes.astype(np.uint64) + np.uint64(1)) * _M1 + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        ok = full[docs, donor]
        out[docs[ok], holes[ok]] = sig[docs[ok], donor[ok]]
        docs, holes = docs[~ok], holes[~ok]
    return out


def bands(sig: np.ndarray, salt: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Bucket ids (n_docs x bands)."""
    n = sig.shape[1] // rows
    out = np.empty((len(sig), n), dtype=np.uint64)
    for b in range(n):
        acc = salt + np.uint64(b)
        for r in range(rows):
            acc = mix(acc * _M1 + sig[:, b * rows + r])
        out[:, b] = acc
    return out


def _node(kind: str, h: np.ndarray) -> int:
    """Class of a word sequence: a signed 64-bit hash, salted with the kind."""
    return xxhash.xxh3_64_intdigest(h.tobytes(), xxhash.xxh3_64_intdigest(kind.encode())) - (1 << 63)


def _thin(flat: np.ndarray, nodes: np.ndarray, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch's buckets (one row of ``flat`` a node) those entries that are sent on, and the star edges of hot buckets."""
    keep = np.ones(flat.shape, dtype=bool)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    edges = []
    if (counts >= hot).any():
        inverse = inverse.reshape(flat.shape)
        r, c = np.nonzero(counts[inverse] >= hot)
        order = np.lexsort((nodes[r], inverse[r, c]))
        r, c = r[order], c[order]
        group = inverse[r, c]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        last = np.concatenate([group[1:] != group[:-1], [True]])
        keep[r, c] = first | last
        at = np.cumsum(first) - 1
        lo, hi = nodes[r[first]][at], nodes[r[last]][at]
        n = nodes[r]
        edges = np.concatenate([np.stack([lo, n], 1)[lo < n], np.stack([n, hi], 1)[n < hi]])
    return keep, np.unique(edges, axis=0) if len(edges) else np.empty((0, 2), dtype=np.int64)


def _featurise(shingle: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # bands are needed once a class; a task sends them once for those it remembers
        for b in batches:
            keep, nodes, fresh, hs = [], [], [], []
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2))):
                h = hash_words(words(t.as_py()))
                if len(h) >= shingle:
                    n = _node(k, h)
                    keep.append(i)
                    nodes.append(n)
                    fresh.append(n not in seen)
                    if fresh[-1]:
                        hs.append((k, shingle_hashes(h, shingle)))
                        if len(seen) >= _SEEN:
                            seen.clear()
                        seen.add(n)
            if not keep:
                continue
            taken = pa.array(keep, pa.int64())
            size, held = np.zeros((2, len(keep)), dtype=np.int64)
            hot = np.empty(0, dtype=np.uint64)
            flat = np.empty(0, dtype=np.uint64)
            if hs:
                salts = {k: np.uint64(xxhash.xxh3_64_intdigest(k.encode())) for k in {k for k, _ in hs}}
                sig = signatures(np.concatenate([x for _, x in hs]), np.repeat(np.arange(len(hs)), [len(x) for _, x in hs]), len(hs), bins)
                flat = bands(sig, np.array([salts[k] for k, _ in hs], dtype=np.uint64), rows)
                sent, _ = _thin(flat, np.array(nodes, dtype=np.int64)[np.array(fresh)])
                size[np.array(fresh)], held[np.array(fresh)] = sent.sum(1), (~sent).sum(1)
                flat, hot = flat[sent], flat[~sent]
            lists, rest = (pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(v.view(np.int64))) for n, v in ((size, flat), (held, hot)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(nodes, pa.int64()), lists, rest], names=["kind", "key", "node", "bands", "hot"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, parts, nodes = [0], [], []
            for k, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = hash_words(words(t.as_py()))
                if len(h) >= shingle and _node(k, h) == n:
                    nodes.append(n)
                    parts.append(np.unique(shingle_hashes(h, shingle)))
                    ends.append(ends[-1] + len(parts[-1]))
            flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "s"])

    return run


def _small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A materialised table, to be broadcast only if it is counted to be small; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


class NearDuplicates:
    """The result for one input: ``links`` (a, b, similarity) between classes of equal word sequences, and who is in them.

    Defined results: texts with fewer than ``shingle`` words (null and empty ones too) have no class
    and no links; equal word sequences are one class; rows with a null key or kind are ignored; equal
    rows count once; other columns are not read; an empty table gives empty results.

    A class is named by a 64-bit hash of its words; among a billion different texts, two share one
    with a chance of three in a hundred.
    """

    def __init__(self, texts: DataFrame, shingle: int = 5, least: float = 0.8, bins: int = BINS, rows: int = ROWS):
        texts = texts.select(F.col("kind").cast("string").alias("kind"), F.col("key").cast("bigint").alias("key"), F.col("text").cast("string").alias("text")).filter("key is not null and kind is not null and text is not null")
        feats = materialize(texts.mapInArrow(_featurise(shingle, bins, rows), "kind string, key bigint, node bigint, bands array<bigint>, hot array<bigint>"), "oph")
        self.rows = feats.select("kind", "key", "node").distinct()
        # one exchange on the bucket serves the centres and the join with them
        in_bucket = feats.select(F.explode("bands").alias("h"), "node").repartition("h")
        stars = in_bucket.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
        met = in_bucket.join(stars, "h").select("lo", "node", "hi")
        # the members of hot buckets that stayed behind get the centres of the whole bucket where they are
        hot = materialize(feats.select(F.explode("hot").alias("h")).distinct(), "hot")
        if not hot.isEmpty():
            ends = feats.select(F.explode("bands").alias("h"), "node").join(_small(hot), "h").groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
            met = met.unionByName(feats.select(F.explode("hot").alias("h"), "node").join(_small(materialize(ends, "hot-centres")), "h").select("lo", "node", "hi"))
        edges = (
            met.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a < b")
            .distinct()
        )
        edges = materialize(edges, "stars")
        ends = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        asked = materialize(feats.select("kind", "key", "node").join(_small(ends), "node").groupBy("kind", "node").agg(F.min("key").alias("key")), "asked")
        self.sets = materialize(texts.join(_small(asked), ["kind", "key"]).select("kind", "node", "text").mapInArrow(_sets(shingle), "node bigint, s array<bigint>"), "sets")
        near = materialize(self._verify(edges, 0.0), "verified")
        side = lambda u, x, n: near.select(F.col(u).alias("u"), F.col(x).alias("x"), "j", "c", F.col(n).alias("n"))
        both = side("a", "b", "nb").unionByName(side("b", "a", "na"))
        # a centre of many leaves is met in pieces: every leaf of a piece with every leaf of another, each such couple of pieces a task's work
        pieces = materialize(both.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / _LEAVES).cast("int").alias("p")), "centres")
        leaves = both.join(pieces, "u").withColumn("mine", F.pmod(F.xxhash64("x", "u"), "p").cast("int"))
        left = leaves.select("u", "x", "j", "c", "n", "mine", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("other"))
        right = leaves.select("u", F.col("x").alias("y"), F.col("j").alias("k"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("mine").alias("other"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("mine"))
        # at most so many shingles can be shared: within the centre's set and beside it
        most = F.least("c", "d") + F.least(F.col("n") - F.col("c"), F.col("m") - F.col("d"))
        hop = (
            left.join(right, ["u", "mine", "other"])
            .filter((F.col("x") < F.col("y")) & (F.abs(F.col("j") - F.col("k")) <= 1 - least + 1e-9) & (most >= (least - 1e-9) * (F.col("n") + F.col("m") - most)))
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
            .join(edges, ["a", "b"], "left_anti")
        )
        links = near.filter(F.col("j") >= least - 1e-9).unionByName(self._verify(hop, least - 1e-9)).select("a", "b", "j")
        self.links = materialize(links.withColumnRenamed("j", "similarity"), "links")

    def _verify(self, pairs: DataFrame, least: float) -> DataFrame:
        a = self.sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
        b = self.sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        j = common / (F.size("sa") + F.size("sb") - common)
        return pairs.join(a, "a").join(b, "b").select("a", "b", j.alias("j"), common.alias("c"), F.size("sa").alias("na"), F.size("sb").alias("nb")).filter(F.col("j") >= least).dropDuplicates(["a", "b"])

    def pairs(self) -> DataFrame:
        """(kind, a, b): every pair of rows, copies included.  As large as the number of such pairs."""
        r = self.rows
        across = (
            r.select("kind", F.col("key").alias("ka"), F.col("node").alias("a"))
            .join(_small(self.links.select("a", "b")), "a")
            .join(r.select("kind", F.col("key").alias("kb"), F.col("node").alias("b")), ["kind", "b"])
            .filter(F.col("ka") != F.col("kb"))
            .select("kind", F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
        )
        copied = r.groupBy("kind", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", "node")
        inside = materialize(r.join(copied, ["kind", "node"], "left_semi"), "copies")
        same = inside.select("kind", "node", F.col("key").alias("a")).join(inside.select("kind", "node", F.col("key").alias("b")), ["kind", "node"]).filter("a < b").select("kind", "a", "b")
        return across.unionByName(same).distinct()

    def members(self) -> DataFrame:
        """(kind, key, rep, links): one row per text: the smallest key of its class, and how many other classes are linked."""
        n = self.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        c = self.rows.groupBy("kind", "node").agg(F.min("key").alias("rep"))
        return self.rows.join(c.join(n, "node", "left"), ["kind", "node"]).select("kind", "key", "rep", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def brute_force(texts: list[tuple], shingle: int, least: float) -> set[tuple]:
    """Reference for tests: rows of (kind, key, text)."""
    sets = []
    for kind, key, t in texts:
        w = words(t)
        if len(w) >= shingle:
            sets.append((kind, key, {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}, w))
    return {(x[0], min(x[1], y[1]), max(x[1], y[1])) for i, x in enumerate(sets) for y in sets[:i] if x[0] == y[0] and x[1] != y[1] and (x[3] == y[3] or len(x[2] & y[2]) / len(x[2] | y[2]) >= least - 1e-9)}
