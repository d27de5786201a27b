"""Evaluation passages inside a training corpus.

The items (a stated, small query set) are cut into windows of ``window`` words, or one window of all
words if an item is shorter.  Every window of the same length in every corpus document gets a 64-bit
SimHash; the item windows' fingerprints are indexed in ``radius + 1`` blocks of bits, so by the
pigeonhole principle every pair within the Hamming radius shares a block.  Hits are verified on the
words: weighted shingle similarity, where a shingle weighs as many letters as it holds, of at least
``min_similarity``; 1.0 asks for the same words in the same order.

The scan is map-only: there is no shuffle but the distinct over the few hits.  Item windows are
broadcast in blocks whose size is fixed by ``block_items``, and the corpus is read once a block: once for an
evaluation set of ordinary size; a larger set means more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import hash_words, words

WINDOW, RADIUS, SHINGLE = 12, 2, 5
BLOCK_ITEMS = 20_000
_STEP = 16_384


def simhashes(h: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every window of n word hashes (a bit is set where more than half of the words set it)."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    return _window_bits(_running(bits), n)


def _running(bits: np.ndarray) -> np.ndarray:
    total = np.zeros((len(bits) + 1, 64), dtype=np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=total[1:])  # wraps round; differences stay right
    return total


def _window_bits(total: np.ndarray, n: int) -> np.ndarray:
    votes = total[n:] - total[:-n]
    return np.packbits(votes > n // 2, axis=1).view(np.uint64).ravel()


def shingle_similarity(a: list[str], b: list[str], n: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the n-word shingles (of whole windows, where shorter)."""
    if a == b:
        return 1.0
    n = min(n, len(a), len(b))
    grams = [{tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (a, b)]
    weigh = lambda s: sum(sum(map(len, g)) for g in s)
    return weigh(grams[0] & grams[1]) / max(1, weigh(grams[0] | grams[1]))


class ItemIndex:
    """Fingerprints of item windows by length, findable by any of radius + 1 blocks."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int):
        self.radius = radius
        edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
        self.blocks = list(zip(edges, edges[1:]))
        by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            ws = words(text)
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1 if n else 0):
                by_length[n][tuple(ws[i : i + n])].add(item_id)
        self.lengths = {}
        for n, found in by_length.items():
            keys = list(found)
            fps = np.concatenate([simhashes(hash_words(list(k)), n) for k in keys])
            tables = []
            for lo, hi in self.blocks:
                v = self._part(fps, lo, hi)
                order = np.argsort(v, kind="stable")
                hit = np.zeros(1 << min(hi - lo, 22), dtype=bool)
                hit[v & np.uint64(len(hit) - 1)] = True
                tables.append((v[order], order, hit))
            self.lengths[n] = (keys, [sorted(found[k]) for k in keys], fps, tables)

    @staticmethod
    def _part(fps: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def candidates(self, n: int, fps: np.ndarray) -> set[tuple[int, int]]:
        """(window, item window) within the radius."""
        _, _, own, tables = self.lengths[n]
        out: set[tuple[int, int]] = set()
        for (lo, hi), (values, order, hit) in zip(self.blocks, tables):
            part = self._part(fps, lo, hi)
            at = np.flatnonzero(hit[part & np.uint64(len(hit) - 1)])
            first, last = np.searchsorted(values, part[at], "left"), np.searchsorted(values, part[at], "right")
            count = last - first
            if not count.sum():
                continue
            src = np.repeat(at, count)
            dst = order[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            near = np.bitwise_count(fps[src] ^ own[dst]) <= self.radius
            out.update(zip(src[near].tolist(), dst[near].tolist()))
        return out


def find_leaks(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, radius: int = RADIUS, min_similarity: float = 1.0, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """(key, item_key, similarity): every document that holds a window of an item, with its best similarity.

    Defined results: null, empty and word-less texts on either side match nothing; repeated item rows
    count once; a window never crosses documents; other columns are not read.
    """
    spark = corpus.sparkSession
    asked = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).filter("t is not null and i is not null").distinct()
    n_blocks = max(1, -(-asked.count() // block_items))
    narrow = corpus.select(key, text)
    kt, it = narrow.schema[0].dataType.simpleString(), asked.schema[0].dataType.simpleString()
    out = None
    for b in range(n_blocks):
        block = asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == b)
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in block.collect()], window, radius))
        hits = narrow.mapInArrow(_scanner(index, key, item_key, min_similarity), f"`{key}` {kt}, `{item_key}` {it}, similarity double")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy(key, item_key).agg(F.max("similarity").alias("similarity"))


def _scanner(index, key: str, item_key: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: ItemIndex = index.value
        for b in batches:
            ws: list[str] = []
            starts = [0]
            for t in b.column(1):
                ws += words(t.as_py())
                starts.append(len(ws))
            row_of = np.repeat(np.arange(b.num_rows), np.diff(starts))
            h = hash_words(ws)
            best: dict[tuple[int, int], float] = {}
            for s in range(0, len(h), _STEP):
                stop = min(len(h), s + _STEP + max(ix.lengths, default=1) - 1)
                total = _running(np.unpackbits(h[s:stop].view(np.uint8).reshape(-1, 8), axis=1))
                for n, (keys, ids, _, _) in ix.lengths.items():
                    if stop - s < n:
                        continue
                    for w, k in ix.candidates(n, _window_bits(total, n)):
                        at = s + w
                        row = row_of[at]
                        if row_of[at + n - 1] != row:
                            continue
                        sim = shingle_similarity(ws[at : at + n], list(keys[k]))
                        if sim >= least:
                            for i in ids[k]:
                                if sim > best.get((row, i), 0.0):
                                    best[row, i] = sim
            if best:
                rows = pa.array([r for r, _ in best], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([i for _, i in best]), pa.array(list(best.values()))], names=[key, item_key, "similarity"])

    return run


def brute_force(corpus: list[tuple], items: list[tuple], window: int = WINDOW) -> set[tuple]:
    """Reference for tests: exact consecutive words."""
    out = set()
    for i, t in items:
        ws = words(t)
        n = min(window, len(ws))
        wins = {" " + " ".join(ws[j : j + n]) + " " for j in range(len(ws) - n + 1)} if n else set()
        for d, text in corpus:
            whole = " " + " ".join(words(text)) + " "
            if any(w in whole for w in wins):
                out.add((d, i))
    return out
