"""Byte-level BPE encoding of a whole corpus with a public vocabulary.

The text is cut by the tokenizer's own pattern; every piece is encoded once and remembered in a
bounded per-process table, so the merge loop runs per distinct piece, not per occurrence.

Merging keeps two contiguous lists per piece: the part boundaries and the rank of each pair of
adjacent parts.  It scans the ranks for the minimum, deletes the boundary between the two parts and
refreshes the ranks of the two neighbouring pairs, until no pair has a rank.  Pieces longer than
``LONG`` bytes (a pasted key, a run of one character) use a heap over the same boundaries, so that
they cost n log n instead of n squared; both give the same parts.

The vocabulary file is read on the driver, its size is checked, and it is broadcast.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LONG = 256
#: Remembered pieces per Python worker; the table is emptied when full.
CACHE_PIECES = 300_000
MAX_VOCAB_BYTES = 64 << 20
#: Fixed: the pre-tokenisation pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the published pattern understands it (Unicode White_Space), for the coarse cut.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def default_vocab() -> str:
    """Place of the 50k byte-level vocabulary: LODESTAR_TOKENIZERS, else the installed module."""
    folder = os.environ.get("LODESTAR_TOKENIZERS")
    if folder:
        return os.path.join(folder, "byte_bpe_50k.tiktoken")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)}


def merge_parts(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by the rank-array method."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG:
        return _merge_long(piece, ranks)
    none = 1 << 62
    get = ranks.get
    cuts = list(range(len(piece) + 1))
    pair = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        del cuts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pair[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap: left-most pair of the lowest rank first."""
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), [i + 1 for i in range(n)]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Encoder(dict):
    """Remembered ids of coarse pieces (an optional space and a run without white space)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, capacity: int = CACHE_PIECES):
        import regex

        super().__init__()
        self.ranks, self.fine, self.capacity = ranks, regex.compile(pattern), capacity

    def __missing__(self, piece: str) -> list[int]:
        ids = [i for p in self.fine.findall(piece) for i in merge_parts(p.encode("utf-8", "replace"), self.ranks)]
        if len(piece) <= 64:
            if len(self) >= self.capacity:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for piece in _COARSE.findall(text):
            out += self[piece]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encode_column(df: DataFrame, key: str, text: str, vocab: str | None = None, out: str = "ids") -> DataFrame:
    """(key, ids): one row per row of ``df``, ids of its whole text without special tokens.

    Defined results: empty and null texts give the empty list; text that spells a special token is
    ordinary text; repeated rows are encoded each; only the two named columns are read.  A lone
    surrogate, which valid UTF-8 cannot hold, would be encoded as "?".
    """
    spark: SparkSession = df.sparkSession
    vocab = vocab or default_vocab()
    size = os.path.getsize(vocab)
    if size > MAX_VOCAB_BYTES:
        raise ValueError(f"{vocab} has {size} bytes; at most {MAX_VOCAB_BYTES} are broadcast")
    with open(vocab, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    mark = f"{vocab}:{size}:{os.path.getmtime(vocab)}"
    narrow = df.select(key, text)
    key_type = narrow.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(mark)
        if enc is None:
            enc = _ENCODERS[mark] = Encoder(parse_ranks(shared.value))
        for b in batches:
            texts = b.column(1)
            start = 0
            while start < b.num_rows:  # rows are grouped so that one output batch stays small
                flat: list[int] = []
                ends = [0]
                stop = start
                while stop < b.num_rows and len(flat) < 2_000_000:
                    t = texts[stop].as_py()
                    if t:
                        for piece in _COARSE.findall(t):
                            flat += enc[piece]
                    ends.append(len(flat))
                    stop += 1
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), ids], names=[key, out])
                start = stop

    return narrow.mapInArrow(run, f"`{key}` {key_type}, `{out}` array<int>")
