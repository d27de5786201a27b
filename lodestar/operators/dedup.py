"""Exact and order-dependent near duplicates of pages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import normalize, split_words


def exact_dedup(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row by ``order`` of every normalised text.  The text's hash is shuffled, not the text; equal hashes are told apart by length."""
    n = normalize(F.coalesce(F.col(text), F.lit("")))
    marked = df.withColumn("_h", F.md5(n.cast("binary"))).withColumn("_l", F.length(n))
    w = Window.partitionBy("_h", "_l").orderBy(order)
    return marked.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_h", "_l", "_rn")


def _fnv64(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode("utf-8"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def simhash_words(words: list[str], memo: dict[str, int]) -> int:
    """Bits set by the majority of the words' hashes; 0 without words."""
    if not words:
        return 0
    hs = np.fromiter((memo[w] if w in memo else memo.setdefault(w, _fnv64(w)) for w in words), dtype=np.uint64, count=len(words))
    bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return int(np.packbits(bits * 2 > len(words), bitorder="little").view(np.uint64)[0])


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sig): 64-bit SimHash over the normalised words, as a signed number."""
    src = df.select(key, split_words(normalize(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    kt = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            if len(memo) > 500_000:
                memo.clear()
            sig = np.array([simhash_words(w.as_py(), memo) for w in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig)], names=[key, "sig"])

    return src.mapInArrow(run, f"`{key}` {kt}, sig bigint")


def near_dedup(sigs: DataFrame, key: str, radius: int = 3, bits: int = 16) -> DataFrame:
    """Rows kept when, in key order within the bucket of the top ``bits`` bits, no kept row is within ``radius``.

    The kept set depends on order, so a bucket is one sequential scan; equal signatures are collapsed
    to their first key before the buckets are formed, which bounds a bucket by its distinct
    signatures and keeps copies out of it.  Buckets of one need no scan and stay out of Python.
    """
    kt = sigs.schema[key].dataType.simpleString()
    first = sigs.groupBy("sig").agg(F.min(key).alias(key)).withColumn("bucket", F.shiftrightunsigned("sig", 64 - bits))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        s = pdf["sig"].to_numpy().view(np.uint64)
        kept = np.empty(len(s), dtype=np.uint64)
        n, keep = 0, np.zeros(len(s), dtype=bool)
        for i, x in enumerate(s):
            if not n or np.bitwise_count(kept[:n] ^ x).min() > radius:
                kept[n] = x
                n, keep[i] = n + 1, True
        return pdf.loc[keep, [key, "sig"]]

    sized = first.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    alone = sized.filter("n = 1").select(key, "sig")
    return alone.unionByName(sized.filter("n > 1").drop("n").groupBy("bucket").applyInPandas(greedy, f"`{key}` {kt}, sig bigint"))


def near_pairs(sigs: DataFrame, key: str, radius: int = 3, agree: int = 3) -> DataFrame:
    """(a, b, distance) of distinct signatures within the radius.

    The bits are cut into radius + ``agree`` blocks: within the radius ``agree`` of them are equal, so pairs meet in the
    bucket of one choice of blocks.  With three blocks of about eleven bits a bucket's key has 32 bits, and buckets
    stay small among billions of signatures.
    """
    first = sigs.groupBy("sig").agg(F.min(key).alias(key))
    n = radius + agree
    cuts = [64 * i // n for i in range(n + 1)]
    value = lambda i: F.shiftrightunsigned("sig", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    choices = list(combinations(range(n), agree))
    buckets = F.array(*[F.xxhash64(F.lit(k), *[value(i) for i in c]) for k, c in enumerate(choices)])
    x = first.select(key, "sig", F.explode(buckets).alias("b"))
    a, b = x.select(F.col(key).alias("a"), F.col("sig").alias("sa"), "b"), x.select(F.col(key).alias("c"), F.col("sig").alias("sb"), "b")
    d = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    return a.join(b, "b").filter(F.col("a") < F.col("c")).withColumn("distance", d).filter(F.col("distance") <= radius).select("a", F.col("c").alias("b"), "distance").distinct()
