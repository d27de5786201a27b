"""One ranking from scores on different scales, by leximin.

Each score becomes the percentile of the item's place within its group: ``1 - (place - 1) / n`` where
``place`` is the number of items that are strictly better plus one, so ties share their place and
neither range nor distribution matters.  An item's percentiles are sorted ascending and the vectors
compared lexicographically, largest first: an item is as good as its weakest score, then its second
weakest, and so on.

Groups of ordinary size are ranked by window functions over one shuffle on the group key.  Groups
above ``hot_rows`` rows would put one task to work for all; their places are computed from value
blocks instead (distinct values are pre-aggregated map-side, cut into ranges, and block offsets are
prefix sums), which gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.runtime import materialize

HOT_ROWS = 2_000_000
#: Values of a score that are common enough to be looked up by broadcast: more than one in so many rows.
SHARED = 10_000


def latest(df: DataFrame, keys: list[str], stamp: str, tie: list[str]) -> DataFrame:
    """The row with the largest stamp per key; equal stamps are settled by the hash of ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.col(stamp).desc_nulls_last(), F.xxhash64(*tie))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _clean(c: str):
    """Null and NaN become -inf: below every value."""
    d = F.col(c).cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(float("-inf"))).otherwise(d)


def leximin(df: DataFrame, group: str, item: str, scores: list[str], hot_rows: int = HOT_ROWS, sizes_from: DataFrame | None = None) -> DataFrame:
    """(group, item, percentiles): each item's percentiles, ascending.

    ``sizes_from`` may name a cheaper table whose group sizes are at least those of ``df`` (the raw
    rows before de-duplication); it only decides which groups take the block path.

    Defined results: a null or NaN score stands below every value; a group of one gets percentile 1
    everywhere; null group keys form one group; an empty table gives an empty table; columns other than those named are not read.
    """
    cold, hot = _split(df, group, item, scores, hot_rows, sizes_from)
    out = cold if hot is None else cold.unionByName(hot)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "percentiles")


def leximin_top(df: DataFrame, group: str, item: str, scores: list[str], k: int | None = None, hot_rows: int = HOT_ROWS, sizes_from: DataFrame | None = None) -> DataFrame:
    """leximin() with ``place`` per group, 1 being best and equal vectors ordered by item.

    With ``k`` only the first k: the window is then rank-limited, and a task sends on k rows a group.  Without, huge
    groups are put in order by range partitions and numbered across them.
    """
    cold, hot = _split(df, group, item, scores, hot_rows, sizes_from)
    w = Window.partitionBy("g").orderBy(F.col("percentiles").desc(), F.col("i"))
    if k is not None:
        every = cold if hot is None else cold.unionByName(hot)
        out = every.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    else:
        out = cold.withColumn("place", F.row_number().over(w))
        if hot is not None:
            out = out.unionByName(_numbered(hot))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "percentiles", "place")


def _split(df: DataFrame, group: str, item: str, scores: list[str], hot_rows: int, sizes_from: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(g, i, percentiles) of ordinary groups and of huge ones."""
    m = len(scores)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *[_clean(c).alias(f"s{k}") for k, c in enumerate(scores)])
    sizes = (sizes_from or df).groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > hot_rows)
    vec = F.sort_array(F.array(*[1 - (F.col(f"r{k}") - 1) / F.col("n") for k in range(m)])).alias("percentiles")
    if hot.isEmpty():
        return _places_by_window(rows, m).select("g", "i", vec), None
    hot = hot.select(F.col("g").alias("hg"))
    cold_rows = rows.join(hot, rows.g.eqNullSafe(F.col("hg")), "left_anti")
    hot_part = rows.join(hot, rows.g.eqNullSafe(F.col("hg")), "left_semi")
    return _places_by_window(cold_rows, m).select("g", "i", vec), _places_by_blocks(hot_part, m).select("g", "i", vec)


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``place`` per g, by sorted ranges of (g, percentiles, i): a row's number is its place in its range plus the rows of earlier ranges."""
    order = [F.col("g").asc_nulls_first(), F.col("percentiles").desc(), F.col("i")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = materialize(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    whole = at.join(F.broadcast(offset), "_p").withColumn("_no", F.col("_off") + F.col("_k"))  # one row a partition
    first = whole.groupBy(F.col("g").alias("_g")).agg(F.min("_no").alias("_first"))
    out = whole.join(first, whole.g.eqNullSafe(F.col("_g")))
    return out.select("g", "i", "percentiles", (F.col("_no") - F.col("_first") + 1).cast("int").alias("place"))


def _places_by_window(rows: DataFrame, m: int) -> DataFrame:
    out = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    for k in range(m):
        out = out.withColumn(f"r{k}", F.rank().over(Window.partitionBy("g").orderBy(F.col(f"s{k}").desc())))
    return out


def _places_by_blocks(rows: DataFrame, m: int, blocks: int = 1024) -> DataFrame:
    """Places of huge groups: no task ever holds more than a block of distinct values."""
    rows = materialize(rows, "hot")
    heavy = max(1, rows.count() // SHARED)
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = rows.join(n, rows.g.eqNullSafe(n.g)).drop(n.g)
    for k in range(m):
        s = f"s{k}"
        hist = rows.groupBy("g", s).agg(F.count(F.lit(1)).alias("c"))
        cuts = hist.groupBy("g").agg(F.percentile_approx(s, F.array(*[F.lit(j / blocks) for j in range(1, blocks)]), 10_000).alias("cuts"))
        h = hist.join(cuts, hist.g.eqNullSafe(cuts.g)).drop(cuts.g)
        h = h.withColumn("b", F.aggregate("cuts", F.lit(0), lambda a, x: a + (x < F.col(s)).cast("int"))).drop("cuts")
        per = h.groupBy("g", "b").agg(F.sum("c").alias("bc"))
        wb = Window.partitionBy("g").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("above", F.coalesce(F.sum("bc").over(wb), F.lit(0)))  # at most `blocks` rows a group
        wv = Window.partitionBy("g", "b").orderBy(F.col(s).desc()).rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("within", F.coalesce(F.sum("c").over(wv), F.lit(0)))
        ranks = h.join(per, h.g.eqNullSafe(per.g) & (h.b == per.b)).select(h.g.alias("hg"), F.col(s).alias("hv"), (F.col("above") + F.col("within") + 1).cast("int").alias(f"r{k}"), "c")
        # a value that many rows share (a signal that is missing) is looked up by broadcast, at most SHARED of them a score
        often = materialize(ranks.filter(F.col("c") > heavy).drop("c"), "often")
        match = lambda t: out.g.eqNullSafe(F.col("hg")) & (F.col(s) == F.col("hv"))  # noqa: B023, E731
        common = out.join(F.broadcast(often), match(often)).drop("hg", "hv")
        others = out.join(F.broadcast(often), match(often), "left_anti").join(ranks.filter(F.col("c") <= heavy).drop("c"), match(ranks)).drop("hg", "hv")
        out = common.unionByName(others)
    return out.select("g", "i", *[f"s{k}" for k in range(m)], "n", *[f"r{k}" for k in range(m)])


def brute_force(rows: list[tuple], m: int) -> dict:
    """Reference for tests: rows of (group, item, s0..), returns {group: [items best first]}."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for g, rs in groups.items():
        val = lambda x: float("-inf") if x is None or x != x else x
        vec = {r[1]: sorted(1 - sum(val(o[2 + k]) > val(r[2 + k]) for o in rs) / len(rs) for k in range(m)) for r in rs}
        out[g] = sorted(vec, key=lambda i: ([-x for x in vec[i]], i))
    return out
