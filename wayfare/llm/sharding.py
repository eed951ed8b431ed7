"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that stays whole; groups lie in the order of 60 bits of the text's SHA-256. The smallest shard capacity is found by binary search; a capacity is checked greedily, each shard
taking groups as long as they fit. Then the cuts are made there.

Only bounded things reach the driver. Groups fall into SLICES slices by their hash; a first job returns bytes, number
and the largest group of each slice, with every group above 1 / HEAVY of all bytes as a slice of its own. With
that, a greedy cut is known up to one slice's largest group, which brackets the capacity and leaves a narrow window
around each cut. As long as the windows hold more than COLLECTED groups, their slices are cut finer by more bits of
the hash, and the bracket is drawn anew. Then the groups in the windows are returned, and the search ends exactly on
them. Only groups of nearly 1 / HEAVY of all bytes, many of them, would leave windows that no finer slices shrink:
they hold at most shards / HEAVY of the bytes.

Null text: 0 bytes, its rows are one group. An empty table gives an empty result. A shard may be empty
when there are fewer groups than shards. Rows with one id, and repeated rows, each have a slot of their own.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hashed, partitions, utf8_bytes

#: Bits of the hash of a text, and slices of its order: the top 12 of them. Null comes before all, as -1.
BITS = 60
SLICES = 4096
#: Groups above 1 / HEAVY of all bytes are slices of their own.
HEAVY = 1 << 14
#: Groups in the windows that are collected at once; above, their slices are cut by FINER more bits of the hash.
COLLECTED, FINER = 1 << 16, 6
#: Slices that a step of that may make.
MOST_SLICES = 1 << 19
#: A slice is salted into ranges of about 1 / (SPREAD * partitions) of the rows, and LEAST rows at least.
SPREAD, LEAST = 32, 256


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """First index of each shard after the first when each takes groups as long as they fit."""
    out, room = [], capacity
    for i, n in enumerate(sizes):
        if n > room:
            out.append(i)
            room = capacity
        room -= n
    return out


def minimax(sizes: list[int], shards: int) -> int:
    """The smallest capacity at which the groups, in this order, fit into the shards."""
    lo, hi = max(sizes, default=0), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        if len(greedy(sizes, mid)) < shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


class Order:
    """Known group boundaries of the prefix sums: all of them inside `known` ranges, and the ends of the slices."""

    def __init__(self, slices: list[tuple[int, int, int]]):
        """slices: (first hash, bytes, largest group) in order."""
        self.ends, total = [], 0
        for _, n, _ in slices:
            total += n
            self.ends.append(total)
        self.slices, self.total = slices, total
        self.fine: dict[int, tuple[list[int], list[int]]] = {}  # slice: (prefix sums after each group, hash of each group)

    def spread(self, capacity: int) -> list[tuple[int, int]]:
        """For each cut, the slices in which the greedy end of the shard lies at least and at most, by slices alone."""
        lo = hi = 0
        out = []
        while lo < self.total:
            a, b = lo + capacity, hi + capacity
            if a >= self.total:
                break
            i, j = bisect_right(self.ends, a), min(bisect_right(self.ends, b), len(self.ends) - 1)
            begin = self.ends[i - 1] if i else 0
            lo, hi = max(begin, a - self.slices[i][2] + 1), min(b, self.total)
            out.append((i, j))
        return out

    def cut_after(self, at: int) -> tuple[int, int, int]:
        """The last boundary at or before prefix sum `at`: (sum, slice, groups of the slice before it)."""
        i = bisect_right(self.ends, at)
        if i >= len(self.ends):
            return self.total, i, 0
        sums, _ = self.fine[i]
        k = bisect_right(sums, at)
        return (sums[k - 1] if k else (self.ends[i - 1] if i else 0)), i, k

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]] | None:
        """(slice, groups of it before the cut) of each cut, or None if more than `shards` shards come out."""
        at, out = 0, []
        while True:
            at, i, k = self.cut_after(at + capacity)
            if at >= self.total:
                return out
            out.append((i, k))
            if len(out) >= shards:
                return None


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Adds shard and slot to (doc_id, size, text_crc32, ...): whole groups of equal texts, the largest shard as small as the order allows."""
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_bytes("text") + 8).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNull(), -1).otherwise(hashed(F.col("text").cast("string"))).alias("h"),
    ).withColumn("slice", F.shiftright("h", BITS - 12).cast("int"))
    groups = cut(base.groupBy("slice", "h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, n_all = groups.agg(F.sum("bytes"), F.sum("n")).first()
    if not total:
        return base.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    heavy = total // HEAVY  # at most HEAVY groups are above
    big = {r["h"]: r["bytes"] for r in groups.where(F.col("bytes") > heavy).select("h", "bytes").collect()}
    small = groups.where(F.col("bytes") <= heavy)
    # light groups before, between and after the heavy ones of a slice
    if big:
        by = {}
        for h in sorted(big):
            by.setdefault(h >> (BITS - 12), []).append(h)
        marks = spark.createDataFrame(list(by.items()), "slice int, marks array<long>")
        small = small.join(F.broadcast(marks), "slice", "left").withColumn("rank", F.coalesce(F.size(F.filter("marks", lambda x: x < F.col("h"))), F.lit(0))).drop("marks")
    else:
        small = small.withColumn("rank", F.lit(0))

    def summed(df: DataFrame, bits: int) -> list[tuple]:
        """(first hash, bytes, largest group, groups, (bits, prefix, rank)) of the light groups by the first `bits` bits of their hash."""
        rows = df.groupBy(F.shiftright("h", BITS - bits).alias("prefix"), "rank").agg(F.min("h").alias("h"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"), F.count(F.lit(1)).alias("k")).collect()
        return [(r["h"], r["bytes"], r["most"], r["k"], (bits, r["prefix"], r["rank"])) for r in rows]

    def asked(slices: list[tuple]) -> list[tuple[int, DataFrame]]:
        """The light groups of some slices, by the bits of their prefix."""
        out = []
        for bits in sorted({k[4][0] for k in slices}):
            ask = spark.createDataFrame([k[4][1:] for k in slices if k[4][0] == bits], "a_prefix long, a_rank int")
            out.append((bits, small.join(F.broadcast(ask), (F.shiftright("h", BITS - bits) == F.col("a_prefix")) & (F.col("rank") == F.col("a_rank")))))
        return out

    keyed = sorted([*summed(small, 12), *((h, b, b, 1, None) for h, b in big.items())])
    while True:
        order = Order([k[:3] for k in keyed])
        lo, hi = max(max(k[2] for k in keyed), -(-total // shards)), total
        low, high = lo, hi
        while low < high:  # the smallest capacity that fits even if every cut lies as early as it can
            mid = (low + high) // 2
            if len(order.spread(mid)) < shards:
                high = mid
            else:
                low = mid + 1
        hi = low
        need: set[int] = set()
        for (a, _), (_, b) in zip(order.spread(lo), [*order.spread(hi), *[(0, len(keyed) - 1)] * shards], strict=False):
            need |= set(range(a, b + 1))
        wanted = [keyed[i] for i in sorted(need) if keyed[i][4] is not None]
        finer = [k for k in wanted if k[3] > 1 and k[4][0] < BITS]
        if sum(k[3] for k in wanted) <= COLLECTED or not finer or len(finer) << FINER > MOST_SLICES:
            break
        gone = {k[4] for k in finer}
        keyed = sorted([k for k in keyed if k[4] not in gone] + [x for bits, df in asked(finer) for x in summed(df, min(BITS, bits + FINER))])
    for i, k in enumerate(keyed):
        if k[4] is None:
            order.fine[i] = ([order.ends[i]], [k[0]])
    inside: dict[tuple, list[tuple[int, int]]] = {}
    for bits, df in asked(wanted):
        for r in df.select("a_prefix", "a_rank", "h", "bytes").collect():
            inside.setdefault((bits, r["a_prefix"], r["a_rank"]), []).append((r["h"], r["bytes"]))
    for i in need:
        if keyed[i][4] is not None:
            at, sums, hashes = order.ends[i - 1] if i else 0, [], []
            for h, b in sorted(inside[keyed[i][4]]):
                at += b
                sums.append(at)
                hashes.append(h)
            order.fine[i] = (sums, hashes)
    while lo < hi:
        mid = (lo + hi) // 2
        if order.cuts(mid, shards) is not None:
            hi = mid
        else:
            lo = mid + 1
    starts = []  # first hash of each shard after the first
    for i, k in order.cuts(lo, shards):
        starts.append(order.fine[i][1][k] if k < len(order.fine[i][1]) else keyed[i + 1][0])
    shard = sum((F.when(F.col("h") >= F.lit(s), 1).otherwise(0) for s in starts), F.lit(0)).cast("int")

    # slots: rows are counted by shard, slice and salt, the counts give offsets, and only ranges of bounded size are numbered
    share = groups.groupBy("slice").agg(F.sum("n").alias("rows")).select("slice", F.ceil(F.col("rows") / max(LEAST, n_all // (SPREAD * partitions(spark)))).cast("int").alias("salts"))
    rows = base.join(F.broadcast(share), "slice")  # SLICES rows
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.col("salts")).cast("int")).withColumn("shard", shard)
    key = ["shard", "slice", "salt"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("h", F.col("doc_id").asc_nulls_first(), "size"))
    return rows.withColumn("inside", inside).join(offsets, key).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("inside") - 1).cast("long").alias("slot"))
