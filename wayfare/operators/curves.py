"""Distances of point sequences, for many pairs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _written


def _padded(lists: list, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Points as one array of (pair, position, coordinate), and the lengths."""
    size = np.array([len(x) for x in lists], np.int64)
    out = np.zeros((len(lists), max(1, most), 2))
    for i, x in enumerate(lists):
        if len(x):
            out[i, : len(x)] = [(p["x"], p["y"]) for p in x]
    return out, size


def distances(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Warping distance (cost of the cheapest alignment over the sum of lengths) and discrete Frechet distance of each pair; nan if one is empty."""
    x, n = _padded(a, max(map(len, a), default=0))
    y, m = _padded(b, max(map(len, b), default=0))
    return _measured(x, n, y, m)


def _measured(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    warp = np.full((len(x), x.shape[1], y.shape[1]), np.inf)
    leash = np.full_like(warp, np.inf)
    for i in range(x.shape[1]):
        d = np.linalg.norm(x[:, i, None] - y, axis=2)
        for j in range(y.shape[1]):
            before = [(i - p, j - q) for p, q in ((1, 0), (0, 1), (1, 1)) if i >= p and j >= q]
            if before:
                warp[:, i, j] = d[:, j] + np.min([warp[:, p, q] for p, q in before], axis=0)
                leash[:, i, j] = np.maximum(d[:, j], np.min([leash[:, p, q] for p, q in before], axis=0))
            else:
                warp[:, 0, 0] = leash[:, 0, 0] = d[:, 0]
    rows, some = np.arange(len(x)), (n > 0) & (m > 0)
    last = rows, np.maximum(n - 1, 0), np.maximum(m - 1, 0)
    return np.where(some, warp[last] / np.maximum(n + m, 1), np.nan), np.where(some, leash[last], np.nan)


def hausdorff(a: list, b: list) -> np.ndarray:
    """Largest distance of a point of either sequence to the other sequence, by pair; nan if one is empty."""
    x, n = _padded(a, max(map(len, a), default=0))
    y, m = _padded(b, max(map(len, b), default=0))
    d = np.linalg.norm(x[:, :, None] - y[:, None], axis=3)
    here, there = np.arange(x.shape[1])[None] < n[:, None], np.arange(y.shape[1])[None] < m[:, None]
    from_a = np.where(there[:, None, :], d, np.inf).min(axis=2)
    from_b = np.where(here[:, :, None], d, np.inf).min(axis=1)
    worst = np.maximum(np.where(here, from_a, -np.inf).max(axis=1), np.where(there, from_b, -np.inf).max(axis=1))
    return np.where((n > 0) & (m > 0), worst, np.nan)


def compared(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with dtw, frechet and hausdorff of the point arrays `a` and `b` (structs of x and y), of which neither is longer than its caller resampled it to."""

    def measure(batches):
        for p in batches:
            for lo in range(0, len(p), 512):
                own = p.iloc[lo : lo + 512]
                warp, leash = distances(list(own["a"]), list(own["b"]))
                far = hausdorff(list(own["a"]), list(own["b"]))
                yield own[keep].assign(dtw=pd.array(warp, "Float64"), frechet=pd.array(leash, "Float64"), hausdorff=pd.array(far, "Float64"))

    fields = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep)
    return pairs.select(*keep, "a", "b").mapInPandas(measure, f"{fields}, dtw double, frechet double, hausdorff double")


KEY = ["o", "d", "bin"]
#: Shapes of one side that meet at once in a worker.
BLOCK = 1 << 15
#: Pairs that are bounded at once, and cells of distance tables that are filled at once.
BOUNDS, CELLS = 1 << 18, 1 << 16
#: The first run of synthetic shapes and the longest; each is twice as long as the one before.
FIRST, LONGEST = 64, 4096
#: Lines of the grid to whose centres a run's distances are kept.
GRID = 32
#: Room for rounding where a bound is held against a distance, and for sums of single precision.
SLACK, SINGLE = 1 + 1e-12, 1 - 1e-5


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of all lists of a column, where each list begins, and its number of points."""
    own = column.combine_chunks()
    at = own.offsets.to_numpy().astype(np.int64)
    return own.values.to_numpy(zero_copy_only=False), at[:-1], np.diff(at) // 2


def _laid(values: np.ndarray, at: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """(coordinate, position, list), with zeros behind the shorter lists."""
    out = np.zeros((2, most, len(at)))
    for i in range(most):
        has = np.flatnonzero(size > i)
        for c in (0, 1):
            out[c, i, has] = values[at[has] + 2 * i + c]
    return out


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2)


def _centres(y: np.ndarray, size: np.ndarray, lines: int):
    """A grid over the lists of y, which come by size: its centres, each centre's least distance to each list (rounded down), and the cells of points."""
    low = np.array([c[np.arange(y.shape[1])[:, None] < size].min() for c in y])
    high = np.array([c[np.arange(y.shape[1])[:, None] < size].max() for c in y])
    wide = np.maximum(high - low, 1e-300) / lines
    at = (np.indices((lines, lines)).reshape(2, -1) + 0.5) * wide[:, None] + low[:, None]
    near = np.full((lines * lines, y.shape[2]), np.inf)
    for j in range(y.shape[1]):
        longer = np.searchsorted(size, j, side="right")
        near[:, longer:] = np.minimum(near[:, longer:], _between(at[:, :, None], y[:, j, None, longer:]))

    def cells(x: np.ndarray) -> np.ndarray:
        row, col = (np.clip((c - lo) / w, 0, lines - 1).astype(np.int64) for c, lo, w in zip(x, low, wide, strict=True))
        return row * lines + col

    return at, (near * (1 - 1e-6)).astype(np.float32), cells


def _aligned(x, y, m, warp_bound, leash_bound):
    """(pairs, warp, leash): the cheapest sum and the least maximum over the alignments of the pairs of which one may be within its bound; the others are left once neither can.

    x and y are (coordinate, position, pair), all of x as long as its array and y of m points. Any alignment meets the
    first points, the last points, and each point at its least distance to the other list.
    """
    of, n = np.arange(len(m)), x.shape[1]
    d = _between(x[:, :, None], y[:, None])
    has = np.arange(d.shape[1])[:, None] < m
    rows, cols = np.where(has, d, np.inf).min(axis=1), np.where(has, d.min(axis=0), 0)
    lengths = np.maximum(rows.max(axis=0), cols.max(axis=0))
    cols[0] = cols[m - 1, of] = 0
    ends = d[0, 0] + np.where(m + n > 2, d[n - 1, m - 1, of], 0)
    of = np.flatnonzero(~((ends + np.maximum(rows[1:-1].sum(axis=0), cols.sum(axis=0)) > warp_bound) & (lengths > leash_bound)))
    d, m = d[:, :, of], m[of]
    for i in range(n):
        warp, leash = d[i].copy(), d[i].copy()
        if i:
            warp[0] += w[0]  # noqa: F821  the row before
            np.maximum(leash[0], l[0], out=leash[0])  # noqa: F821
            w, l = np.minimum(w[1:], w[:-1]), np.minimum(l[1:], l[:-1])  # noqa: E741
        for j in range(1, len(warp)):
            warp[j] += np.minimum(w[j - 1], warp[j - 1]) if i else warp[j - 1]
            np.maximum(leash[j], np.minimum(l[j - 1], leash[j - 1]) if i else leash[j - 1], out=leash[j])
        w, l = warp, leash  # noqa: E741
    cells = m - 1, np.arange(len(of))
    return of, w[cells], l[cells]


def _least(a, b, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of a the least warping distance to those of b, the least rank of those at that distance, and the least discrete Frechet distance; nan if there is none.

    Runs of b come in any order and each is bounded by what the runs before have found: by the end points, and by the
    other points of a, whose distance to a list is at least that of the centre of their cell less the way to the centre.
    """
    (va, at, n), (vb, bt, m) = a, b
    warp, leash, who = np.full(len(n), np.inf), np.full(len(n), np.inf), np.zeros(len(n), np.int64)
    gaps = bool(np.isnan(va).any() or np.isnan(vb).any())
    some = np.random.default_rng(1).permutation(np.flatnonzero(m))
    lo = 0
    while lo < len(some):
        own = some[lo : lo + min(FIRST + lo, LONGEST)]
        own = own[np.argsort(m[own], kind="stable")]
        size, names = m[own], rank[own]
        y = _laid(vb, bt[own], size, int(size[-1]))
        end = y[:, size - 1, np.arange(len(own))]
        grid = _centres(y, size, max(4, min(GRID, int(len(n) ** 0.5)))) if lo and not gaps else None
        lo += len(own)
        for k in np.unique(n[n > 0]):
            group = np.flatnonzero(n == k)
            for r in np.array_split(group, -(-len(group) * len(own) // BOUNDS)):
                x = _laid(va, at[r], n[r], int(k))
                first, last = _between(x[:, 0, :, None], y[:, 0, None]), _between(x[:, -1, :, None], end[:, None])
                total = size + k
                ends, most = first + last, np.maximum(first, last)
                if k == 1:
                    ends[:, size == 1] = first[:, size == 1]
                if grid and k > 2:
                    centres, near, cells = grid
                    sums, worst = np.zeros(ends.shape, np.float32), np.zeros(ends.shape, np.float32)
                    for i in range(1, k - 1):
                        c = cells(x[:, i])
                        off = near[c] - (_between(x[:, i], centres[:, c]) * (1 + 1e-6)).astype(np.float32)[:, None]
                        np.maximum(worst, off, out=worst)
                        sums += np.maximum(off, 0, out=off)
                    ends += sums * SINGLE
                    most = np.maximum(most, worst * SINGLE)
                far = (ends > (warp[r] * SLACK)[:, None] * total) & (most > (leash[r] * SLACK)[:, None])
                i, j = np.nonzero(~far)
                by_size = np.argsort(j, kind="stable")
                i, j = i[by_size], j[by_size]
                step = max(64, CELLS // int(k * size[-1]))
                for p in range(0, len(i), step):
                    s, t = i[p : p + step], j[p : p + step]
                    ok, w, f = _aligned(x[:, :, s], y[:, : size[t[-1]], t], size[t], warp[r[s]] * SLACK * total[t], leash[r[s]] * SLACK)
                    s, t = r[s[ok]], t[ok]
                    w = w / (size[t] + n[s])
                    if gaps:
                        w, f = np.where(np.isnan(w), np.inf, w), np.where(np.isnan(f), np.inf, f)
                    before = warp[s]
                    np.minimum.at(warp, s, w)
                    who[s[warp[s] < before]] = np.iinfo(who.dtype).max
                    best = w == warp[s]
                    np.minimum.at(who, s[best], names[t[best]])
                    np.minimum.at(leash, s, f)
    return np.where(np.isinf(warp), np.nan, warp), who, np.where(np.isinf(leash), np.nan, leash)


def _shapes(df: DataFrame) -> DataFrame:
    """Each trip with the least trip of its key and points (shape) and the number of such trips (n); `first` marks one row of each shape."""
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    own = df.select("trip", *KEY, F.coalesce(flat, F.array().cast("array<double>")).alias("points")).withColumn("_h", F.xxhash64("points"))
    w = Window.partitionBy("_h", *KEY, "points").orderBy("trip")
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = own.select("trip", *KEY, F.min("trip").over(all_of).alias("shape"), F.count(F.lit(1)).over(all_of).alias("n"), (F.row_number().over(w) == 1).alias("first"), "points")
    return _written(t.withColumn("points", F.when(F.col("first"), F.col("points"))))


def nearest(real: DataFrame, syn: DataFrame, most: int = BLOCK) -> DataFrame:
    """(trip, other, dtw, frechet, pool): each real trip's least distances to all synthetic trips of its pool, and the trip of the least dtw, the least such trip on ties.

    Both have (trip, o, d, bin, points), one row a trip. The pool is the synthetic trips of the same o, d and bin; if there are none,
    those of o and d with bin 0; if there are none either, all. A synthetic trip without a bin is in the last pool only.
    Equal points of one key are compared once. Blocks of about `most` shapes of a pool meet in a worker; only blocks
    are copied, once for each block of the other side, and pairs of trips are never rows.
    """
    n = int(real.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trips, others = _shapes(real), _shapes(syn)
    a, b = trips.where("first").select(*KEY, "shape", "points"), others.where("first").select(*KEY, "shape", "n", "points")
    counts = _written(b.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_b")))  # as a table, its size is known when joins are planned
    keys = counts.where("bin IS NOT NULL AND o IS NOT NULL AND d IS NOT NULL").select(*KEY)
    a = a.join(keys.withColumn("exact", F.lit(True)), KEY, "left")
    a = a.join(keys.where("bin = 0").select("o", "d", F.lit(True).alias("coarse")), ["o", "d"], "left")
    pool, everything = [*KEY, "whole"], [F.lit(0).cast(real.schema[c].dataType).alias(c) for c in KEY]
    a = a.withColumn("bin", F.when(F.col("exact"), F.col("bin")).when(F.col("coarse"), F.lit(0))).withColumn("whole", F.col("bin").isNull())
    a = a.select(*(F.when(~F.col("whole"), F.col(c)).otherwise(F.lit(0)).cast(real.schema[c].dataType).alias(c) for c in KEY), "whole", "shape", "points")
    b = b.join(keys, KEY, "left_semi").withColumn("whole", F.lit(False)).unionByName(b.select(*everything, "shape", "n", "points", F.lit(True).alias("whole")))
    counts = counts.join(keys, KEY).withColumn("whole", F.lit(False)).unionByName(counts.agg(F.sum("_b").alias("_b")).select(*everything, F.lit(True).alias("whole"), "_b"))
    blocks = lambda c: F.ceil(F.col(c) / most).cast("int")
    sizes = _written(a.groupBy(*pool).agg(F.count(F.lit(1)).alias("_a")).join(counts, pool).select(*pool, blocks("_a").alias("_a"), blocks("_b").alias("_b")))
    dealt = lambda c: F.pmod(F.xxhash64("shape"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = a.join(sizes, pool).withColumn("_i", dealt("_a")).withColumn("_j", each("_b")).drop("_a", "_b")
    b = b.join(sizes, pool).withColumn("_j", dealt("_b")).withColumn("_i", each("_a")).drop("_a", "_b")
    met = [*pool, "_i", "_j"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pc.sort_indices(right["shape"]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        left = left if len(order) else left.slice(0, 0)  # a block may hold nothing
        warp, who, leash = _least(_flat(left["points"]), _flat(right["points"]), rank)
        pool = np.full(len(who), pc.sum(right["n"]).as_py() or 0, np.int64)
        return pa.table({"shape": left["shape"], "other": right["shape"].take(pa.array(order[who])), "dtw": warp, "frechet": leash, "pool": pool})

    schema = f"shape {real.schema['trip'].dataType.simpleString()}, other {syn.schema['trip'].dataType.simpleString()}, dtw double, frechet double, pool long"
    found = a.repartition(n, *met).groupBy(*met).cogroup(b.repartition(n, *met).groupBy(*met)).applyInArrow(search, schema)
    best = found.groupBy("shape").agg(F.min(F.struct("dtw", "other")).alias("best"), F.min("frechet").alias("frechet"), F.sum("pool").alias("pool"))
    return trips.select("trip", "shape").join(best, "shape").select("trip", "best.other", "best.dtw", "frechet", "pool")
