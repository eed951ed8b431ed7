"""Column functions for cells, samples, buckets, geometry and hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in kilometres, and kilometres of a degree of latitude.
EARTH_KM, DEGREE_KM = 6371.0088, 111.32


def cell(value: Column, low: float, high: float, grid: int) -> Column:
    """Index of the grid line stretch that holds the value, clipped to the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((value - low) / max(high - low, 1e-12) * grid))).cast("int")


def sampled(items: Column, k: int) -> Column:
    """k items at evenly spaced positions, rounded half to even; arrays of at most k items stay."""
    n = F.size(items)
    spot = lambda i: F.rint(i * (n - 1) / F.lit(k - 1)).cast("int")
    return F.when(n <= k, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(items, spot(i))))


def landmarks(items: Column, k: int) -> Column:
    """k values interpolated linearly at evenly spaced positions of a numeric array."""
    n = F.size(items)

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.lit(float(k - 1))
        lo = F.floor(x).cast("int")
        a, b = F.get(items, lo), F.get(items, F.least(lo + 1, n - 1))
        return a + (b - a) * (x - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)


def bucket(value: Column, edges: list[float]) -> Column:
    """Index of the last edge at or below the value, clipped to the bins."""
    inner = F.array(*(F.lit(float(e)) for e in edges[1:-1]))
    return F.size(F.filter(inner, lambda e: e <= value))


def normalised(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.greatest(high - low, F.lit(1e-12))


def equirectangular_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    mean = F.radians((lat0 + lat1) / 2)
    return F.hypot((lat1 - lat0) * DEGREE_KM, (lon1 - lon0) * DEGREE_KM * F.cos(mean))


def haversine_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column, radius: float = EARTH_KM) -> Column:
    p, q = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def sector(dy: Column, dx: Column, sectors: int) -> Column:
    """Which of the equal sectors of the circle the direction lies in."""
    turn = F.pmod(F.atan2(dy, dx), F.lit(2 * math.pi))
    return F.least(F.lit(sectors - 1), F.floor(turn / (2 * math.pi) * sectors)).cast("int")


def phase(fraction: Column, phases: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(phases - 1), F.floor(fraction * phases))).cast("int")


def grams(items: Column, q: int) -> Column:
    """Consecutive q-grams as arrays; none for shorter arrays."""
    n = F.size(items)
    return F.when(n >= q, F.transform(F.sequence(F.lit(0), n - q), lambda i: F.slice(items, i + 1, q))).otherwise(F.array().cast("array<array<int>>"))


def signature(items: Column, most: int) -> Column:
    return F.array_join(F.transform(F.slice(items, 1, most), lambda c: c.cast("string")), "-")


def texture(a: Column, b: Column, size: int = 1024) -> Column:
    """Bucket of a pair of edges by a multiplicative hash."""
    return F.pmod(a.cast("long") * 2654435761 + b.cast("long") * 2246822519, F.lit(size)).cast("int")


def stable(seed: str, *ids: Column) -> Column:
    """Orderable hash for reproducible samples."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(i.cast("string") for i in ids)), 256)
