"""Joins of points with public nodes and segments, and projections of points onto polylines.

Cells of a grid turn a search by distance into an equi-join: a node or segment is listed in every cell that its
circle of search meets, a point lies in one. So both sides stay distributed and no pair of distant things is made.
Distances are Euclidean in the units of the coordinates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _written


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Written out, so that every engine rounds alike."""
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def _spread(low_x: Column, high_x: Column, low_y: Column, high_y: Column, size: float) -> Column:
    """All cells of a box as structs (cx, cy)."""
    xs, ys = (F.sequence(_cell(a, size), _cell(b, size)) for a, b in ((low_x, high_x), (low_y, high_y)))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def within(points: DataFrame, nodes: DataFrame, radius: float) -> DataFrame:
    """points (x, y, ...) with every node (node, x, y) at most `radius` away, and `distance`."""
    n = nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny"))
    n = n.select("*", F.inline(_spread(F.col("nx") - radius, F.col("nx") + radius, F.col("ny") - radius, F.col("ny") + radius, radius)))
    p = points.withColumns({"cx": _cell(F.col("x"), radius), "cy": _cell(F.col("y"), radius)})
    d = distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    return p.join(n, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("cx", "cy", "nx", "ny")


def nearest(points: DataFrame, nodes: DataFrame, key: list[str], radius: float, rounds: int = 12) -> DataFrame:
    """key, node, distance: the nearest node of each point, the smaller one on ties.

    The radius doubles for the points that found none, so dense places are searched with small cells. After `rounds`
    the rest are compared with all nodes.
    """
    left, found = points.select(*key, "x", "y"), []
    for _ in range(rounds):
        near = _written(within(left, nodes, radius).groupBy(*key).agg(F.min(F.struct("distance", "node")).alias("best")))
        found.append(near)
        left = _written(left.join(near.select(*key), key, "left_anti"))
        if not left.limit(1).count():
            break
        radius *= 2
    else:
        every = left.crossJoin(nodes.select("node", F.col("x").alias("nx"), F.col("y").alias("ny")))
        found.append(every.groupBy(*key).agg(F.min(F.struct(distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("distance"), "node")).alias("best")))
    return reduce(DataFrame.union, found).select(*key, "best.node", "best.distance")


def _onto(x: Column, y: Column, s: dict[str, Column]) -> tuple[Column, Column]:
    """Share of the segment at which its nearest place to (x, y) lies, and the distance."""
    dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
    t = ((x - s["x0"]) * dx + (y - s["y0"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t, distance(x, y, s["x0"] + t * dx, s["y0"] + t * dy)


def nearest_segments(points: DataFrame, segments: DataFrame, key: list[str], radius: float) -> DataFrame:
    """key, edge, distance: the nearest segment (edge, x0, y0, x1, y1) of each point, the smaller one on ties; points farther than `radius` from all have no row."""
    low, high = (lambda a, b: F.least(a, b) - radius), (lambda a, b: F.greatest(a, b) + radius)
    s = segments.select("edge", "x0", "y0", "x1", "y1", F.inline(_spread(low(F.col("x0"), F.col("x1")), high(F.col("x0"), F.col("x1")), low(F.col("y0"), F.col("y1")), high(F.col("y0"), F.col("y1")), radius)))
    p = points.select(*key, "x", "y", _cell(F.col("x"), radius).alias("cx"), _cell(F.col("y"), radius).alias("cy"))
    _, d = _onto(F.col("x"), F.col("y"), {c: F.col(c) for c in ("x0", "y0", "x1", "y1")})
    m = p.join(s, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius)
    return m.groupBy(*key).agg(F.min(F.struct("distance", "edge")).alias("best")).select(*key, "best.edge", "best.distance")


def segments_of(points: DataFrame, trip: str = "trip", seq: str = "seq") -> DataFrame:
    """(trip, nth, x0, y0, x1, y1, start, len) of each trip's neighbouring points; start is the length before it."""
    w = Window.partitionBy(trip).orderBy(seq)
    s = points.select(trip, F.row_number().over(w).alias("nth"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 IS NOT NULL")
    s = s.withColumn("len", distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    before = Window.partitionBy(trip).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0.0)))


def projected(points: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """key, distance, position: each point's nearest place on its own trip's polyline (segments_of), the earlier segment on ties, and how far along it lies."""
    s = lines.select("trip", "nth", "x0", "y0", "x1", "y1", "start", "len")
    t, d = _onto(F.col("x"), F.col("y"), {c: F.col(c) for c in ("x0", "y0", "x1", "y1")})
    m = points.select(*key, "x", "y").join(s, "trip").select(*key, F.struct(d.alias("distance"), "nth", (F.col("start") + t * F.col("len")).alias("position")).alias("at"))
    return m.groupBy(*key).agg(F.min("at").alias("at")).select(*key, "at.distance", "at.position")


def resampled(points: DataFrame, n: int) -> DataFrame:
    """(trip, k, x, y): n points at equal distances along each trip; a trip of no length repeats its first point."""
    s = segments_of(points)
    w = Window.partitionBy("trip")
    s = s.withColumns({"total": F.sum("len").over(w), "last": F.max("nth").over(w)})
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), (F.col("total") * k / F.lit(float(n - 1))).alias("at")))
    ends = F.col("start") + F.col("len")
    inside = F.filter(at, lambda a: ((a["at"] >= F.col("start")) | (F.col("nth") == 1)) & ((a["at"] < ends) | (F.col("nth") == F.col("last"))))
    rows = s.select("trip", "nth", "x0", "y0", "x1", "y1", "start", "len", F.inline(inside))
    share = F.when(F.col("len") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("at") - F.col("start")) / F.col("len")))).otherwise(0.0)
    spot = F.struct("nth", (F.col("x0") + (F.col("x1") - F.col("x0")) * share).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * share).alias("y"))
    return rows.groupBy("trip", "k").agg(F.min(spot).alias("p")).select("trip", "k", "p.x", "p.y")
