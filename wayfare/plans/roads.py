"""Order lines as tracks over a public road network: snapping, direct routers, completion, witnesses, evidence.

Nodes are nations at fixed places, roads join those at most REACH apart, tracks are order lines (quantity, price in
thousands). The network is public and does not grow with the tracks.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators import spatial as P
from wayfare.registry import register
from wayfare.sources import views as V

from .distributions import _rounded
from .sequences import step

#: Longest road, gates of snapping, of a segment and of a detour, and scales of proximity.
REACH, SNAP, SEGMENT, STRETCH, TAU, JUMP = 26.0, 9.0, 60.0, 1.4, 5.0, 40.0
MOST = 32

TRACKS = f"{V.POINTS}, tracks AS (SELECT trip, side, seq, x, y / 1000 AS y FROM points)"
NODES = "nodes AS (SELECT n_nationkey AS node, (n_nationkey * 7 % 25) * 2.0::DOUBLE AS x, (n_nationkey * 11 % 25) * 4.0::DOUBLE AS y FROM nation)"


def _d(a, b):
    return f"sqrt(({b}.x - {a}.x) * ({b}.x - {a}.x) + ({b}.y - {a}.y) * ({b}.y - {a}.y))"


ROADS = f"{NODES}, roads AS (SELECT a.node AS u, b.node AS v, {_d('a', 'b')} AS len FROM nodes a, nodes b WHERE a.node <> b.node AND {_d('a', 'b')} <= {REACH})"
SNAPPED = f"{TRACKS}, {ROADS}, snapped AS (SELECT t.trip, t.side, t.seq, t.x, t.y, n.node, {_d('t', 'n')} AS d FROM tracks t, nodes n QUALIFY row_number() OVER (PARTITION BY t.trip, t.seq ORDER BY {_d('t', 'n')}, n.node) = 1)"
LEGS = f"{SNAPPED}, w0 AS (SELECT *, lag(node) OVER (PARTITION BY trip ORDER BY seq) AS before FROM snapped), walk AS (SELECT * FROM w0 WHERE before IS NULL OR before <> node), legs0 AS (SELECT trip, side, seq, x, y, node AS u, lead(node) OVER w AS v, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM walk WINDOW w AS (PARTITION BY trip ORDER BY seq)), legs AS (SELECT l.*, r.len AS len FROM legs0 l LEFT JOIN roads r ON l.u = r.u AND l.v = r.v WHERE l.v IS NOT NULL)"


def tracks(spark, sf):
    """(trip, side, seq, x, y), thinned to MOST points at even places."""
    t = V.points(spark, sf).select("trip", "side", "seq", "x", (F.col("y") / 1000).alias("y"))
    t = t.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trip")))
    spots = F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda i: F.rint(i * (F.col("n") - 1) / F.lit(MOST - 1)).cast("int"))
    return t.where((F.col("n") <= MOST) | F.array_contains(spots, F.col("seq") - 1)).drop("n")


def nodes(spark, sf):
    k = F.col("n_nationkey")
    return V.table(spark, sf, "nation").select(k.alias("node"), (k * 7 % 25 * 2.0).alias("x"), (k * 11 % 25 * 4.0).alias("y"))


def roads(spark, sf):
    n = nodes(spark, sf)
    near = P.within(n.withColumnRenamed("node", "u"), n, REACH)
    return near.where("u != node").select("u", F.col("node").alias("v"), F.col("distance").alias("len"))


def snapped(spark, sf):
    t = tracks(spark, sf)
    return t.join(P.nearest(t, nodes(spark, sf), ["trip", "seq"], 8.0).withColumnRenamed("distance", "d"), ["trip", "seq"])


def legs(spark, sf, snaps=None):
    """Moves between different neighbouring nodes with the length of their road, null where there is none."""
    w = V.compress((snapped(spark, sf) if snaps is None else snaps).select("trip", "side", "seq", "x", "y", "node"), "node")
    s = step()
    m = w.select("trip", "side", "seq", "x", "y", F.col("node").alias("u"), F.lead("node").over(s).alias("v"), F.lead("x").over(s).alias("x2"), F.lead("y").over(s).alias("y2")).where("v IS NOT NULL")
    return m.join(F.broadcast(roads(spark, sf)), ["u", "v"], "left")  # nations squared at most


def nearest_nodes(spark, sf):
    return _rounded(snapped(spark, sf).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("distance")), 4)


register("join_nearest_node", nearest_nodes, f"WITH {SNAPPED} SELECT node, count(*) AS n, round(sum(d), 4) AS distance FROM snapped GROUP BY node")


def annulus(spark, sf):
    """First points by the nodes from 8 to 16 away; without any, by the nearest node of all."""
    first = tracks(spark, sf).where("seq = 1").select("trip", "x", "y")
    ring = P.within(first, nodes(spark, sf), 16.0).where("distance >= 8 AND distance < 16").select("trip", "node", F.lit("ring").alias("kind"))
    rest = first.join(ring.select("trip").distinct(), "trip", "left_anti")
    other = P.nearest(rest, nodes(spark, sf), ["trip"], 16.0).select("trip", "node", F.lit("nearest").alias("kind"))
    return ring.union(other).groupBy("kind", "node").agg(F.count(F.lit(1)).alias("trips"))


register("join_radius", annulus, f"WITH {TRACKS}, {NODES}, f AS (SELECT t.trip, n.node, {_d('t', 'n')} AS d FROM tracks t, nodes n WHERE t.seq = 1), r AS (SELECT 'ring' AS kind, trip, node FROM f WHERE d >= 8 AND d < 16), o AS (SELECT 'nearest' AS kind, trip, node FROM f WHERE trip NOT IN (SELECT trip FROM r) QUALIFY row_number() OVER (PARTITION BY trip ORDER BY d, node) = 1) SELECT kind, node, count(*) AS trips FROM (SELECT * FROM r UNION ALL SELECT * FROM o) GROUP BY kind, node")


def _segments(spark, sf):
    n = nodes(spark, sf)
    r = roads(spark, sf).where("u < v").join(n.selectExpr("node AS u", "x AS x0", "y AS y0"), "u").join(n.selectExpr("node AS v", "x AS x1", "y AS y1"), "v")
    return r.select((F.col("u") * 100 + F.col("v")).alias("edge"), "x0", "y0", "x1", "y1")


_PROJECT = "greatest(0.0, least(1.0, ((t.x - s.x0) * (s.x1 - s.x0) + (t.y - s.y0) * (s.y1 - s.y0)) / greatest((s.x1 - s.x0) * (s.x1 - s.x0) + (s.y1 - s.y0) * (s.y1 - s.y0), 1e-12)))"
_OFF = "sqrt((s.x0 + f * (s.x1 - s.x0) - t.x) * (s.x0 + f * (s.x1 - s.x0) - t.x) + (s.y0 + f * (s.y1 - s.y0) - t.y) * (s.y0 + f * (s.y1 - s.y0) - t.y))".replace("f *", f"{_PROJECT} *")


def nearest_edges(spark, sf):
    """Road sequences of tracks all of whose points lie at most SNAP from a road; others have no route. Edges count once a run."""
    t = tracks(spark, sf)
    e = P.nearest_segments(t, _segments(spark, sf), ["trip", "side", "seq"], SNAP)
    n = t.groupBy("trip").agg(F.count(F.lit(1)).alias("n"))
    whole = e.groupBy("trip").agg(F.count(F.lit(1)).alias("got")).join(n, "trip").where("got = n AND n >= 2").select("trip")
    runs = V.compress(e.join(whole, "trip", "left_semi").select("trip", "side", "seq", "edge"), "edge")
    return runs.groupBy("edge", "side").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("trip").alias("trips"))


register(
    "join_nearest_edge",
    nearest_edges,
    f"WITH {TRACKS}, {ROADS}, seg AS (SELECT u * 100 + v AS edge, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM roads JOIN nodes a ON a.node = u JOIN nodes b ON b.node = v WHERE u < v), c AS (SELECT t.trip, t.side, t.seq, s.edge, {_OFF} AS d FROM tracks t, seg s), e AS (SELECT * FROM c WHERE d <= {SNAP} QUALIFY row_number() OVER (PARTITION BY trip, seq ORDER BY d, edge) = 1), "
    "k AS (SELECT trip FROM e GROUP BY trip HAVING count(*) >= 2 AND count(*) = (SELECT count(*) FROM tracks t WHERE t.trip = e.trip)), b AS (SELECT *, lag(edge) OVER (PARTITION BY trip ORDER BY seq) AS before FROM e WHERE trip IN (SELECT trip FROM k)) SELECT edge, side, count(*) AS runs, count(DISTINCT trip) AS trips FROM b WHERE before IS NULL OR before <> edge GROUP BY edge, side",
)


def direct_routes(spark, sf):
    """Yield of the router that takes snapped nodes as they are: a track has a route if all its moves are roads."""
    t = tracks(spark, sf).select("trip", "side").distinct()
    r = legs(spark, sf).groupBy("trip").agg(F.count(F.lit(1)).alias("moves"), F.count_if(F.col("len").isNull()).alias("missing"), F.sum("len").alias("len"))
    j = t.join(r, "trip", "left").withColumn("ok", F.coalesce(F.col("missing") == 0, F.lit(False)))
    return _rounded(j.groupBy("side").agg(F.count(F.lit(1)).alias("slots"), F.count_if("ok").alias("routes"), F.sum(F.when(F.col("ok"), F.col("moves")).otherwise(0)).alias("edges"), F.sum(F.when(F.col("ok"), F.col("len")).otherwise(0.0)).alias("length")), 4)


register("road_direct_routes", direct_routes, f"WITH {LEGS}, r AS (SELECT trip, count(*) AS moves, count(*) FILTER (len IS NULL) AS missing, sum(len) AS len FROM legs GROUP BY trip), t AS (SELECT DISTINCT trip, side FROM tracks) SELECT side, count(*) AS slots, count(*) FILTER (missing = 0) AS routes, CAST(sum(CASE WHEN missing = 0 THEN moves ELSE 0 END) AS BIGINT) AS edges, round(sum(CASE WHEN missing = 0 THEN len ELSE 0.0 END), 4) AS length FROM t LEFT JOIN r ON t.trip = r.trip GROUP BY side")


def road_counts(spark, sf):
    """Moves by road, those on no road as (-1, -1), with the share of moves on roads and of tracks with at least 95 % of them."""
    m = legs(spark, sf)
    on = F.col("len").isNotNull()
    per = m.groupBy("trip", "side").agg((F.count_if(on) / F.count(F.lit(1)) >= 0.95).alias("ok"))
    slots = tracks(spark, sf).groupBy("side").agg(F.countDistinct("trip").alias("slots"))
    good = per.groupBy("side").agg(F.count_if("ok").alias("good")).join(slots, "side")
    whole = m.groupBy("side").agg(F.count(F.lit(1)).alias("moves"), F.count_if(on).alias("valid"))
    c = m.select("side", F.when(on, F.col("u")).otherwise(-1).alias("u"), F.when(on, F.col("v")).otherwise(-1).alias("v")).groupBy("side", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    j = c.join(F.broadcast(whole), "side").join(F.broadcast(good), "side")  # one row a side each
    return _rounded(j.select("side", "u", "v", "n", (F.col("valid") / F.col("moves")).alias("valid_share"), (F.col("good") / F.col("slots")).alias("compatible")))


register("road_counts", road_counts, f"WITH {LEGS}, c AS (SELECT side, CASE WHEN len IS NULL THEN -1 ELSE u END AS u, CASE WHEN len IS NULL THEN -1 ELSE v END AS v, count(*) AS n FROM legs GROUP BY 1, 2, 3), w AS (SELECT side, count(*) FILTER (len IS NOT NULL) / count(*) AS valid_share FROM legs GROUP BY side), p AS (SELECT trip, side, count(*) FILTER (len IS NOT NULL) / count(*) >= 0.95 AS ok FROM legs GROUP BY trip, side), s AS (SELECT side, count(DISTINCT trip) AS slots FROM tracks GROUP BY side), g AS (SELECT p.side, count(*) FILTER (ok) / max(slots) AS compatible FROM p JOIN s ON p.side = s.side GROUP BY p.side) SELECT c.side, u, v, n, round(valid_share, 6) AS valid_share, round(compatible, 6) AS compatible FROM c JOIN w ON w.side = c.side JOIN g ON g.side = c.side")


def evidence(spark, sf):
    """Evidence of roads in the tracks themselves: proximity to nodes, moves on roads, short steps, and their product by track."""
    s = snapped(spark, sf)
    near = s.groupBy("trip", "side").agg(F.avg(F.exp(-F.col("d") / TAU)).alias("proximity"), F.count(F.lit(1)).alias("n"))
    on = F.when(F.col("len").isNotNull(), 1.0).otherwise(0.0)
    go = legs(spark, sf, s).groupBy("trip").agg(F.sum(on).alias("valid"), F.count(F.lit(1)).alias("moves"))
    st = P.segments_of(tracks(spark, sf)).groupBy("trip").agg(F.sum(F.when(F.col("len") <= JUMP, 1.0).otherwise(0.0)).alias("short"), F.count(F.lit(1)).alias("steps"))
    t = near.join(go, "trip", "left").join(st, "trip", "left")
    e = F.when(F.col("n") >= 2, F.col("proximity") * F.coalesce(F.col("valid") / F.col("moves"), F.lit(0.0)) * F.coalesce(F.col("short") / F.col("steps"), F.lit(0.0))).otherwise(0.0)
    t = t.withColumn("evidence", e)
    return _rounded(t.groupBy("side").agg(F.avg(F.when(F.col("n") >= 2, F.col("proximity"))).alias("proximity"), (F.sum("valid") / F.sum("moves")).alias("continuity"), (1 - F.sum("short") / F.sum("steps")).alias("long_jumps"), F.avg(F.when(F.col("evidence") > 0.95, 1.0).otherwise(0.0)).alias("yield"), F.avg("evidence").alias("mean"), F.percentile("evidence", F.lit(0.5)).alias("median")))


_STEPS = "steps AS (SELECT trip, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS len FROM tracks WINDOW w AS (PARTITION BY trip ORDER BY seq))"
register("road_native_evidence", evidence, f"WITH {LEGS}, {_STEPS}, a AS (SELECT trip, side, avg(exp(-d / {TAU})) AS proximity, count(*) AS n FROM snapped GROUP BY trip, side), g AS (SELECT trip, CAST(count(*) FILTER (len IS NOT NULL) AS DOUBLE) AS valid, count(*) AS moves FROM legs GROUP BY trip), s AS (SELECT trip, CAST(count(*) FILTER (len <= {JUMP}) AS DOUBLE) AS short, count(*) AS steps FROM steps WHERE len IS NOT NULL GROUP BY trip), t AS (SELECT a.*, valid, moves, short, steps, CASE WHEN n >= 2 THEN proximity * coalesce(valid / moves, 0) * coalesce(short / steps, 0) ELSE 0 END AS e FROM a LEFT JOIN g ON a.trip = g.trip LEFT JOIN s ON a.trip = s.trip) SELECT side, round(avg(CASE WHEN n >= 2 THEN proximity END), 6) AS proximity, round(sum(valid) / sum(moves), 6) AS continuity, round(1 - sum(short) / sum(steps), 6) AS long_jumps, round(avg(CASE WHEN e > 0.95 THEN 1.0 ELSE 0.0 END), 6) AS yield, round(avg(e), 6) AS mean, round(CAST(quantile_cont(e, 0.5) AS DOUBLE), 6) AS median FROM t GROUP BY side")

#: Closure of the network by doubling: after six steps paths of up to 64 roads are found, more than there are nodes.
CLOSURE = "k0 AS (SELECT u, v, len FROM roads UNION ALL SELECT node, node, 0.0 FROM nodes), " + ", ".join(f"k{i + 1} AS (SELECT a.u, b.v, min(a.len + b.len) AS len FROM k{i} a JOIN k{i} b ON a.v = b.u GROUP BY a.u, b.v)" for i in range(6))


def shortest(spark, sf, weights=None):
    """(u, v, len) between all nodes by doubling: tables of nodes squared, whatever the tracks."""
    d = (roads(spark, sf) if weights is None else weights).select("u", "v", "len").union(nodes(spark, sf).select("node", F.col("node").alias("v"), F.lit(0.0)))
    for i in range(6):
        b = d.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("len").alias("more"))
        d = P._written(d.join(b, "v").groupBy("u", "w").agg(F.min(F.col("len") + F.col("more")).alias("len")).withColumnRenamed("w", "v"))
    return d


def _completed(spark, sf):
    """Each track's reason: the first gate it fails, by track and then along it, or accepted; with the length of the completed route."""
    s = snapped(spark, sf)
    t = s.groupBy("trip", "side").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far"))
    m = legs(spark, sf, s).drop("len").join(F.broadcast(shortest(spark, sf).withColumnRenamed("len", "route")), ["u", "v"], "left")
    direct = P.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    why = F.when((direct <= 1.0) | (direct > SEGMENT), "segment_gate").when(F.col("route").isNull(), "no_route").when(F.col("route") / direct > STRETCH, "stretch_gate")
    g = m.withColumn("why", why).groupBy("trip").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("seq", "why"))).alias("bad"), F.sum("route").alias("route"))
    reason = F.when(F.col("n") < 2, "too_short").when(F.col("far") > SNAP, "snap").when(F.col("g_trip").isNull(), "collapsed").otherwise(F.coalesce(F.col("bad.why"), F.lit("accepted")))
    return t.join(g.withColumnRenamed("trip", "g_trip"), t["trip"] == F.col("g_trip"), "left").withColumn("reason", reason)


def snap_connect(spark, sf):
    c = _completed(spark, sf)
    return _rounded(c.groupBy("side", "reason").agg(F.count(F.lit(1)).alias("trips"), F.sum(F.when(F.col("reason") == "accepted", F.col("route")).otherwise(0.0)).alias("length")), 4)


register("road_snap_connect", snap_connect, f"WITH {LEGS}, {CLOSURE}, t AS (SELECT trip, side, count(*) AS n, max(d) AS far FROM snapped GROUP BY trip, side), m AS (SELECT l.trip, l.seq, k.len AS route, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS direct FROM legs l LEFT JOIN k6 k ON k.u = l.u AND k.v = l.v), w AS (SELECT *, CASE WHEN direct <= 1.0 OR direct > {SEGMENT} THEN 'segment_gate' WHEN route IS NULL THEN 'no_route' WHEN route / direct > {STRETCH} THEN 'stretch_gate' END AS why FROM m), g AS (SELECT trip, arg_min(why, seq) FILTER (why IS NOT NULL) AS why, sum(route) AS route FROM w GROUP BY trip), c AS (SELECT t.side, CASE WHEN n < 2 THEN 'too_short' WHEN far > {SNAP} THEN 'snap' WHEN g.trip IS NULL THEN 'collapsed' ELSE coalesce(why, 'accepted') END AS reason, route FROM t LEFT JOIN g ON g.trip = t.trip) SELECT side, reason, count(*) AS trips, round(sum(CASE WHEN reason = 'accepted' THEN route ELSE 0.0 END), 4) AS length FROM c GROUP BY side, reason")


def _matches(spark, sf):
    """Match records: (trip, side, moves, connected, share, p95, accepted). Observed points lie within SNAP; residuals are distances to the node."""
    s = snapped(spark, sf)
    p = s.groupBy("trip", "side").agg(F.avg(F.when(F.col("d") <= SNAP, 1.0).otherwise(0.0)).alias("share"), F.percentile("d", F.lit(0.95)).alias("p95"))
    g = legs(spark, sf, s).groupBy("trip").agg(F.count(F.lit(1)).alias("moves"), F.min(F.col("len").isNotNull()).alias("whole"))
    m = p.join(g, "trip", "left").withColumn("connected", F.coalesce("whole", F.lit(False)))
    return m.withColumn("accepted", F.col("connected") & (F.col("share") >= 0.5) & (F.col("p95") <= SNAP + 4)), s


_MATCH = f"{LEGS}, mp AS (SELECT trip, side, avg(CASE WHEN d <= {SNAP} THEN 1.0 ELSE 0.0 END) AS share, quantile_cont(d, 0.95) AS p95 FROM snapped GROUP BY trip, side), mg AS (SELECT trip, count(*) AS moves, bool_and(len IS NOT NULL) AS whole FROM legs GROUP BY trip), match AS (SELECT mp.*, moves, coalesce(whole, false) AS connected, coalesce(whole, false) AND share >= 0.5 AND p95 <= {SNAP + 4} AS accepted FROM mp LEFT JOIN mg ON mg.trip = mp.trip)"


def realizability(spark, sf):
    """Shares of accepted and connected matches, mean share of observed points, and residuals of the accepted ones; then the alignment score share * exp(-p95 / TAU)."""
    m, s = _matches(spark, sf)
    r = s.join(m.where("accepted").select("trip"), "trip", "left_semi").groupBy("side").agg(F.percentile("d", F.lit(0.5)).alias("residual_median"), F.percentile("d", F.lit(0.95)).alias("residual_p95"))
    score = F.when(F.col("connected"), F.col("share") * F.exp(-F.col("p95") / TAU)).otherwise(0.0)
    one = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    a = m.withColumn("score", score).groupBy("side").agg(one("accepted").alias("realizable"), one("connected").alias("connected"), F.avg("share").alias("coverage"), F.avg("score").alias("alignment"), F.percentile("score", F.lit(0.5)).alias("alignment_median"), F.percentile("score", F.lit(0.05)).alias("alignment_p05"))
    return _rounded(a.join(r, "side", "left"))


register("road_realizability", realizability, f"WITH {_MATCH}, r AS (SELECT s.side, CAST(quantile_cont(d, 0.5) AS DOUBLE) AS residual_median, CAST(quantile_cont(d, 0.95) AS DOUBLE) AS residual_p95 FROM snapped s JOIN match m ON m.trip = s.trip AND accepted GROUP BY s.side), a AS (SELECT side, avg(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) AS realizable, avg(CASE WHEN connected THEN 1.0 ELSE 0.0 END) AS connected, avg(share) AS coverage, avg(z) AS alignment, quantile_cont(z, 0.5) AS m, quantile_cont(z, 0.05) AS p FROM (SELECT *, CASE WHEN connected THEN share * exp(-p95 / {TAU}) ELSE 0 END AS z FROM match) GROUP BY side) SELECT a.side, round(realizable, 6) AS realizable, round(connected, 6) AS connected, round(coverage, 6) AS coverage, round(alignment, 6) AS alignment, round(CAST(m AS DOUBLE), 6) AS alignment_median, round(CAST(p AS DOUBLE), 6) AS alignment_p05, round(residual_median, 6) AS residual_median, round(residual_p95, 6) AS residual_p95 FROM a LEFT JOIN r ON r.side = a.side")


def accepted(spark, sf):
    """Accepted matches, and those of at least two roads: shorter ones lose their acceptance and keep their slot."""
    m, _ = _matches(spark, sf)
    m = m.withColumn("long", F.col("accepted") & (F.col("moves") >= 2))
    return m.groupBy("side").agg(F.count(F.lit(1)).alias("slots"), F.count_if("accepted").alias("accepted"), F.count_if("long").alias("long_enough"))


register("fil_accepted", accepted, f"WITH {_MATCH} SELECT side, count(*) AS slots, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND moves >= 2) AS long_enough FROM match GROUP BY side")


def _walks(spark, sf, control):
    """Polylines of the witnesses: an order's supplier nations, or a control: reversed, or those of the order with the next smaller hash."""
    h = V.hops(spark, sf).select("trip", "seq", "node")
    if control == "reversed":
        h = h.withColumn("seq", -F.col("seq"))
    if control == "permuted":
        t = h.select("trip").distinct().withColumn("part", F.pmod("trip", F.lit(64)))
        w = Window.partitionBy("part").orderBy(F.sha2(F.col("trip").cast("string"), 256))
        t = t.select("trip", F.coalesce(F.lag("trip").over(w), F.last("trip").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("of"))
        h = h.withColumnRenamed("trip", "of").join(t, "of").select("trip", "seq", "node")
    return h.join(F.broadcast(nodes(spark, sf)), "node").select("trip", "seq", "x", "y")  # the nations


def witness(spark, sf, control="none"):
    """Agreement of tracks with witness polylines: shares of consistent tracks and of tracks wholly within REACH, spread of their distances, moves ahead."""
    t = tracks(spark, sf).select("trip", "seq", "x", "y")
    j = P.projected(t, P.segments_of(_walks(spark, sf, control)), ["trip", "seq"])
    w = step()
    j = j.withColumn("ahead", F.when(F.lag("position").over(w).isNotNull(), F.when(F.col("position") - F.lag("position").over(w) >= -1e-6, 1.0).otherwise(0.0)))
    per = j.groupBy("trip").agg(F.percentile("distance", F.lit(0.95)).alias("p95"), F.max("distance").alias("far"), F.coalesce(F.avg("ahead"), F.lit(1.0)).alias("ahead"), F.greatest(F.min_by("distance", "seq"), F.max_by("distance", "seq")).alias("ends"))
    a = t.select("trip").distinct().join(per, "trip", "left")
    good = (F.col("p95") <= REACH) & (F.col("ends") <= REACH) & (F.col("ahead") >= 0.5)
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    return _rounded(a.agg(share(good).alias("consistent"), share(F.col("far") <= REACH).alias("all_within"), F.percentile("p95", F.lit(0.5)).alias("p95_median"), F.percentile("p95", F.lit(0.95)).alias("p95_p95"), F.percentile("far", F.lit(0.95)).alias("far_p95"), F.avg(F.coalesce("ahead", F.lit(0.0))).alias("monotone")))


def _witness_sql(control):
    of = {"none": "wn AS (SELECT trip, seq, node FROM hops)", "reversed": "wn AS (SELECT trip, -seq AS seq, node FROM hops)", "permuted": "wt AS (SELECT trip, coalesce(lag(trip) OVER w, last_value(trip) OVER (PARTITION BY trip % 64 ORDER BY sha256(CAST(trip AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS of FROM (SELECT DISTINCT trip FROM hops) WINDOW w AS (PARTITION BY trip % 64 ORDER BY sha256(CAST(trip AS VARCHAR)))), wn AS (SELECT wt.trip, hops.seq, hops.node FROM hops JOIN wt ON hops.trip = wt.of)"}[control]
    return (
        f"WITH {V.HOPS}, tracks AS (SELECT trip, side, seq, x, y / 1000 AS y FROM points), {NODES}, {of}, wl AS (SELECT trip, row_number() OVER w AS nth, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM wn JOIN nodes ON wn.node = nodes.node WINDOW w AS (PARTITION BY trip ORDER BY seq)), s1 AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM wl WHERE x1 IS NOT NULL), s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY trip ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s1), "
        f"c AS (SELECT t.trip, t.seq, s.nth, {_OFF} AS distance, s.start + {_PROJECT} * s.len AS position FROM tracks t JOIN s ON s.trip = t.trip QUALIFY row_number() OVER (PARTITION BY t.trip, t.seq ORDER BY distance, s.nth) = 1), j AS (SELECT *, position - lag(position) OVER (PARTITION BY trip ORDER BY seq) AS step FROM c), "
        "per AS (SELECT trip, quantile_cont(distance, 0.95) AS p95, max(distance) AS far, coalesce(avg(CASE WHEN step IS NULL THEN NULL WHEN step >= -1e-6 THEN 1.0 ELSE 0.0 END), 1.0) AS ahead, greatest(arg_min(distance, seq), arg_max(distance, seq)) AS ends FROM j GROUP BY trip), a AS (SELECT t.trip, p95, far, ahead, ends FROM (SELECT DISTINCT trip FROM tracks) t LEFT JOIN per ON per.trip = t.trip) "
        f"SELECT round(avg(CASE WHEN p95 <= {REACH} AND ends <= {REACH} AND ahead >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS consistent, round(avg(CASE WHEN far <= {REACH} THEN 1.0 ELSE 0.0 END), 6) AS all_within, round(CAST(quantile_cont(p95, 0.5) AS DOUBLE), 6) AS p95_median, round(CAST(quantile_cont(p95, 0.95) AS DOUBLE), 6) AS p95_p95, round(CAST(quantile_cont(far, 0.95) AS DOUBLE), 6) AS far_p95, round(avg(coalesce(ahead, 0.0)), 6) AS monotone FROM a"
    )


register("road_witness_agreement", witness, _witness_sql("none"))
for _c in ("reversed", "permuted"):
    register(f"road_witness_{_c}", lambda s, d, c=_c: witness(s, d, c), _witness_sql(_c))


def witness_structure(spark, sf):
    """Structurally valid witnesses by side: some edges, nodes that are the edges' ends, public roads only, not marked invalid. Every seventh order is marked so."""
    e = V.edges(spark, sf).select("trip", "side", "seq", "u", "v")
    ends = V.hops(spark, sf).select("trip", "seq", "node")
    pairs = e.join(ends.withColumnRenamed("node", "a"), ["trip", "seq"], "left").join(ends.select("trip", (F.col("seq") - 1).alias("seq"), F.col("node").alias("b")), ["trip", "seq"], "left")
    pairs = pairs.join(F.broadcast(roads(spark, sf).select("u", "v", F.lit(True).alias("public"))), ["u", "v"], "left")  # nations squared at most
    ok = F.coalesce((F.col("a") == F.col("u")) & (F.col("b") == F.col("v")) & F.col("public"), F.lit(False))
    per = pairs.groupBy("trip").agg(F.min(ok).alias("ok"), F.count(F.lit(1)).alias("edges"))
    s = V.slots(spark, sf).join(per, "trip", "left").withColumn("valid", F.coalesce("ok", F.lit(False)) & (F.col("trip") % 7 != 0))
    return _rounded(s.groupBy("side").agg(F.count(F.lit(1)).alias("slots"), F.count_if("valid").alias("valid"), F.avg(F.when(F.col("valid"), 1.0).otherwise(0.0)).alias("share")))


register("fil_witness_structure", witness_structure, f"WITH {V.EDGES}, {V.SLOTS}, {ROADS}, per AS (SELECT e.trip, bool_and(r.u IS NOT NULL) AS ok FROM edges e LEFT JOIN roads r ON r.u = e.u AND r.v = e.v GROUP BY e.trip), s AS (SELECT slots.side, coalesce(ok, false) AND slots.trip % 7 <> 0 AS valid FROM slots LEFT JOIN per ON per.trip = slots.trip) SELECT side, count(*) AS slots, count(*) FILTER (valid) AS valid, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS share FROM s GROUP BY side")


def arc_resample(spark, sf):
    """Six points at equal distances along each track."""
    return _rounded(P.resampled(tracks(spark, sf), 6))


register("seq_arc_resample", arc_resample, f"WITH {TRACKS}, a AS (SELECT trip, row_number() OVER w AS nth, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM tracks WINDOW w AS (PARTITION BY trip ORDER BY seq)), s0 AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM a WHERE x1 IS NOT NULL), s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY trip ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len) OVER (PARTITION BY trip) AS total, max(nth) OVER (PARTITION BY trip) AS n FROM s0), k AS (SELECT *, total * k / 5.0 AS spot FROM s, range(6) r(k)), i AS (SELECT *, CASE WHEN len > 0 THEN greatest(0.0, least(1.0, (spot - start) / len)) ELSE 0.0 END AS f FROM k WHERE (spot >= start OR nth = 1) AND (spot < start + len OR nth = n) QUALIFY row_number() OVER (PARTITION BY trip, k ORDER BY nth) = 1) SELECT trip, CAST(k AS INT) AS k, round(x0 + (x1 - x0) * f, 6) AS x, round(y0 + (y1 - y0) * f, 6) AS y FROM i")


def route_shapes(spark, sf):
    """Coordinates of routes: each road's geometry of three points, turned to the direction of travel, joints once."""
    e = V.edges(spark, sf).select("trip", "seq", "u", "v")
    n = nodes(spark, sf)
    low, high = F.least("u", "v"), F.greatest("u", "v")
    e = e.withColumns({"a": low, "b": high}).join(F.broadcast(n.selectExpr("node AS a", "x AS ax", "y AS ay")), "a").join(F.broadcast(n.selectExpr("node AS b", "x AS bx", "y AS by")), "b")  # the nations
    mid = F.struct(((F.col("ax") + F.col("bx")) / 2 + 1).alias("x"), ((F.col("ay") + F.col("by")) / 2 - 1).alias("y"))
    shape = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), mid, F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    e = e.withColumn("shape", F.when(F.col("u") < F.col("v"), shape).otherwise(F.reverse(shape)))
    p = e.select("trip", "seq", F.posexplode("shape").alias("k", "p")).where("seq = 1 OR k > 0").select("trip", (F.col("seq") * 3 + F.col("k")).alias("seq"), "p.x", "p.y")
    n = p.groupBy("trip").agg(F.count(F.lit(1)).alias("points"))
    return _rounded(P.segments_of(p).groupBy("trip").agg(F.sum("len").alias("length")).join(n, "trip"), 4)


register("road_route_shapes", route_shapes, f"WITH {V.EDGES}, {NODES}, e AS (SELECT trip, seq, u < v AS ahead, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy FROM edges JOIN nodes a ON a.node = least(u, v) JOIN nodes b ON b.node = greatest(u, v)), p AS (SELECT trip, seq * 3 + k AS seq, CASE WHEN k = 1 THEN (ax + bx) / 2 + 1 WHEN (k = 0) = ahead THEN ax ELSE bx END AS x, CASE WHEN k = 1 THEN (ay + byy) / 2 - 1 WHEN (k = 0) = ahead THEN ay ELSE byy END AS y FROM e, range(3) r(k) WHERE seq = 1 OR k > 0), d AS (SELECT trip, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS len FROM p WINDOW w AS (PARTITION BY trip ORDER BY seq)) SELECT trip, count(*) AS points, round(sum(len), 4) AS length FROM d GROUP BY trip")


def tilted(spark, sf):
    """Shortest lengths between all nodes when a road's length shrinks with how often it is travelled: len * exp(-0.5 * share of its node's departures)."""
    flow = V.edges(spark, sf).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("u")))
    w = roads(spark, sf).join(flow, ["u", "v"], "left").select("u", "v", (F.col("len") * F.exp(-0.5 * F.coalesce("share", F.lit(0.0)))).alias("len"))
    return _rounded(shortest(spark, sf, w).select("u", "v", F.col("len").alias("length")))


_TILT = CLOSURE.replace("SELECT u, v, len FROM roads", "SELECT roads.u, roads.v, len * exp(-0.5 * coalesce(share, 0.0)) FROM roads LEFT JOIN flow ON flow.u = roads.u AND flow.v = roads.v", 1).replace("k0 AS (SELECT roads.u, roads.v, len * exp(-0.5 * coalesce(share, 0.0))", "k0 AS (SELECT roads.u, roads.v, len * exp(-0.5 * coalesce(share, 0.0)) AS len", 1)
register("graph_flow_tilted", tilted, f"WITH {V.EDGES}, {ROADS}, flow AS (SELECT u, v, count(*) / sum(count(*)) OVER (PARTITION BY u) AS share FROM edges GROUP BY u, v), {_TILT} SELECT u, v, round(len, 6) AS length FROM k6")

#: Centers of the graph's regions.
CENTERS = (0, 7, 13, 19)


def voronoi(spark, sf):
    """Nearest center of each node by road, the smaller one on ties."""
    d = shortest(spark, sf).where(F.col("u").isin(*CENTERS))
    return _rounded(d.groupBy(F.col("v").alias("node")).agg(F.min(F.struct(F.round("len", 9).alias("length"), F.col("u").alias("center"))).alias("b")).select("node", "b.center", "b.length"))


register("graph_voronoi", voronoi, f"WITH {ROADS}, {CLOSURE} SELECT v AS node, arg_min(u, round(len, 9) * 1000 + u / 1000.0) AS center, round(min(len), 6) AS length FROM k6 WHERE u IN {CENTERS} GROUP BY v")


def corridor(spark, sf):
    """Shortest lengths of paths that pass regions 0, 2 and 3 (node % 4) in this order and stay in them: a search over (node, progress)."""
    order = [0, 2, 3]
    r = roads(spark, sf)
    place = lambda c: F.when(F.col(c) % 4 == order[0], 0).when(F.col(c) % 4 == order[1], 1).when(F.col(c) % 4 == order[2], 2)
    r = r.withColumns({"p": place("u"), "q": place("v")}).where("p IS NOT NULL AND q IS NOT NULL AND (q = p OR q = p + 1)")
    n = nodes(spark, sf).select("node").where(F.col("node") % 4 != 1)
    d = r.select("u", "v", "len").union(n.select("node", F.col("node").alias("v"), F.lit(0.0)))
    for _ in range(6):
        b = d.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("len").alias("more"))
        d = P._written(d.join(b, "v").groupBy("u", "w").agg(F.min(F.col("len") + F.col("more")).alias("len")).withColumnRenamed("w", "v"))
    return _rounded(d.where("u % 4 = 0 AND v % 4 = 3").select("u", "v", F.col("len").alias("length")))


_WAY = CLOSURE.replace("SELECT u, v, len FROM roads UNION ALL SELECT node, node, 0.0 FROM nodes", "SELECT u, v, len FROM way UNION ALL SELECT node, node, 0.0 FROM nodes WHERE node % 4 <> 1")
register("graph_corridor", corridor, f"WITH {ROADS}, pl AS (SELECT u, v, len, CASE u % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS p, CASE v % 4 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS q FROM roads), way AS (SELECT u, v, len FROM pl WHERE p IS NOT NULL AND q IS NOT NULL AND (q = p OR q = p + 1)), {_WAY} SELECT u, v, round(len, 6) AS length FROM k6 WHERE u % 4 = 0 AND v % 4 = 3")
