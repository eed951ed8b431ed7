"""Decoding a release: requests, region kernels and their projections, bridges, portals, selection, materialised routes.

Random choices are drawn from hashes of a slot's number, so a task that runs again draws alike and every engine draws
the same. What is learned comes from released totals (side 1); nothing but the public grid and those reaches a draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.functions import sequence as S
from wayfare.operators import graph as G
from wayfare.operators import privacy as P
from wayfare.operators import spatial
from wayfare.operators import transport as T
from wayfare.registry import register
from wayfare.sources import views as V

from . import blocks as B
from .distributions import OD, _rounded
from .distributions import _ends as od_ends
from .roads import nodes, roads
from .sequences import BOX

REGIONS = B.SIDE * B.SIDE
#: Share of a row that public support gets, tilt and cap of a projection, and sharpness of a selection.
FLOOR, TILT, CAP, SHARP = 0.01, 0.5, 4.0, 2.0
BETAS = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)


def uniform(seed: str, *ids):
    """A number in (0, 1) from a hash."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *(i.cast("string") for i in ids)), 256)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def uniform_sql(seed: str, *ids: str) -> str:
    said = " || '|' || ".join([f"'{seed}'", *(f"CAST({i} AS VARCHAR)" for i in ids)])
    return f"((CAST('0x' || substr(sha256({said}), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0)"


def _drawn(law, slots, seed):
    """slots with the row of `law` (key columns, n) whose stretch of the running share holds the slot's draw; law is a bounded table of cells."""
    keys = [c for c in law.columns if c != "n"]
    w = Window.orderBy(*keys)  # cells of the public grid
    law = law.withColumns({"nth": F.row_number().over(w), "upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy())})
    ends = law.agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", (F.col("upto") / F.col("all")).alias("u")))), lambda x: x["u"]).alias("ends"))
    s = slots.crossJoin(F.broadcast(ends)).withColumn("nth", F.least(F.size("ends"), F.size(F.filter("ends", lambda e: e <= uniform(seed, F.col("slot")))) + 1)).drop("ends")
    return s.join(F.broadcast(law.select("nth", *keys)), "nth").drop("nth")


def _slots(spark, sf):
    return V.slots(spark, sf).where("side = 1").select(F.col("trip").alias("slot"))


_SLOTS = f"{V.SLOTS}, sl AS (SELECT trip AS slot FROM slots WHERE side = 1)"


def requests(spark, sf):
    """Origins and destinations drawn jointly for every synthetic slot from the released matrix."""
    law = od_ends(spark, sf).where("side = 1").groupBy("o", "d").agg(F.count(F.lit(1)).alias("n"))
    return _drawn(law, _slots(spark, sf), "request").groupBy("o", "d").agg(F.count(F.lit(1)).alias("requests"))


_LAW = "law AS (SELECT o, d, CAST(s AS BIGINT) AS n FROM p WHERE s > 0), cum AS (SELECT *, CAST(sum(n) OVER (ORDER BY o, d ROWS UNBOUNDED PRECEDING) - n AS DOUBLE) / sum(n) OVER () AS lo, CAST(sum(n) OVER (ORDER BY o, d ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER () AS hi FROM law)"
register("syn_requests", requests, f"WITH {OD}, {_SLOTS}, {_LAW}, u AS (SELECT {uniform_sql('request', 'slot')} AS u FROM sl) SELECT o, d, count(*) AS requests FROM u JOIN cum ON u >= lo AND u < hi GROUP BY o, d")


def baseline(spark, sf):
    """Origin and destination drawn independently from their own laws: the baseline that knows no pairs."""
    e = od_ends(spark, sf).where("side = 1")
    s = _drawn(e.groupBy("o").agg(F.count(F.lit(1)).alias("n")), _slots(spark, sf), "origin")
    s = _drawn(e.groupBy("d").agg(F.count(F.lit(1)).alias("n")), s, "destination")
    return s.groupBy("o", "d").agg(F.count(F.lit(1)).alias("requests"))


def _one(k):
    return f"l{k} AS (SELECT {k}, sum(s) AS n FROM p GROUP BY {k} HAVING sum(s) > 0), c{k} AS (SELECT {k}, CAST(sum(n) OVER (ORDER BY {k} ROWS UNBOUNDED PRECEDING) - n AS DOUBLE) / sum(n) OVER () AS lo, CAST(sum(n) OVER (ORDER BY {k} ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER () AS hi FROM l{k})"


register("syn_baseline", baseline, f"WITH {OD}, {_SLOTS}, {_one('o')}, {_one('d')}, u AS (SELECT {uniform_sql('origin', 'slot')} AS a, {uniform_sql('destination', 'slot')} AS b FROM sl) SELECT o, d, count(*) AS requests FROM u JOIN co ON a >= co.lo AND a < co.hi JOIN cd ON b >= cd.lo AND b < cd.hi GROUP BY o, d")


def _support(spark):
    """Public moves between neighbouring regions."""
    return spark.createDataFrame([(u, v) for u, near in B.adjacency().items() for v in near], "u int, v int")


def _kernel(spark, sf, side):
    """Row-stochastic law of moves with FLOOR of every row spread over its public support."""
    n = B._moved(spark, sf).where(F.col("side") == side).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    k = _support(spark).join(n, ["u", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("u")
    share = F.when(F.sum("n").over(w) > 0, F.col("n") / F.sum("n").over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w))
    return k.select("u", "v", ((1 - FLOOR) * share + FLOOR / F.count(F.lit(1)).over(w)).alias("p"))


def kernel(spark, sf):
    return _rounded(_kernel(spark, sf, 1))


_SUPPORT = f"support(u, v) AS (VALUES {', '.join(str((u, v)) for u, near in B.adjacency().items() for v in near)})"


def _kernel_sql(name, side):
    return f"{name}n AS (SELECT u, v, count(*) AS n FROM moved WHERE side = {side} GROUP BY u, v), {name}s AS (SELECT s.u, s.v, coalesce(n, 0) AS n FROM support s LEFT JOIN {name}n m ON m.u = s.u AND m.v = s.v), {name} AS (SELECT u, v, {1 - FLOOR!r}::DOUBLE * CASE WHEN sum(n) OVER w > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER w ELSE CAST(1 AS DOUBLE) / count(*) OVER w END + {FLOOR!r}::DOUBLE / count(*) OVER w AS p FROM {name}s WINDOW w AS (PARTITION BY u))"


register("syn_kernel", kernel, f"WITH {B.SEGS}, {B._MOVED}, {_SUPPORT}, {_kernel_sql('k', 1)} SELECT u, v, round(p, 6) AS p FROM k")


def projection(spark, sf):
    """The kernel of all trips drawn towards that of one corpus: log ratios are cut at CAP, weighted by TILT, and rows made to sum to one."""
    a, b = _kernel(spark, sf, 1), _kernel(spark, sf, 0).withColumnRenamed("p", "q")
    r = F.greatest(F.lit(-float(np.log(CAP))), F.least(F.lit(float(np.log(CAP))), F.ln(F.col("q") / F.col("p"))))
    k = a.join(b, ["u", "v"]).withColumn("t", F.col("p") * F.exp(TILT * r))
    return _rounded(k.select("u", "v", (F.col("t") / F.sum("t").over(Window.partitionBy("u"))).alias("p")))


register("syn_projection", projection, f"WITH {B.SEGS}, {B._MOVED}, {_SUPPORT}, {_kernel_sql('ka', 1)}, {_kernel_sql('kb', 0)}, t AS (SELECT ka.u, ka.v, ka.p * exp({TILT} * greatest(-ln({CAP}::DOUBLE), least(ln({CAP}::DOUBLE), ln(kb.p / ka.p)))) AS t FROM ka JOIN kb ON ka.u = kb.u AND ka.v = kb.v) SELECT u, v, round(t / sum(t) OVER (PARTITION BY u), 6) AS p FROM t")


def _bridges(spark, sf):
    """Costs of the public moves and the released kernel as dense arrays of the public grid."""
    k = np.zeros((REGIONS, REGIONS))
    for r in _kernel(spark, sf, 1).collect():  # moves between neighbouring regions
        k[r["u"], r["v"]] = r["p"]
    return k


def _targets(spark, sf):
    """Mean number of moves of the synthetic trips by their first and last region."""
    r = B._runs(spark, sf).where("side = 1").groupBy("trip").agg(F.min_by("region", "seq").alias("o"), F.max_by("region", "seq").alias("d"))
    m = B._moved(spark, sf).groupBy("trip").agg(F.max("moves").alias("moves"))
    return r.join(m, "trip").where("o != d").groupBy("o", "d").agg(F.avg("moves").alias("target"), F.count(F.lit(1)).alias("trips"))


BRIDGE = "o int, d int, trips long, target double, beta double, moves double"


def _chosen(kernel, d, o, target):
    """(beta, law, expected moves) of the bridge whose expected number of moves comes nearest to the target."""
    best = None
    for beta in BETAS:
        law = G.killed_bridge(kernel, d, beta)
        moves = G.expected_moves(law, o, d)
        if best is None or abs(moves - target) < abs(best[2] - target) - 1e-12:
            best = (beta, law, moves)
    return best


def bridges(spark, sf):
    """For each origin and destination the sharpness of the bridge whose walks are about as long as the released trips."""
    shared = spark.sparkContext.broadcast(_bridges(spark, sf))  # regions squared

    def choose(batches):
        for p in batches:
            rows = [(o, d, n, t, *[_chosen(shared.value, d, o, t)[i] for i in (0, 2)]) for o, d, n, t in zip(p["o"], p["d"], p["trips"], p["target"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BRIDGE.split(", ")])

    return _rounded(_targets(spark, sf).select("o", "d", "trips", "target").mapInPandas(choose, BRIDGE))


register("syn_bridges", bridges)
#: Longest walk of a slot; one that has not arrived by then takes the public path from where it stands.
LONGEST = 64


def _walked(law, o, d, slot):
    rng, x, path = np.random.default_rng(slot), o, [o]
    while x != d and len(path) <= LONGEST:
        x = int(rng.choice(len(law), p=law[x]))
        path.append(x)
    if x != d:
        path += G.region_paths(B.adjacency(), x)[d][1:]
    return path


def walks(spark, sf):
    """A walk through the regions for every synthetic trip's origin and destination, drawn from its bridge: (slot, regions)."""
    shared = spark.sparkContext.broadcast(_bridges(spark, sf))
    r = B._runs(spark, sf).where("side = 1").groupBy("trip").agg(F.min_by("region", "seq").alias("o"), F.max_by("region", "seq").alias("d"))
    t = r.join(_targets(spark, sf), ["o", "d"]).select(F.col("trip").alias("slot"), "o", "d", "target")

    def walk(batches):
        laws = {}
        for p in batches:
            rows = []
            for slot, o, d, target in zip(p["slot"], p["o"], p["d"], p["target"], strict=True):
                if (o, d) not in laws:
                    laws[o, d] = _chosen(shared.value, d, o, target)[1]
                rows.append((slot, _walked(laws[o, d], o, d, int(slot))))
            yield pd.DataFrame(rows, columns=["slot", "regions"])

    return t.mapInPandas(walk, "slot long, regions array<int>")


def walk_summary(spark, sf):
    w = walks(spark, sf)
    return _rounded(w.groupBy(F.get("regions", F.lit(0)).alias("o"), F.element_at("regions", -1).alias("d")).agg(F.count(F.lit(1)).alias("slots"), F.avg(F.size("regions") - 1).alias("moves")))


register("syn_walks", walk_summary)


def portal_choice(spark, sf):
    """The portal of every synthetic move, drawn in proportion to exp(-distance / mean distance) times released mass plus one."""
    m = B._moved(spark, sf).where("side = 1")
    p = V.points(spark, sf).select("trip", F.col("seq").alias("place"), "x", (F.col("y") / 1000).alias("y"))
    n = p.groupBy("trip").agg(F.count(F.lit(1)).alias("points"))
    m = m.join(n, "trip").withColumn("place", F.least(F.col("points") - 1, F.expr("(2 * idx + 1) * points div (2 * moves)")) + 1).join(p, ["trip", "place"])
    o = spark.createDataFrame(B.PORTALS, "u int, v int, option int, px double, py double, atom int").join(B._portal_pairs(spark, sf).select("u", "v", "option", "s"), ["u", "v", "option"])
    d = spatial.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    m = m.join(F.broadcast(o), ["u", "v"]).withColumn("d", d)  # two rows a pair of neighbouring regions
    k = Window.partitionBy("trip", "idx")
    gumbel = -F.ln(-F.ln(uniform("portal", F.col("trip"), F.col("idx"), F.col("option"))))
    m = m.withColumn("score", -F.col("d") / F.greatest(F.avg("d").over(k), F.lit(1e-9)) + F.ln(F.col("s") + 1.0) + gumbel)
    best = m.groupBy("trip", "idx").agg(F.max_by(F.struct("u", "v", "option"), "score").alias("b"))
    return best.groupBy("b.u", "b.v", "b.option").agg(F.count(F.lit(1)).alias("moves"))


register("syn_portal_choice", portal_choice, f"WITH {B.SEGS}, {B._MOVED}, {B._OPTIONS}, {B._PAIRS.format(released=B._released_sql('portals'))}, np AS (SELECT trip, count(*) AS points FROM points GROUP BY trip), c AS (SELECT m.trip, m.idx, o.u, o.v, o.option, sqrt((o.px - p.x) * (o.px - p.x) + (o.py - p.y / 1000) * (o.py - p.y / 1000)) AS d, pp.s FROM moved m JOIN np ON np.trip = m.trip JOIN points p ON p.trip = m.trip AND p.seq = 1 + least(points - 1, (2 * idx + 1) * points // (2 * moves)) JOIN options o ON o.u = m.u AND o.v = m.v JOIN pp ON pp.atom = o.atom WHERE m.side = 1), z AS (SELECT *, -d / greatest(avg(d) OVER (PARTITION BY trip, idx), 1e-9) + ln(s + 1.0) - ln(-ln({uniform_sql('portal', 'trip', 'idx', 'option')})) AS score FROM c), b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY trip, idx ORDER BY score DESC) = 1) SELECT u, v, option, count(*) AS moves FROM b GROUP BY u, v, option")


def length_selection(spark, sf):
    """Of a trip's own length, half of it and twice it, one is drawn by how near it comes to the mean of its ends: softmax of -SHARP * |ln ratio|."""
    r = B._runs(spark, sf).groupBy("trip", "side").agg(F.min_by("region", "seq").alias("o"), F.max_by("region", "seq").alias("d"), (F.max("total") / 1000000.0).alias("len")).where("side = 1")
    t = r.withColumn("target", F.avg("len").over(Window.partitionBy("o", "d")))
    c = t.select("trip", "target", F.posexplode(F.array(F.col("len"), F.col("len") / 2, F.col("len") * 2)).alias("proposal", "l"))
    score = -SHARP * F.abs(F.ln((F.col("l") + 0.1) / (F.col("target") + 0.1))) - F.ln(-F.ln(uniform("length", F.col("trip"), F.col("proposal"))))
    b = c.withColumn("score", score).groupBy("trip").agg(F.max_by(F.struct("proposal", "l"), "score").alias("b"))
    return _rounded(b.groupBy("b.proposal").agg(F.count(F.lit(1)).alias("trips"), F.sum("b.l").alias("length")), 3)


register("syn_length_selection", length_selection, f"WITH {B.SEGS}, {B._RUNS}, r AS (SELECT trip, arg_min(region, seq) AS o, arg_max(region, seq) AS d, max(total) / 1000000.0 AS len FROM rr WHERE side = 1 GROUP BY trip), t AS (SELECT *, avg(len) OVER (PARTITION BY o, d) AS target FROM r), c AS (SELECT trip, target, CAST(k AS INT) AS proposal, len * CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END AS l FROM t, range(3) q(k)), z AS (SELECT *, {-SHARP} * abs(ln((l + 0.1) / (target + 0.1))) - ln(-ln({uniform_sql('length', 'trip', 'proposal')})) AS score FROM c), b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY trip ORDER BY score DESC) = 1) SELECT proposal, count(*) AS trips, round(sum(l), 3) AS length FROM b GROUP BY proposal")


def materialised(spark, sf):
    """Routes of synthetic orders as six coordinates each, with the nodes they pass as their witness."""
    h = V.hops(spark, sf).where("side = 1").select("trip", "seq", "node")
    p = h.join(F.broadcast(nodes(spark, sf)), "node")  # the nations
    w = h.groupBy("trip").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node"))), lambda x: x["node"].cast("string")), "-").alias("witness"))
    return _rounded(spatial.resampled(p.select("trip", "seq", "x", "y"), 6).join(w, "trip").select("trip", "k", "x", "y", "witness"), 5)


register("syn_materialised", materialised, f"WITH {V.HOPS}, no AS (SELECT n_nationkey AS node, (n_nationkey * 7 % 25) * 2.0::DOUBLE AS x, (n_nationkey * 11 % 25) * 4.0::DOUBLE AS y FROM nation), w AS (SELECT trip, string_agg(CAST(node AS VARCHAR), '-' ORDER BY seq) AS witness FROM hops WHERE side = 1 GROUP BY trip), a AS (SELECT trip, row_number() OVER w AS nth, no.x AS x0, no.y AS y0, lead(no.x) OVER w AS x1, lead(no.y) OVER w AS y1 FROM hops JOIN no ON no.node = hops.node WHERE side = 1 WINDOW w AS (PARTITION BY trip ORDER BY seq)), s0 AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM a WHERE x1 IS NOT NULL), s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY trip ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len) OVER (PARTITION BY trip) AS total, max(nth) OVER (PARTITION BY trip) AS n FROM s0), k AS (SELECT *, total * k / 5.0 AS spot FROM s, range(6) r(k)), i AS (SELECT *, greatest(0.0, least(1.0, (spot - start) / len)) AS f FROM k WHERE (spot >= start OR nth = 1) AND (spot < start + len OR nth = n) QUALIFY row_number() OVER (PARTITION BY trip, k ORDER BY nth) = 1) SELECT i.trip, CAST(k AS INT) AS k, round(x0 + (x1 - x0) * f, 5) AS x, round(y0 + (y1 - y0) * f, 5) AS y, witness FROM i JOIN w ON w.trip = i.trip")

#: Rounds of the alternating scaling.
ROUNDS = 12


def scaled(spark, sf):
    """The synthetic matrix of ends scaled to the real margins, row and column in turn."""
    e = od_ends(spark, sf).groupBy("o", "d").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("s")).collect()  # cells of the public grid
    m, r = np.zeros((16, 16)), np.zeros((16, 16))
    for x in e:
        m[x["o"], x["d"]], r[x["o"], x["d"]] = x["s"], x["r"]
    out = P.sinkhorn(m + 0.5, r.sum(axis=1), r.sum(axis=0), ROUNDS)
    return _rounded(spark.createDataFrame([(i, j, float(out[i, j])) for i in range(16) for j in range(16)], "o int, d int, mass double"), 4)


def _sinkhorn_sql():
    steps, at = [], "m0"
    for i in range(ROUNDS):
        steps.append(f"a{i} AS (SELECT x.o, x.d, x.m * coalesce(max(h.r), 0) / sum(x.m) OVER (PARTITION BY x.o) AS m FROM {at} x LEFT JOIN ro h ON h.o = x.o GROUP BY x.o, x.d, x.m), m{i + 1} AS (SELECT x.o, x.d, x.m * coalesce(max(h.r), 0) / greatest(sum(x.m) OVER (PARTITION BY x.d), 1e-300) AS m FROM a{i} x LEFT JOIN rd h ON h.d = x.d GROUP BY x.o, x.d, x.m)")
        at = f"m{i + 1}"
    return f"WITH {OD}, m0 AS (SELECT CAST(i // 16 AS INT) AS o, CAST(i % 16 AS INT) AS d, coalesce(p.s, 0) + 0.5 AS m FROM range(256) q(i) LEFT JOIN p ON p.o = i // 16 AND p.d = i % 16), ro AS (SELECT o, sum(r) AS r FROM p GROUP BY o), rd AS (SELECT d, sum(r) AS r FROM p GROUP BY d), {', '.join(steps)} SELECT o, d, round(m, 4) AS mass FROM {at}"


register("dp_sinkhorn", scaled, _sinkhorn_sql())

#: Routes of a stratum and side that are matched, those of least hashes, and least trips of a head family.
STRATUM, HEAD = 20, 20


def physical(spark, sf):
    """Road mass of the synthetic corpus that an optimal transport matches to the real one, over real and over synthetic mass, by strata of first and last region; at most STRATUM routes of a stratum and side, by hash."""
    e = V.edges(spark, sf)
    r = e.groupBy("trip", "side").agg(F.min_by("ru", "seq").alias("o"), F.max_by("rv", "seq").alias("d"), F.array_sort(F.collect_list(F.struct("seq", "u", "v"))).alias("walk"))
    w = Window.partitionBy("o", "d", "side")
    r = r.withColumns({"all": F.count(F.lit(1)).over(w), "nth": F.row_number().over(w.orderBy(F.sha2(F.col("trip").cast("string"), 256)))}).where(F.col("nth") <= STRATUM)
    r = r.select("o", "d", "side", "all", F.transform("walk", lambda x: x["u"] * 1000 + x["v"]).alias("route"))
    m = r.groupBy("o", "d").applyInPandas(T.matched_stratum, T.MATCHED)
    n = e.groupBy("side").agg(F.countDistinct("trip").alias("n")).agg(*(F.max(F.when(F.col("side") == k, F.col("n"))).alias(f"n{k}") for k in (0, 1)))
    m = m.crossJoin(F.broadcast(n)).withColumns({"p": F.col("real_all") / F.col("n0"), "q": F.col("syn_all") / F.col("n1")})
    t = m.agg(F.sum(F.least("p", "q") * F.col("matched")).alias("m"), F.sum(F.col("p") * F.col("real")).alias("r"), F.sum(F.col("q") * F.col("syn")).alias("s"), F.count(F.lit(1)).alias("strata"))
    return _rounded(t.select((F.col("m") / F.col("r")).alias("recovery"), (F.col("m") / F.col("s")).alias("support"), "strata"))


register("route_physical_match", physical)


def _families(spark, sf):
    from wayfare.operators import routes as R

    return R.families(V.edges(spark, sf))


def family_router(spark, sf):
    """Slots that the head families of the real corpus get among the synthetic ones, and how many have a carrier: whole slots by largest remainder."""
    f = _families(spark, sf)
    c = f.groupBy("family").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("carriers"))
    total = f.agg(F.count_if(F.col("side") == 0).alias("source"), F.count_if(F.col("side") == 1).alias("slots"))
    h = c.where(F.col("n") >= HEAD).crossJoin(F.broadcast(total))
    mass = h.agg(F.sum("n").alias("mass"))
    h = h.crossJoin(F.broadcast(mass)).withColumn("wanted", F.round(F.col("mass") / F.col("source") * F.col("slots")).cast("long"))
    h = h.withColumns({"q": F.expr("wanted * n div mass"), "r": F.expr("(wanted * n) % mass")})
    w = Window.partitionBy()  # head families, at most slots / HEAD
    h = h.withColumns({"rest": F.col("wanted") - F.sum("q").over(w), "i": F.row_number().over(Window.orderBy(F.desc("r"), "family"))})
    h = h.withColumn("count", F.col("q") + F.when(F.col("i") <= F.col("rest"), 1).otherwise(0))
    return h.select("family", "n", "carriers", F.col("count").cast("long").alias("slots_wanted"), F.when(F.col("carriers") > 0, F.col("count")).otherwise(0).cast("long").alias("slots_realised"))


_FAM = f"{V.EDGES}, f0 AS (SELECT trip, side, 0 AS seq, ru AS region FROM edges WHERE seq = 1 UNION ALL SELECT trip, side, seq, rv FROM edges), f1 AS (SELECT *, lag(region) OVER (PARTITION BY trip ORDER BY seq) AS b FROM f0), fam AS (SELECT trip, side, string_agg(CAST(region AS VARCHAR), '-' ORDER BY seq) AS family FROM f1 WHERE b IS NULL OR b <> region GROUP BY trip, side)"
register("route_family_slots", family_router, f"WITH {_FAM}, c AS (SELECT family, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS carriers FROM fam GROUP BY family), t AS (SELECT count(*) FILTER (side = 0) AS source, count(*) FILTER (side = 1) AS slots FROM fam), h AS (SELECT *, sum(n) OVER () AS mass FROM c, t WHERE n >= {HEAD}), g AS (SELECT *, CAST(round(CAST(mass AS DOUBLE) / source * slots) AS BIGINT) AS wanted FROM h), q AS (SELECT *, wanted * n // mass AS q, (wanted * n) % mass AS r FROM g), k AS (SELECT *, wanted - sum(q) OVER () AS rest, row_number() OVER (ORDER BY r DESC, family) AS i FROM q) SELECT family, n, carriers, CAST(q + CASE WHEN i <= rest THEN 1 ELSE 0 END AS BIGINT) AS slots_wanted, CAST(CASE WHEN carriers > 0 THEN q + CASE WHEN i <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS slots_realised FROM k")


def residual(spark, sf):
    """Share of the slots that keep their own route so that the head families still reach their real shares: beta + sum of max(target - beta * own, 0) is 1."""
    f = _families(spark, sf)
    c = f.groupBy("family").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("s"))
    t = c.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    h = c.where(F.col("n") >= HEAD).crossJoin(F.broadcast(t)).select((F.col("n") / F.col("tn")).alias("w"), (F.col("s") / F.col("ts")).alias("q"))
    a = h.agg(F.collect_list(F.struct("w", "q")).alias("h"))  # head families, at most slots / HEAD
    value = lambda b: F.aggregate("h", F.lit(0.0), lambda z, x: z + F.greatest(x["w"] - b * x["q"], F.lit(0.0))) + b
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(value(mid) < 1, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve)
    return _rounded(a.select(F.size("h").alias("families"), ((end["lo"] + end["hi"]) / 2).alias("beta")))


register("route_residual_share", residual, f"WITH RECURSIVE {_FAM}, c AS (SELECT family, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS s FROM fam GROUP BY family), t AS (SELECT sum(n) AS tn, sum(s) AS ts FROM c), h AS (SELECT list({{'w': CAST(n AS DOUBLE) / tn, 'q': CAST(s AS DOUBLE) / ts}}) AS h FROM c, t WHERE n >= {HEAD}), bi(k, lo, hi, h) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, h FROM h UNION ALL SELECT k + 1, CASE WHEN (lo + hi) / 2 + coalesce(list_sum(list_transform(h, lambda x : greatest(x.w - (lo + hi) / 2 * x.q, 0.0))), 0) < 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN (lo + hi) / 2 + coalesce(list_sum(list_transform(h, lambda x : greatest(x.w - (lo + hi) / 2 * x.q, 0.0))), 0) < 1 THEN hi ELSE (lo + hi) / 2 END, h FROM bi WHERE k < 50) SELECT CAST(len(h) AS INT) AS families, round((lo + hi) / 2, 6) AS beta FROM bi WHERE k = 50")


LIFTED = "slot long, kind string, path array<long>"


def lifted(spark, sf):
    """(slot, kind, path): walks through regions as paths of roads. The ends are the least nodes of the first and the last region that has any; the path stays in the walk's regions (restricted), or where that fails is the shortest of all (fallback), or null (none)."""
    r = roads(spark, sf).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("len").alias("length"))
    shared = spark.sparkContext.broadcast(G.Graph.collected(r))
    place = S.cell(F.col("x"), BOX[0], BOX[1], B.SIDE) * B.SIDE + S.cell(F.col("y") * 1000, BOX[2], BOX[3], B.SIDE)
    label = {x["node"]: x["region"] for x in nodes(spark, sf).select("node", place.alias("region")).collect()}  # the nations

    def lift(batches):
        g, known = shared.value, {}
        region = np.array([label[int(n)] for n in g.nodes])

        def of(walk):
            held = [r for r in walk if (region == r).any()]
            if not held:
                return "none", None
            a, b = (int(g.nodes[np.flatnonzero(region == r)[0]]) for r in (held[0], held[-1]))
            path = g.path(a, b, allowed=np.isin(region, walk))
            if path is not None:
                return "restricted", path
            path = g.path(a, b)
            return ("none", None) if path is None else ("fallback", path)

        for p in batches:
            rows = []
            for slot, walk in zip(p["slot"], p["regions"], strict=True):
                key = tuple(int(x) for x in walk)
                if key not in known:
                    if len(known) >= 50_000:
                        known.clear()
                    known[key] = of(key)
                rows.append((slot, *known[key]))
            yield pd.DataFrame(rows, columns=["slot", "kind", "path"])

    return walks(spark, sf).mapInPandas(lift, LIFTED)


def lift_summary(spark, sf):
    return _rounded(lifted(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("slots"), F.avg(F.size("path")).alias("nodes")))


register("syn_lifted", lift_summary)
