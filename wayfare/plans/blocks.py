"""The blocks that a trip releases: occupancy, transitions, dwell and portals, as whole units that sum to the budget.

Regions are a public grid of SIDE x SIDE cells over the order-line points; a segment lies in the region of its middle.
Lengths are whole micro-units, so masses, phases and remainders are exact on every engine.
"""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.functions import sequence as S
from wayfare.operators import graph as G
from wayfare.operators import mass as M
from wayfare.operators import privacy as P
from wayfare.registry import register
from wayfare.sources import views as V

from .distributions import _rounded, js_sql
from .measures import _HAMILTON, BUDGET
from .sequences import BOX, cell_sql, step

SIDE, PHASES = 4, 4
#: Shares of a trip, in hundredths, at which the next dwell bin begins.
DWELL = (5, 15, 35, 65)

SEGS = (
    f"{V.POINTS}, d0 AS (SELECT trip, side, seq, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)), "
    "d1 AS (SELECT trip, side, seq, (x0 + x) / 2 AS x, (y0 + y) / 2 AS y, CAST(round(sqrt((x - x0) * (x - x0) + ((y - y0) / 1000) * ((y - y0) / 1000)) * 1000000) AS BIGINT) AS len FROM d0 WHERE x0 IS NOT NULL), "
    f"segs AS (SELECT trip, side, seq, len, {cell_sql(SIDE)} AS region, CAST(sum(len) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(len) OVER (PARTITION BY trip) AS BIGINT) AS total FROM d1)"
)


def adjacency() -> dict[int, list[int]]:
    """Neighbours of each region of the grid."""
    near = {}
    for r in range(SIDE * SIDE):
        y, x = divmod(r, SIDE)
        near[r] = sorted(b * SIDE + a for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= a < SIDE and 0 <= b < SIDE)
    return near


#: (a, b, k, u, v): the k-th move of the public path from region a to b.
MOVES = [(a, b, k, *move) for a in adjacency() for b, path in G.region_paths(adjacency(), a).items() for k, move in enumerate(zip(path, path[1:], strict=False))]


def _portals() -> list[tuple[int, int, int, float, float, int]]:
    """(u, v, option, x, y, atom): two places on the border of each pair of neighbouring regions."""
    w, h = (BOX[1] - BOX[0]) / SIDE, (BOX[3] - BOX[2]) / 1000 / SIDE
    out = []
    for u, near in adjacency().items():
        for v in near:
            (a, b), (c, d) = divmod(u, SIDE), divmod(v, SIDE)  # a cell is x * SIDE + y
            for k in (0, 1):
                x = BOX[0] + (max(a, c) * w if a != c else (a + (k + 1) / 3) * w)
                y = BOX[2] / 1000 + (max(b, d) * h if b != d else (b + (k + 1) / 3) * h)
                out.append((u, v, k, x, y, len(out)))
    return out


PORTALS = _portals()


def _segs(spark, sf):
    p = V.points(spark, sf)
    p = p.withColumns({"x0": F.lag("x").over(step()), "y0": F.lag("y").over(step())}).where("x0 IS NOT NULL")
    dx, dy = F.col("x") - F.col("x0"), (F.col("y") - F.col("y0")) / 1000
    p = p.select("trip", "side", "seq", F.round(F.sqrt(dx * dx + dy * dy) * 1000000).cast("long").alias("len"), ((F.col("x0") + F.col("x")) / 2).alias("x"), ((F.col("y0") + F.col("y")) / 2).alias("y"))
    p = p.withColumn("region", S.cell(F.col("x"), BOX[0], BOX[1], SIDE) * SIDE + S.cell(F.col("y"), BOX[2], BOX[3], SIDE)).drop("x", "y")
    return p.withColumns({"upto": F.sum("len").over(step().rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("len").over(Window.partitionBy("trip"))})


def _phase(twice: str, total: str):
    """Phase of a place given as twice its distance from the start."""
    return F.least(F.lit(PHASES - 1), F.expr(f"({twice}) * {PHASES} div (2 * ({total}))")).cast("int")


def _phase_sql(twice, total):
    return f"CAST(least({PHASES - 1}, ({twice}) * {PHASES} // (2 * ({total}))) AS INT)"


def occupancy(spark, sf):
    s = _segs(spark, sf).where("total > 0")
    return s.groupBy("trip", "side", _phase("2 * upto - len", "total").alias("a"), F.col("region").alias("b")).agg(F.sum("len").alias("n"))


_OCC = f"c AS (SELECT trip, side, {_phase_sql('2 * upto - len', 'total')} AS a, region AS b, CAST(sum(len) AS BIGINT) AS n FROM segs WHERE total > 0 GROUP BY ALL)"


def _runs(spark, sf):
    """Runs of one region: (trip, side, seq, region, len, before, total)."""
    s = _segs(spark, sf).withColumn("new", F.when(F.col("region") == F.lag("region").over(step()), 0).otherwise(1))
    s = s.withColumn("run", F.sum("new").over(step().rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("trip", "side", "run").agg(F.first("region").alias("region"), F.sum("len").alias("len"), (F.max("upto") - F.sum("len")).alias("before"), F.max("total").alias("total")).withColumnRenamed("run", "seq")


_RUNS = "n0 AS (SELECT *, CASE WHEN region = lag(region) OVER (PARTITION BY trip ORDER BY seq) THEN 0 ELSE 1 END AS new FROM segs), n1 AS (SELECT *, sum(new) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM n0), rr AS (SELECT trip, side, CAST(run AS BIGINT) AS seq, min(region) AS region, CAST(sum(len) AS BIGINT) AS len, CAST(max(upto) - sum(len) AS BIGINT) AS before, max(total) AS total FROM n1 GROUP BY trip, side, run)"


def dwell(spark, sf):
    """Every run counts alike, by its phase and the bin of its share."""
    r = _runs(spark, sf)
    b = sum((F.when(F.col("len") * 100 >= F.greatest(F.col("total"), F.lit(1)) * x, 1).otherwise(0) for x in DWELL), F.lit(0))
    r = r.withColumn("total", F.greatest("total", F.lit(1)))
    return r.groupBy("trip", "side", _phase("2 * before + len", "total").alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))


_BIN = " + ".join(f"CASE WHEN len * 100 >= greatest(total, 1) * {x} THEN 1 ELSE 0 END" for x in DWELL)
_DWELL = f"{_RUNS}, c AS (SELECT trip, side, {_phase_sql('2 * before + len', 'greatest(total, 1)')} AS a, {_BIN} AS b, count(*) AS n FROM rr GROUP BY ALL)"


def _moved(spark, sf):
    """Moves between neighbouring regions, public paths put in where a trip jumps: (trip, side, idx, u, v, moves)."""
    r = _runs(spark, sf)
    m = r.select("trip", "side", "seq", F.col("region").alias("a"), F.lead("region").over(step()).alias("b")).where("b IS NOT NULL")
    paths = spark.createDataFrame(MOVES, "a int, b int, k int, u int, v int")
    m = m.join(F.broadcast(paths), ["a", "b"])  # regions squared, by their distance
    order = Window.partitionBy("trip").orderBy("seq", "k")
    return m.select("trip", "side", (F.row_number().over(order) - 1).alias("idx"), "u", "v", F.count(F.lit(1)).over(Window.partitionBy("trip")).alias("moves"))


_PATHS = f"paths(a, b, k, u, v) AS (VALUES {', '.join(map(str, MOVES))})"
_MOVED = f"{_RUNS}, m0 AS (SELECT trip, side, seq, region AS a, lead(region) OVER (PARTITION BY trip ORDER BY seq) AS b FROM rr), {_PATHS}, moved AS (SELECT trip, side, row_number() OVER (PARTITION BY trip ORDER BY seq, k) - 1 AS idx, u, v, count(*) OVER (PARTITION BY trip) AS moves FROM m0 JOIN paths ON m0.a = paths.a AND m0.b = paths.b)"


def _hold(spark, sf, c):
    """Trips without a move give all to the atom (-1, -1)."""
    rest = _segs(spark, sf).select("trip", "side").distinct().join(c.select("trip").distinct(), "trip", "left_anti")
    return c.union(rest.select("trip", "side", F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(1).cast("long").alias("n")))


def transitions(spark, sf):
    m = _moved(spark, sf)
    return _hold(spark, sf, m.groupBy("trip", "side", _phase("2 * idx + 1", "moves").alias("a"), (F.col("u") * SIDE * SIDE + F.col("v")).alias("b")).agg(F.count(F.lit(1)).alias("n")))


_REST = "UNION ALL SELECT DISTINCT trip, side, -1, -1, 1 FROM segs WHERE trip NOT IN (SELECT trip FROM moved)"
_TRANS = f"{_MOVED}, c AS (SELECT trip, side, {_phase_sql('2 * idx + 1', 'moves')} AS a, u * {SIDE * SIDE} + v AS b, count(*) AS n FROM moved GROUP BY ALL {_REST})"


def portals(spark, sf):
    """Each move takes the portal of its pair of regions that is nearest to the trip's point at the move's share of the way."""
    m = _moved(spark, sf)
    p = V.points(spark, sf).select("trip", F.col("seq").alias("place"), "x", (F.col("y") / 1000).alias("y"))
    n = p.groupBy("trip").agg(F.count(F.lit(1)).alias("points"))
    m = m.join(n, "trip").withColumn("place", F.least(F.col("points") - 1, F.expr("(2 * idx + 1) * points div (2 * moves)")) + 1)
    o = spark.createDataFrame(PORTALS, "u int, v int, option int, px double, py double, atom int")
    d = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
    m = m.join(p, ["trip", "place"]).join(F.broadcast(o), ["u", "v"])  # two rows a pair of neighbouring regions
    best = m.groupBy("trip", "side", "idx").agg(F.min(F.struct(d.alias("d"), "atom")).alias("best"))
    c = best.groupBy("trip", "side", F.lit(0).alias("a"), F.col("best.atom").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return _hold(spark, sf, c)


_OPTIONS = f"options(u, v, option, px, py, atom) AS (VALUES {', '.join(f'({u}, {v}, {k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {i})' for u, v, k, x, y, i in PORTALS)})"
_PORTALS = f"{_MOVED}, np AS (SELECT trip, count(*) AS points FROM points GROUP BY trip), {_OPTIONS}, g AS (SELECT m.trip, m.side, idx, atom FROM moved m JOIN np ON np.trip = m.trip JOIN points p ON p.trip = m.trip AND p.seq = 1 + least(points - 1, (2 * idx + 1) * points // (2 * moves)) JOIN options o ON o.u = m.u AND o.v = m.v QUALIFY row_number() OVER (PARTITION BY m.trip, idx ORDER BY (px - p.x) * (px - p.x) + (py - p.y / 1000) * (py - p.y / 1000), atom) = 1), c AS (SELECT trip, side, 0 AS a, atom AS b, count(*) AS n FROM g GROUP BY ALL {_REST})"

BLOCKS = {"occupancy": (occupancy, _OCC), "transitions": (transitions, _TRANS), "dwell": (dwell, _DWELL), "portals": (portals, _PORTALS)}


def released(spark, sf, name):
    """Units of each atom of a block by side, summed over trips; each trip gives BUDGET."""
    return P.quantised(BLOCKS[name][0](spark, sf), ["trip"], ["a", "b"], BUDGET).groupBy("side", "a", "b").agg(F.sum("units").cast("long").alias("units"), F.count(F.lit(1)).alias("trips"))


def _units_sql(name):
    return f"WITH {SEGS}, {BLOCKS[name][1]}, {_HAMILTON.format(atom='a, b')}"


def _released_sql(name):
    return f"{_units_sql(name)} SELECT side, CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(sum(units) AS BIGINT) AS units, count(*) AS trips FROM units GROUP BY side, a, b"


for _name in BLOCKS:
    register(f"dp_block_{_name}", lambda s, d, n=_name: released(s, d, n), _released_sql(_name))


def assembled(spark, sf):
    """All blocks of a release: atoms, trips and units of each, and its units a trip, which are the budget."""
    out = None
    for name in BLOCKS:
        q = P.quantised(BLOCKS[name][0](spark, sf), ["trip"], ["a", "b"], BUDGET)
        one = q.groupBy("a", "b").agg(F.sum("units").alias("units")).agg(F.lit(name).alias("block"), F.count(F.lit(1)).alias("atoms"), F.sum("units").cast("long").alias("units"))
        one = one.crossJoin(F.broadcast(q.agg(F.countDistinct("trip").alias("trips")))).select("block", "atoms", "units", "trips", F.expr("units div trips").alias("budget"))
        out = one if out is None else out.union(one)
    return out


register("dp_assembly", assembled, " UNION ALL ".join(f"SELECT '{n}' AS block, atoms, CAST(units AS BIGINT) AS units, trips, CAST(units // trips AS BIGINT) AS budget FROM ({_units_sql(n)} SELECT count(DISTINCT (a, b)) AS atoms, sum(units) AS units, count(DISTINCT trip) AS trips FROM units)" for n in BLOCKS))


def _portal_pairs(spark, sf):
    """(u, v, option, r, s) of every portal: its units on the real and on the synthetic side."""
    p = released(spark, sf, "portals").where("b >= 0").groupBy(F.col("b").alias("atom")).agg(*(F.sum(F.when(F.col("side") == k, F.col("units")).otherwise(0)).cast("double").alias(c) for k, c in ((0, "r"), (1, "s"))))
    o = spark.createDataFrame(PORTALS, "u int, v int, option int, px double, py double, atom int").select("u", "v", "option", "atom")
    return o.join(p, "atom", "left").fillna(0.0, ["r", "s"])


_PAIRS = f"rel AS ({{released}}), pp AS (SELECT u, v, option, atom, CAST(coalesce(sum(CASE WHEN side = 0 THEN units END), 0) AS DOUBLE) AS r, CAST(coalesce(sum(CASE WHEN side = 1 THEN units END), 0) AS DOUBLE) AS s FROM {'options'} LEFT JOIN rel ON rel.b = atom GROUP BY u, v, option, atom)"


def portal_scores(spark, sf):
    """Overlap, NDCG and first choice of the portals of each pair of regions, weighted by real mass; overlap and divergence of all; mass that noise of scale 2 budgets dominates."""
    noise = P.expected_noise(2.0 * BUDGET)
    p = _portal_pairs(spark, sf)
    k = Window.partitionBy("u", "v")
    p = p.withColumns({"tr": F.sum("r").over(k), "ts": F.sum("s").over(k), "i": F.row_number().over(k.orderBy(F.desc("r"), "option")), "j": F.row_number().over(k.orderBy(F.desc("s"), "option"))})
    share = F.when(F.col("ts") > 0, F.least(F.col("r") / F.col("tr"), F.col("s") / F.col("ts"))).otherwise(0.0)
    per = p.where("tr > 0").groupBy("u", "v").agg(F.max("tr").alias("mass"), F.sum(share).alias("cpc"), (F.sum(F.col("r") / F.log2(F.col("j") + 1.0)) / F.sum(F.col("r") / F.log2(F.col("i") + 1.0))).alias("ndcg"), F.max(F.when((F.col("i") == 1) & (F.col("j") == 1), 1.0).otherwise(0.0)).alias("top1"))
    mean = lambda c: (F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"context_{c}")
    one = per.agg(mean("cpc"), mean("ndcg"), mean("top1"), F.count(F.lit(1)).alias("contexts"))
    atoms = p.agg(F.count(F.lit(1)).alias("atoms"), (F.sum(F.when((F.col("r") > 0) & (F.col("r") <= noise), F.col("r")).otherwise(0.0)) / F.greatest(F.sum("r"), F.lit(1.0))).alias("dominated"))
    pairs = p.select("atom", "r", "s")
    return _rounded(one.crossJoin(atoms).crossJoin(M.cpc(pairs, "global_cpc")).crossJoin(M.jsd(pairs, "D", name="global_jsd")))


register(
    "dp_portal_scores",
    portal_scores,
    f"WITH {_OPTIONS}, {_PAIRS.format(released=_released_sql('portals'))}, q AS (SELECT *, sum(r) OVER () AS tr, sum(s) OVER () AS ts FROM pp), k AS (SELECT *, sum(r) OVER (PARTITION BY u, v) AS cr, sum(s) OVER (PARTITION BY u, v) AS cs, row_number() OVER (PARTITION BY u, v ORDER BY r DESC, option) AS i, row_number() OVER (PARTITION BY u, v ORDER BY s DESC, option) AS j FROM pp), "
    "per AS (SELECT max(cr) AS mass, sum(CASE WHEN cs > 0 THEN least(r / cr, s / cs) ELSE 0 END) AS cpc, sum(r / log2(j + 1)) / sum(r / log2(i + 1)) AS ndcg, max(CASE WHEN i = 1 AND j = 1 THEN 1.0 ELSE 0.0 END) AS top1 FROM k WHERE cr > 0 GROUP BY u, v) "
    f"SELECT round(sum(mass * cpc) / sum(mass), 6) AS context_cpc, round(sum(mass * ndcg) / sum(mass), 6) AS context_ndcg, round(sum(mass * top1) / sum(mass), 6) AS context_top1, count(*) AS contexts, (SELECT count(*) FROM pp) AS atoms, (SELECT round(sum(CASE WHEN r > 0 AND r <= {P.expected_noise(2.0 * BUDGET)!r} THEN r ELSE 0.0 END) / greatest(sum(r), 1.0), 6) FROM pp) AS dominated, (SELECT round(sum(least(r / tr, s / ts)), 6) FROM q) AS global_cpc, (SELECT round(sum({js_sql('(r / tr)', '(s / ts)')}) / ln(2.0), 6) FROM q) AS global_jsd FROM per",
)


def ablated(spark, sf):
    """The synthetic portal block with its pattern removed: the mass of each pair of regions spread evenly, and all masses shuffled among portals by hash."""
    p = _portal_pairs(spark, sf).withColumn("uniform", F.avg("s").over(Window.partitionBy("u", "v")))
    order = Window.orderBy(F.sha2(F.concat(F.lit("shuffle|"), F.col("atom").cast("string")), 256))  # two rows a pair of neighbouring regions
    p = p.withColumn("nth", F.row_number().over(order))
    other = p.select((F.col("nth") - 1).alias("atom"), F.col("s").alias("shuffled"))
    return _rounded(p.join(other, "atom").select("u", "v", "option", "s", "uniform", "shuffled"))


register("syn_ablation", ablated, f"WITH {_OPTIONS}, {_PAIRS.format(released=_released_sql('portals'))}, k AS (SELECT *, avg(s) OVER (PARTITION BY u, v) AS uniform, row_number() OVER (ORDER BY sha256('shuffle|' || CAST(atom AS VARCHAR))) - 1 AS nth FROM pp) SELECT a.u, a.v, a.option, round(a.s, 6) AS s, round(a.uniform, 6) AS uniform, round(b.s, 6) AS shuffled FROM k a JOIN k b ON b.nth = a.atom")


def expansion(spark, sf):
    """How often the public paths between regions are used to fill jumps, by pair of regions and length."""
    r = _runs(spark, sf).select("trip", F.col("region").alias("a"), F.lead("region").over(step()).alias("b")).where("b IS NOT NULL")
    paths = spark.createDataFrame(MOVES, "a int, b int, k int, u int, v int").groupBy("a", "b").agg(F.count(F.lit(1)).alias("moves"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda m: m["v"].cast("string")), "-").alias("path"))
    return r.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(paths), ["a", "b"])  # regions squared


register("seq_region_paths", expansion, f"WITH {SEGS}, {_RUNS}, {_PATHS}, m AS (SELECT region AS a, lead(region) OVER (PARTITION BY trip ORDER BY seq) AS b FROM rr), c AS (SELECT a, b, count(*) AS n FROM m WHERE b IS NOT NULL GROUP BY a, b), p AS (SELECT a, b, count(*) AS moves, string_agg(CAST(v AS VARCHAR), '-' ORDER BY k) AS path FROM paths GROUP BY a, b) SELECT c.a, c.b, n, moves, path FROM c JOIN p ON p.a = c.a AND p.b = c.b")


def noisy(spark, sf, rng=None):
    """A release of the portal block: its exact totals on the driver, discrete Laplace noise of a budget of one for all atoms of the public domain, drawn once, and their projection onto the simplex.

    The query draws from a seeded generator, so that it can be repeated; a release must not give `rng`.
    """
    domain = [-1, *range(len(PORTALS))]
    q = P.quantised(portals(spark, sf), ["trip"], ["a", "b"], BUDGET).groupBy("b").agg(F.sum("units").cast("long").alias("units"))
    exact = {r["b"]: r["units"] for r in q.collect()}  # atoms of the public grid
    drawn = P.release({k: exact.get(k, 0) for k in domain}, BUDGET, Fraction(1), rng)
    out = spark.createDataFrame([(k, v) for k, v in drawn.items()], "atom int, noisy long")
    total = sum(drawn.values())
    return _rounded(P.simplex(out.withColumn("x", F.col("noisy").cast("double")), "x", float(max(total, 1)), ["atom"]).select("atom", "noisy", "projected"), 3)


register("dp_noisy_portals", lambda s, d: noisy(s, d, random.Random(11)))
