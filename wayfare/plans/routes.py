"""Route measures and road choices over supplier nations along orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare import registry
from wayfare.operators import mass as M
from wayfare.operators import ranking as K
from wayfare.operators import routes as R
from wayfare.registry import register
from wayfare.sources import views as V

from .distributions import Q, _rounded, js_sql

E = V.EDGES
_EDGE_P = f"{E}, p AS (SELECT u, v, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM edges GROUP BY u, v)"
_TURNS = f"{E}, turns AS (SELECT * FROM (SELECT *, lead(v) OVER (PARTITION BY trip ORDER BY seq) AS w FROM edges) WHERE w IS NOT NULL)"
_TURN_P = f"{_TURNS}, p AS (SELECT u, v, w, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM turns GROUP BY u, v, w)"
_CPC = "SELECT round(sum(least(r / tr, s / ts)), 6) AS cpc FROM q"


def edges(spark, sf):
    return V.edges(spark, sf)


register("route_edge_counts", lambda s, d: M.pairs(edges(s, d), ["u", "v"]), f"WITH {_EDGE_P} SELECT u, v, r, s FROM p")
register("route_edge_cpc", lambda s, d: _rounded(M.cpc(M.pairs(edges(s, d), ["u", "v"]))), f"WITH {_EDGE_P}, {Q} {_CPC}")
register("route_turn_cpc", lambda s, d: _rounded(M.cpc(M.pairs(R.turns(edges(s, d)), ["u", "v", "w"]))), f"WITH {_TURN_P}, {Q} {_CPC}")
register("route_turn_support", lambda s, d: _rounded(M.support(M.pairs(R.turns(edges(s, d)), ["u", "v", "w"]))), f"WITH {_TURN_P}, c AS (SELECT CAST(count(*) FILTER (r > 0 AND s > 0) AS DOUBLE) AS b, count(*) FILTER (r > 0) AS nr, count(*) FILTER (s > 0) AS ns FROM p) SELECT round(b / nr, 6) AS recall, round(b / ns, 6) AS precision, round(2 * (b / nr) * (b / ns) / (b / nr + b / ns), 6) AS f1 FROM c")


def road_yield(spark, sf):
    """Connected routes as a share of slots, and routes of at least three edges, by side."""
    n = R.valid(edges(spark, sf)).groupBy("trip").agg(F.count(F.lit(1)).alias("n"))
    s = V.slots(spark, sf).join(n, "trip", "left")
    return _rounded(s.groupBy("side").agg(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("yield"), F.avg(F.when(F.col("n") >= 3, 1.0).otherwise(0.0)).alias("long_yield"), F.count(F.lit(1)).alias("slots")))


register("route_yield", road_yield, f"WITH {E}, {V.SLOTS}, n AS (SELECT trip, count(*) AS n FROM edges GROUP BY trip) SELECT side, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS yield, round(avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END), 6) AS long_yield, count(*) AS slots FROM slots LEFT JOIN n USING (trip) GROUP BY side")


def turn_fidelity(spark, sf):
    """Bounded turn fidelity and the normalised overlap of unit decision masses."""
    e = edges(spark, sf)
    d = R.decisions(e, R.outdegree(e), V.slots(spark, sf))
    p = M.pairs(d, ["u", "v", "w"], "mass")
    q = M.with_totals(p).agg(F.sum(F.least("r", "s")).alias("both"), F.max("tr").alias("real"))
    return _rounded(q.select(F.when(F.col("real") > 0, F.least(F.lit(1.0), F.col("both") / F.col("real"))).otherwise(0.0).alias("btf")).crossJoin(F.broadcast(M.cpc(p, "rc_cpc"))))


register("route_turn_fidelity", turn_fidelity, f"WITH {_TURNS}, {V.SLOTS}, k AS (SELECT u AS v, count(DISTINCT v) AS k FROM edges GROUP BY u), n AS (SELECT side, count(*) AS slots FROM slots GROUP BY side), d AS (SELECT t.side, t.u, t.v, t.w, 1.0 / (CAST(slots AS DOUBLE) * count(*) OVER (PARTITION BY trip)) AS mass FROM turns t JOIN k ON t.v = k.v AND k.k > 1 JOIN n ON n.side = t.side), p AS (SELECT u, v, w, coalesce(sum(mass) FILTER (side = 0), 0) AS r, coalesce(sum(mass) FILTER (side = 1), 0) AS s FROM d GROUP BY u, v, w), {Q} SELECT round(least(1.0, sum(least(r, s)) / max(tr)), 6) AS btf, round(sum(least(r / tr, s / ts)), 6) AS rc_cpc FROM q")

_FAMILY = f"{E}, f0 AS (SELECT trip, side, 0 AS seq, ru AS region FROM edges WHERE seq = 1 UNION ALL SELECT trip, side, seq, rv FROM edges), f1 AS (SELECT *, lag(region) OVER (PARTITION BY trip ORDER BY seq) AS b FROM f0), fam AS (SELECT trip, side, list(region ORDER BY seq) AS path FROM f1 WHERE b IS NULL OR b <> region GROUP BY trip, side)"
register("route_family_cpc", lambda s, d: _rounded(M.cpc(M.pairs(R.families(edges(s, d)), ["family"]))), f"WITH {_FAMILY}, p AS (SELECT path, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM fam GROUP BY path), {Q} {_CPC}")
register("route_branches", lambda s, d: _rounded(R.branches(edges(s, d))), f"WITH {_TURNS}, m AS (SELECT *, 1.0 / CAST(count(*) OVER (PARTITION BY trip) AS DOUBLE) AS m FROM turns), c AS (SELECT u, v, w, coalesce(sum(m) FILTER (side = 0), 0) AS r, coalesce(sum(m) FILTER (side = 1), 0) AS s FROM m GROUP BY u, v, w), k AS (SELECT *, sum(r) OVER e AS tr, sum(s) OVER e AS ts, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) OVER e AS exits, row_number() OVER (PARTITION BY u, v ORDER BY round(r, 9) DESC, w) AS i, row_number() OVER (PARTITION BY u, v ORDER BY round(s, 9) DESC, w) AS j FROM c WINDOW e AS (PARTITION BY u, v)), g AS (SELECT u, v, max(tr) AS mass, sum(CASE WHEN ts > 0 THEN least(r / tr, s / ts) ELSE 0 END) AS o, max(CASE WHEN i = 1 AND j = 1 AND ts > 0 THEN 1.0 ELSE 0.0 END) AS same FROM k WHERE exits > 1 GROUP BY u, v) SELECT round(sum(mass * o) / sum(mass), 6) AS branch_cpc, round(sum(mass * same) / sum(mass), 6) AS exit_acc FROM g")


def demand(spark, sf):
    """Overlap of origin-destination shares over slots."""
    n = V.slots(spark, sf).agg(*(F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1)))
    ends = edges(spark, sf).groupBy("trip", "side").agg(F.min_by("u", "seq").alias("o"), F.max_by("v", "seq").alias("d"))
    return _rounded(M.pairs(ends, ["o", "d"]).crossJoin(F.broadcast(n)).agg(F.sum(F.least(F.col("r") / F.col("n0"), F.col("s") / F.col("n1"))).alias("demand")))


register("route_demand", demand, f"WITH {E}, {V.SLOTS}, n AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM slots), e AS (SELECT trip, side, arg_min(u, seq) AS o, arg_max(v, seq) AS d FROM edges GROUP BY trip, side), p AS (SELECT o, d, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM e GROUP BY o, d) SELECT round(sum(least(r / n0, s / n1)), 6) AS demand FROM p, n")


def od_prefix(spark, sf):
    """Overlap of region-path prefixes within each origin and destination, weighted by the real share."""
    x = R.prefixes(edges(spark, sf))
    c = M.pairs(x, ["o", "d", "prefix"], "mass")
    k = Window.partitionBy("o", "d")
    c = c.withColumns({"tr": F.sum("r").over(k), "ts": F.sum("s").over(k)}).groupBy("o", "d").agg(F.sum(F.when((F.col("tr") > 0) & (F.col("ts") > 0), F.least(F.col("r") / F.col("tr"), F.col("s") / F.col("ts"))).otherwise(0.0)).alias("cpc"))
    n = x.where("side = 0").groupBy("o", "d").agg(F.countDistinct("trip").alias("n"))
    return _rounded(c.join(n, ["o", "d"]).agg((F.sum(F.col("n") * F.col("cpc")) / F.sum("n")).alias("odpf")))


register("route_od_prefix", od_prefix, f"WITH {_FAMILY}, ends AS (SELECT trip, arg_min(u, seq) AS o, arg_max(v, seq) AS d FROM edges GROUP BY trip), x AS (SELECT side, trip, o, d, path, unnest(range(2, len(path) + 1)) AS n FROM fam JOIN ends USING (trip) WHERE len(path) >= 2), y AS (SELECT side, o, d, path[1:n] AS prefix, 1.0 / CAST(len(path) - 1 AS DOUBLE) AS mass FROM x), p AS (SELECT o, d, prefix, coalesce(sum(mass) FILTER (side = 0), 0) AS r, coalesce(sum(mass) FILTER (side = 1), 0) AS s FROM y GROUP BY o, d, prefix), t AS (SELECT *, sum(r) OVER (PARTITION BY o, d) AS tr, sum(s) OVER (PARTITION BY o, d) AS ts FROM p), c AS (SELECT o, d, sum(CASE WHEN tr > 0 AND ts > 0 THEN least(r / tr, s / ts) ELSE 0 END) AS cpc FROM t GROUP BY o, d), n AS (SELECT o, d, count(DISTINCT trip) AS n FROM x WHERE side = 0 GROUP BY o, d) SELECT round(sum(n * cpc) / sum(n), 6) AS odpf FROM c JOIN n USING (o, d)")


def shape_retention(spark, sf):
    """Length, backbone, closed length, closed walks and repeated edges of synthetic over real, per slot."""
    t = R.retention(edges(spark, sf), F.lit(1.0) + (F.col("u") * 7 + F.col("v")) % 5)
    n = V.slots(spark, sf).agg(*(F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1)))
    names = ["total", "backbone", "closed", "walks", "repeats"]
    s = t.agg(*(F.sum(F.when(F.col("side") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in names for k in (0, 1))).crossJoin(F.broadcast(n))
    return _rounded(s.select(*(F.when(F.col(f"{c}0") > 0, (F.col(f"{c}1") / F.col("n1")) / (F.col(f"{c}0") / F.col("n0"))).otherwise(0.0).alias(c) for c in names)))


_FOLD = (
    f"{E}, {V.SLOTS}, le AS (SELECT trip, side, row_number() OVER (PARTITION BY trip ORDER BY seq) AS k, u, v, CAST(1 + (u * 7 + v) % 5 AS DOUBLE) AS len FROM edges), "
    "fold AS (SELECT trip, side, CAST(0 AS BIGINT) AS k, [u] AS nodes, CAST([] AS DOUBLE[]) AS lens, CAST(0 AS DOUBLE) AS closed, CAST(0 AS BIGINT) AS walks FROM le WHERE k = 1 "
    "UNION ALL SELECT f.trip, f.side, e.k, CASE WHEN list_contains(nodes, v) THEN nodes[1:list_position(nodes, v)] ELSE list_append(nodes, v) END, CASE WHEN list_contains(nodes, v) THEN lens[1:list_position(nodes, v) - 1] ELSE list_append(lens, len) END, closed + CASE WHEN list_contains(nodes, v) THEN coalesce(list_sum(lens[list_position(nodes, v):]), 0) + len ELSE 0 END, walks + CASE WHEN list_contains(nodes, v) THEN 1 ELSE 0 END FROM fold f JOIN le e ON e.trip = f.trip AND e.k = f.k + 1), "
    "t AS (SELECT f.trip, any_value(f.side) AS side, arg_max(coalesce(list_sum(lens), 0), k) AS backbone, arg_max(closed, k) AS closed, arg_max(walks, k) AS walks FROM fold f GROUP BY f.trip), r AS (SELECT trip, sum(len) AS total, count(*) - count(DISTINCT (u, v)) AS repeats FROM le GROUP BY trip), n AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM slots)"
)
_KEPT = ", ".join(f"round(coalesce((sum(CASE WHEN side = 1 THEN {c} ELSE 0 END) / max(n1)) / nullif(sum(CASE WHEN side = 0 THEN {c} ELSE 0 END) / max(n0), 0), 0), 6) AS {c}" for c in ("total", "backbone", "closed", "walks", "repeats"))
register("route_retention", shape_retention, f"WITH RECURSIVE {_FOLD} SELECT {_KEPT} FROM t JOIN r ON r.trip = t.trip, n")


def road_use(spark, sf):
    """Edge histogram with one token for each slot without a route: distance, matching share."""
    e, s = edges(spark, sf), V.slots(spark, sf)
    failed = s.join(e.select("trip").distinct(), "trip", "left_anti").select("side", F.lit(-1).alias("u"), F.lit(-1).alias("v"))
    p = M.pairs(e.select("side", "u", "v").union(failed), ["u", "v"])
    k = e.select("trip").distinct().withColumn("ok", F.lit(1.0))
    share = s.join(k, "trip", "left").groupBy().agg(*(F.avg(F.when(F.col("side") == i, F.coalesce("ok", F.lit(0.0)))).alias(f"matched_{i}") for i in (0, 1)))
    return _rounded(M.jsd(p, "C").crossJoin(F.broadcast(share)))


register("route_road_use", road_use, f"WITH {E}, {V.SLOTS}, a AS (SELECT side, u, v FROM edges UNION ALL SELECT side, -1, -1 FROM slots WHERE trip NOT IN (SELECT trip FROM edges)), p AS (SELECT u, v, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM a GROUP BY u, v), {Q}, m AS (SELECT avg(CASE WHEN side = 0 THEN CASE WHEN trip IN (SELECT trip FROM edges) THEN 1.0 ELSE 0.0 END END) AS m0, avg(CASE WHEN side = 1 THEN CASE WHEN trip IN (SELECT trip FROM edges) THEN 1.0 ELSE 0.0 END END) AS m1 FROM slots) SELECT round(sum({js_sql('(r / tr)', '(s / ts)')}), 6) AS jsd, (SELECT round(m0, 6) FROM m) AS matched_0, (SELECT round(m1, 6) FROM m) AS matched_1 FROM q")


def od_transition(spark, sf):
    """Distance of region transitions within each origin and destination region, weighted by real trips."""
    e = edges(spark, sf)
    ends = e.groupBy("trip").agg(F.min_by("ru", "seq").alias("o"), F.max_by("rv", "seq").alias("d"))
    p = M.pairs(e.join(ends, "trip"), ["o", "d", "ru", "rv"])
    k = Window.partitionBy("o", "d")
    a, b = F.col("r") / F.col("tr"), F.col("s") / F.col("ts")
    t = lambda x: F.when(x > 0, x * F.ln(x / ((a + b) / 2))).otherwise(0.0)
    c = p.withColumns({"tr": F.sum("r").over(k), "ts": F.sum("s").over(k)}).where("tr > 0").groupBy("o", "d").agg(F.when(F.max("ts") > 0, F.sum((t(a) + t(b)) / 2) / F.ln(F.lit(2.0))).otherwise(1.0).alias("jsd"))
    n = e.where("side = 0").select("trip").distinct().join(ends, "trip").groupBy("o", "d").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(c.join(n, ["o", "d"]).agg((F.sum(F.col("n") * F.col("jsd")) / F.sum("n")).alias("jsd"), F.count(F.lit(1)).alias("pairs")))


register("route_od_transition", od_transition, f"WITH {E}, ends AS (SELECT trip, arg_min(ru, seq) AS o, arg_max(rv, seq) AS d FROM edges GROUP BY trip), p AS (SELECT o, d, ru, rv, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM edges JOIN ends USING (trip) GROUP BY o, d, ru, rv), t AS (SELECT *, sum(r) OVER (PARTITION BY o, d) AS tr, sum(s) OVER (PARTITION BY o, d) AS ts FROM p), c AS (SELECT o, d, CASE WHEN max(ts) > 0 THEN sum({js_sql('(r / tr)', '(s / ts)')}) / ln(2.0) ELSE 1.0 END AS jsd FROM t WHERE tr > 0 GROUP BY o, d), n AS (SELECT o, d, count(DISTINCT trip) AS n FROM edges JOIN ends USING (trip) WHERE side = 0 GROUP BY o, d) SELECT round(sum(n * jsd) / sum(n), 6) AS jsd, count(*) AS pairs FROM c JOIN n USING (o, d)")


# Road choices: contexts are ordered pairs of different regions with at least two crossing edges.
def _events(spark, sf):
    e = edges(spark, sf)
    options = e.where("ru != rv").select("ru", "rv", "u", "v").distinct()
    support = options.groupBy("ru", "rv").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    ev = e.join(F.broadcast(support), ["ru", "rv"])  # pairs of the fixed regions
    return ev.withColumn("mass", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("trip"))), options.join(F.broadcast(support), ["ru", "rv"])


_CHOICE = f"{E}, options0 AS (SELECT DISTINCT ru, rv, u, v FROM edges WHERE ru <> rv), support AS (SELECT ru, rv, count(*) AS k FROM options0 GROUP BY ru, rv HAVING count(*) >= 2), options AS (SELECT o.*, k FROM options0 o JOIN support USING (ru, rv)), ce AS (SELECT e.*, k, 1.0 / CAST(count(*) OVER (PARTITION BY trip) AS DOUBLE) AS mass FROM edges e JOIN support USING (ru, rv)), cp AS (SELECT o.ru, o.rv, o.u, o.v, o.k, coalesce(sum(mass) FILTER (side = 0), 0) AS r, coalesce(sum(mass) FILTER (side = 1), 0) AS s FROM options o LEFT JOIN ce ON ce.ru = o.ru AND ce.rv = o.rv AND ce.u = o.u AND ce.v = o.v GROUP BY ALL)"
register("choice_options", lambda s, d: _events(s, d)[1], f"WITH {_CHOICE} SELECT ru, rv, u, v, k FROM options")


def _choice_pairs(spark, sf):
    ev, options = _events(spark, sf)
    c = M.pairs(ev, ["ru", "rv", "u", "v"], "mass")
    return options.join(c, ["ru", "rv", "u", "v"], "left").fillna(0.0, ["r", "s"])


def choice_fidelity(spark, sf):
    """Overlap of joint context and option masses, and tie-aware NDCG of complete lists weighted by real mass."""
    p = _choice_pairs(spark, sf).withColumns({"r": F.round("r", 9), "s": F.round("s", 9)})
    cpc = M.cpc(p, "choice_cpc")
    dcg = K.expected_dcg(p, ["ru", "rv"], "r", "s", "dcg").join(K.expected_dcg(p, ["ru", "rv"], "r", "r", "ideal"), ["ru", "rv"]).join(p.groupBy("ru", "rv").agg(F.sum("r").alias("w")), ["ru", "rv"])
    return _rounded(cpc.crossJoin(F.broadcast(dcg.where("w > 0").agg((F.sum(F.col("w") * F.col("dcg") / F.col("ideal")) / F.sum("w")).alias("choice_ndcg"), F.count(F.lit(1)).alias("contexts")))))


register("choice_fidelity", choice_fidelity, f"WITH {_CHOICE}, p AS (SELECT ru, rv, round(r, 9) AS r, round(s, 9) AS s, u, v FROM cp), {Q}, d AS (SELECT *, avg(r) OVER (PARTITION BY ru, rv, s) / log2(row_number() OVER (PARTITION BY ru, rv ORDER BY s DESC) + 1) AS g, avg(r) OVER (PARTITION BY ru, rv, r) / log2(row_number() OVER (PARTITION BY ru, rv ORDER BY r DESC) + 1) AS h FROM p), c AS (SELECT ru, rv, sum(g) AS dcg, sum(h) AS ideal, sum(r) AS w FROM d GROUP BY ru, rv) SELECT (SELECT round(sum(least(r / tr, s / ts)), 6) FROM q) AS choice_cpc, round(sum(w * dcg / ideal) / sum(w), 6) AS choice_ndcg, count(*) AS contexts FROM c WHERE w > 0")


def next_option(spark, sf):
    """Next-option law of the synthetic side, half mixed with the uniform one: accuracy and loss, mean within trips, then over trips."""
    ev, _ = _events(spark, sf)
    p = _choice_pairs(spark, sf).withColumn("s", F.round("s", 9))
    k = Window.partitionBy("ru", "rv")
    p = p.withColumns({"ts": F.sum("s").over(k), "best": F.row_number().over(k.orderBy(F.desc("s"), "u", "v"))})
    p = p.withColumn("q", F.when(F.col("ts") > 0, F.col("s") / F.col("ts")).otherwise(1.0 / F.col("k"))).select("ru", "rv", "u", "v", "q", "best")
    t = ev.where("side = 0").join(p, ["ru", "rv", "u", "v"])
    per = t.groupBy("trip").agg(F.avg(F.when(F.col("best") == 1, 1.0).otherwise(0.0)).alias("hit"), F.avg(-F.ln(0.5 / F.col("k") + 0.5 * F.col("q"))).alias("loss"))
    return _rounded(per.agg(F.avg("hit").alias("accuracy"), F.avg("loss").alias("nll"), F.count(F.lit(1)).alias("trips")))


register("choice_next_option", next_option, f"WITH {_CHOICE}, p AS (SELECT *, round(s, 9) AS z FROM cp), t AS (SELECT *, sum(z) OVER (PARTITION BY ru, rv) AS ts, row_number() OVER (PARTITION BY ru, rv ORDER BY z DESC, u, v) AS best FROM p), l AS (SELECT ce.trip, CASE WHEN best = 1 THEN 1.0 ELSE 0.0 END AS hit, -ln(0.5 / ce.k + 0.5 * CASE WHEN ts > 0 THEN z / ts ELSE CAST(1 AS DOUBLE) / ce.k END) AS loss FROM ce JOIN t ON t.ru = ce.ru AND t.rv = ce.rv AND t.u = ce.u AND t.v = ce.v WHERE ce.side = 0), per AS (SELECT trip, avg(hit) AS hit, avg(loss) AS loss FROM l GROUP BY trip) SELECT round(avg(hit), 6) AS accuracy, round(avg(loss), 6) AS nll, count(*) AS trips FROM per")


def witness(spark, sf):
    """Edges of synthetic routes that a public network of real edges has: share of edges, and of trips with at least 95 %."""
    e = edges(spark, sf)
    public = e.where("side = 0").select("u", "v").distinct().withColumn("ok", F.lit(1.0))
    t = e.where("side = 1").join(public, ["u", "v"], "left").groupBy("trip").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("share"), F.count(F.lit(1)).alias("n"))
    return _rounded(t.agg((F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("edges_public"), F.avg(F.when(F.col("share") >= 0.95, 1.0).otherwise(0.0)).alias("trips_public")))


register("route_witness", witness, f"WITH {E}, pub AS (SELECT DISTINCT u, v FROM edges WHERE side = 0), t AS (SELECT trip, avg(CASE WHEN p.u IS NULL THEN 0.0 ELSE 1.0 END) AS share, count(*) AS n FROM edges e LEFT JOIN pub p ON e.u = p.u AND e.v = p.v WHERE side = 1 GROUP BY trip) SELECT round(sum(share * n) / sum(n), 6) AS edges_public, round(avg(CASE WHEN share >= 0.95 THEN 1.0 ELSE 0.0 END), 6) AS trips_public FROM t")


def directed_runs(spark, sf):
    """Maximal stretches of synthetic routes on public edges with at least three edges: gaps and islands."""
    e = edges(spark, sf)
    public = e.where("side = 0").select("u", "v").distinct().withColumn("ok", F.lit(1))
    t = e.where("side = 1").join(public, ["u", "v"], "left").withColumn("gap", F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).over(R.step().rowsBetween(Window.unboundedPreceding, 0)))
    return t.where("ok = 1").groupBy("trip", "gap").agg(F.count(F.lit(1)).alias("n"), F.min_by("u", "seq").alias("first")).where("n >= 3")


register("route_directed_runs", directed_runs, f"WITH {E}, pub AS (SELECT DISTINCT u, v FROM edges WHERE side = 0), t AS (SELECT e.*, p.u IS NOT NULL AS ok, sum(CASE WHEN p.u IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS gap FROM edges e LEFT JOIN pub p ON e.u = p.u AND e.v = p.v WHERE side = 1) SELECT trip, gap, count(*) AS n, arg_min(u, seq) AS first FROM t WHERE ok GROUP BY trip, gap HAVING count(*) >= 3")


#: The queries whose one row each makes the suite, with the names its columns take.
SUITE = {
    "route_demand": {"demand": "demand_fid"}, "route_turn_fidelity": {"btf": "btf", "rc_cpc": "rc_cpc"}, "route_edge_cpc": {"cpc": "edge_cpc"}, "route_turn_cpc": {"cpc": "turn_cpc"},
    "route_family_cpc": {"cpc": "family_cpc"}, "route_turn_support": {"recall": "turn_recall", "precision": "turn_precision", "f1": "turn_f1"}, "route_branches": {"branch_cpc": "branch_cpc", "exit_acc": "exit_acc"},
    "route_od_prefix": {"odpf": "odpf"}, "route_retention": {"total": "kept_length", "backbone": "kept_backbone", "closed": "kept_closed", "walks": "kept_walks", "repeats": "kept_repeats"},
}


def route_suite(spark, sf):
    """All route measures of a release as one row, with the overlaps as intersection over union and the yields of both corpora."""
    known, out = registry.registered(), None
    for name, columns in SUITE.items():
        one = known[name](spark, sf).select(*(F.col(c).alias(n) for c, n in columns.items()))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    y = road_yield(spark, sf).agg(*(F.max(F.when(F.col("side") == k, F.col("yield"))).alias(n) for k, n in ((0, "real_yield"), (1, "road_yield"))))
    e = M.support(M.pairs(edges(spark, sf), ["u", "v"])).select(*(F.col(c).alias(f"edge_{c}") for c in ("recall", "precision", "f1")))
    out = out.crossJoin(F.broadcast(y)).crossJoin(F.broadcast(e))
    return _rounded(out.withColumns({"edge_iou": M.iou(F.col("edge_cpc")), "turn_iou": M.iou(F.col("turn_cpc")), "family_cpc": F.col("family_cpc") * F.col("road_yield"), "penalised_rc_cpc": F.col("rc_cpc") * F.col("road_yield")}), 5)


def _suite_sql():
    known = registry.registered_sql()
    parts = ", ".join(f"({known[n]}) t{i}" for i, n in enumerate(SUITE))
    plain = ", ".join(f"round({f't{i}.{c}'}{' * y.road_yield' if n == 'family_cpc' else ''}, 5) AS {n}" for i, columns in enumerate(SUITE.values()) for c, n in columns.items())
    place = {n: f"t{i}.{c}" for i, columns in enumerate(SUITE.values()) for c, n in columns.items()}
    y = f"(SELECT max(CASE WHEN side = 0 THEN yield END) AS real_yield, max(CASE WHEN side = 1 THEN yield END) AS road_yield FROM ({known['route_yield']})) y"
    e = f"(WITH {_EDGE_P}, c AS (SELECT CAST(count(*) FILTER (r > 0 AND s > 0) AS DOUBLE) AS b, count(*) FILTER (r > 0) AS nr, count(*) FILTER (s > 0) AS ns FROM p) SELECT b / nr AS recall, b / ns AS precision, 2 * (b / nr) * (b / ns) / (b / nr + b / ns) AS f1 FROM c) e"
    iou = ", ".join(f"round({place[c + '_cpc']} / (2 - {place[c + '_cpc']}), 5) AS {c}_iou" for c in ("edge", "turn"))
    return f"SELECT {plain}, round(y.real_yield, 5) AS real_yield, round(y.road_yield, 5) AS road_yield, round(e.recall, 5) AS edge_recall, round(e.precision, 5) AS edge_precision, round(e.f1, 5) AS edge_f1, {iou}, round({place['rc_cpc']} * y.road_yield, 5) AS penalised_rc_cpc FROM {parts}, {y}, {e}"


register("route_suite", route_suite, _suite_sql())
