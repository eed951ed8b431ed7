"""Histograms of two corpora and the distances between them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.functions import sequence as S
from wayfare.operators import mass as M
from wayfare.registry import register
from wayfare.sources import views as V

from .sequences import BOX, ENDS, cell_sql, step


def _rounded(df, places=6):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _cells(spark, sf):
    return M.pairs(V.ev(spark, sf), ["cell"])


def _moves(spark, sf):
    r = V.runs(spark, sf).withColumn("b", F.lead("cell").over(step())).where("b IS NOT NULL").withColumnRenamed("cell", "a")
    return M.pairs(r, ["a", "b"])


CELLS = f"{V.EV}, p AS (SELECT cell, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM ev GROUP BY cell)"
MOVES = f"{V.RUNS}, m AS (SELECT side, cell AS a, lead(cell) OVER (PARTITION BY trip ORDER BY seq) AS b FROM runs), p AS (SELECT a, b, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM m WHERE b IS NOT NULL GROUP BY a, b)"
Q = "q AS (SELECT *, sum(r) OVER () AS tr, sum(s) OVER () AS ts, count(*) OVER () AS k FROM p)"
_T = "(CASE WHEN {x} > 0 THEN {x} * ln({x} / (({x} + {y}) / 2)) ELSE 0 END)"


def js_sql(a, b):
    return f"(({_T.format(x=a, y=b)} + {_T.format(x=b, y=a)}) / 2)"


register("density_cells", lambda s, d: M.pairs(V.ev(s, d), ["cell"]), f"WITH {CELLS} SELECT cell, r, s FROM p")
register("transition_cpc", lambda s, d: _rounded(M.cpc(_moves(s, d))), f"WITH {MOVES}, {Q} SELECT round(sum(least(r / tr, s / ts)), 6) AS cpc FROM q")
register("transition_tv", lambda s, d: _rounded(M.total_variation(_moves(s, d))), f"WITH {MOVES}, {Q} SELECT round(sum(abs(r / tr - s / ts)) / 2, 6) AS tv FROM q")
register("jsd_a", lambda s, d: _rounded(M.jsd(_cells(s, d), "A", 128)), f"WITH {CELLS}, {Q} SELECT round((sum({js_sql('((r + 1e-12) / (tr + 128e-12))', '((s + 1e-12) / (ts + 128e-12))')}) + max((128 - k) * {js_sql('(1e-12 / (tr + 128e-12))', '(1e-12 / (ts + 128e-12))')})) / ln(2.0), 6) AS jsd FROM q")
for _kind, _form in (("b", "sqrt(sum({j}))"), ("c", "sum({j})"), ("d", "sum({j}) / ln(2.0)"), ("e", "sqrt(sum({j}))"), ("f", "sum({j}) / ln(2.0)"), ("g", "sum({j}) / ln(2.0)"), ("h", "sum({j}) / ln(2.0)")):
    register(f"jsd_{_kind}", lambda s, d, k=_kind.upper(): _rounded(M.jsd(_moves(s, d), k)), f"WITH {MOVES}, {Q} SELECT round({_form.format(j=js_sql('(r / tr)', '(s / ts)'))}, 6) AS jsd FROM q")
register("support_scores", lambda s, d: _rounded(M.support(_moves(s, d))), f"WITH {MOVES}, c AS (SELECT CAST(count(*) FILTER (r > 0 AND s > 0) AS DOUBLE) AS b, count(*) FILTER (r > 0) AS nr, count(*) FILTER (s > 0) AS ns FROM p) SELECT round(b / nr, 6) AS recall, round(b / ns, 6) AS precision, round(2 * (b / nr) * (b / ns) / (b / nr + b / ns), 6) AS f1 FROM c")
register("flow_wape", lambda s, d: _rounded(M.wape(_moves(s, d)).crossJoin(F.broadcast(M.wape(_moves(s, d), True, "wape_calibrated")))), f"WITH {MOVES}, {Q} SELECT round(sum(abs(s - r)) / max(tr), 6) AS wape, round(sum(abs(s * (tr / ts) - r)) / max(tr), 6) AS wape_calibrated FROM q")
register("distribution_scores", lambda s, d: _rounded(M.entropy(_cells(s, d))), f"WITH {CELLS}, {Q}, w AS (SELECT r / tr AS a, s / ts AS b FROM q) SELECT round(sum(CASE WHEN a > 0 THEN -a * ln(a) ELSE 0 END), 6) AS entropy_real, round(sum(CASE WHEN b > 0 THEN -b * ln(b) ELSE 0 END), 6) AS entropy_syn, round(sum(-a * ln(b + 1e-12)), 6) AS cross_entropy, round(sum((a - b) ** 2), 6) AS brier FROM w")
register("hot_cell_recall", lambda s, d: _rounded(M.top_mass(_cells(s, d), ["cell"])), f"WITH {CELLS}, {Q}, w AS (SELECT *, coalesce(sum(r) OVER (ORDER BY r DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q) SELECT count(*) AS hot, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM w WHERE r > 0 AND before < 0.8 * tr")


def edge_iou(spark, sf):
    return _rounded(M.cpc(_moves(spark, sf)).select(M.iou(F.col("cpc")).alias("iou")))


register("transition_iou", edge_iou, f"WITH {MOVES}, {Q}, c AS (SELECT sum(least(r / tr, s / ts)) AS c FROM q) SELECT round(c / (2 - c), 6) AS iou FROM c")


def occupancy(spark, sf):
    """Trips that visit a cell, by side, and their SMAPE and ARE."""
    v = V.ev(spark, sf).select("trip", "side", "cell").distinct()
    return _rounded(M.smape(M.pairs(v, ["cell"])))


register("occupancy_errors", occupancy, f"WITH {V.EV}, p AS (SELECT cell, CAST(count(DISTINCT CASE WHEN side = 0 THEN trip END) AS DOUBLE) AS r, CAST(count(DISTINCT CASE WHEN side = 1 THEN trip END) AS DOUBLE) AS s FROM ev GROUP BY cell) SELECT round(avg(abs(s - r) / greatest(s + r, 1)), 6) AS smape, round(avg(CASE WHEN r >= 5 THEN abs(s - r) / r END), 6) AS are FROM p")

#: Rectangles of rows and columns on the 10 x 10 grid: every one of this height and width at every third place.
_RECTS = [(y, x, h, w) for h, w in ((2, 2), (3, 5), (6, 4)) for y in range(0, 11 - h, 3) for x in range(0, 11 - w, 3)]


def range_queries(spark, sf):
    """Share of trips that hit each rectangle, and its relative error: cells are listed for each rectangle, so the join is an equi-join on the cell."""
    hit = [(i, (y + a) * 10 + x + b) for i, (y, x, h, w) in enumerate(_RECTS) for a in range(h) for b in range(w)]
    q = spark.createDataFrame(hit, "rect int, cell int")
    v = V.ev(spark, sf).select("trip", "side", "cell").distinct().join(F.broadcast(q), "cell").select("rect", "trip", "side").distinct()
    n = V.ev(spark, sf).agg(F.countDistinct(F.when(F.col("side") == 0, F.col("trip"))).alias("nr"), F.countDistinct(F.when(F.col("side") == 1, F.col("trip"))).alias("ns"))
    p = M.pairs(v, ["rect"]).crossJoin(F.broadcast(n)).withColumns({"b": F.col("r") / F.col("nr"), "a": F.col("s") / F.col("ns")})
    return _rounded(p.agg(F.avg(F.abs(F.col("a") - F.col("b")) / F.greatest(F.col("b"), 1.0 / F.col("nr"))).alias("are"), F.count(F.lit(1)).alias("rects"), F.avg(F.abs(F.col("s") - F.col("r")) / F.greatest(F.col("s") + F.col("r"), F.lit(1.0))).alias("smape"), F.avg(F.when(F.col("r") >= 5, F.abs(F.col("s") - F.col("r")) / F.col("r"))).alias("are5")))


register("range_queries", range_queries, f"WITH {V.EV}, q(rect, y, x, h, w) AS (VALUES {', '.join(f'({i}, {y}, {x}, {h}, {w})' for i, (y, x, h, w) in enumerate(_RECTS))}), n AS (SELECT count(DISTINCT CASE WHEN side = 0 THEN trip END) AS nr, count(DISTINCT CASE WHEN side = 1 THEN trip END) AS ns FROM ev), c AS (SELECT rect, count(DISTINCT CASE WHEN side = 0 THEN trip END) AS r, count(DISTINCT CASE WHEN side = 1 THEN trip END) AS s FROM q JOIN ev ON row >= y AND row < y + h AND col >= x AND col < x + w GROUP BY rect) SELECT round(avg(abs(CAST(s AS DOUBLE) / ns - CAST(r AS DOUBLE) / nr) / greatest(CAST(r AS DOUBLE) / nr, 1.0 / nr)), 6) AS are, count(*) AS rects, round(avg(abs(s - r) / greatest(CAST(s + r AS DOUBLE), 1.0)), 6) AS smape, round(avg(CASE WHEN r >= 5 THEN abs(s - r) / CAST(r AS DOUBLE) END), 6) AS are5 FROM c, n")


def _ends(spark, sf):
    p = V.points(spark, sf).withColumn("cell", S.cell(F.col("x"), BOX[0], BOX[1], 4) * 4 + S.cell(F.col("y"), BOX[2], BOX[3], 4))
    return p.groupBy("trip", "side").agg(F.min_by("cell", "seq").alias("o"), F.max_by("cell", "seq").alias("d"), F.count(F.lit(1)).alias("n")).where("n >= 2")


OD = f"{V.POINTS}, c AS (SELECT trip, side, seq, {cell_sql(4)} AS cell FROM points), e AS (SELECT trip, side, arg_min(cell, seq) AS o, arg_max(cell, seq) AS d FROM c GROUP BY trip, side HAVING count(*) >= 2), p AS (SELECT o, d, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM e GROUP BY o, d)"
register("od_matrix", lambda s, d: M.pairs(_ends(s, d), ["o", "d"]), f"WITH {OD} SELECT o, d, r, s FROM p")


def od_demand(spark, sf):
    """Spearman over the dense matrix, NDCG at 20, overlap of the 20 largest pairs, distance."""
    p = M.pairs(_ends(spark, sf), ["o", "d"])
    a, b = M.ranked(p, ["o", "d"], "r", 20, "i").select("o", "d"), M.ranked(p, ["o", "d"], "s", 20, "j").select("o", "d")
    both = a.join(b, ["o", "d"]).agg((F.count(F.lit(1)) / 20.0).alias("top20"))
    return _rounded(M.spearman(p, 256).crossJoin(F.broadcast(M.ndcg(p, ["o", "d"], 20))).crossJoin(F.broadcast(both)).crossJoin(F.broadcast(M.jsd(p, "B"))))


register(
    "od_demand",
    od_demand,
    f"WITH {OD}, {Q}, g AS (SELECT i // 16 AS o, i % 16 AS d FROM range(256) t(i)), f AS (SELECT coalesce(r, 0) AS r, coalesce(s, 0) AS s FROM g LEFT JOIN p ON p.o = g.o AND p.d = g.d), k AS (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS ra, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rb FROM f), "
    "o AS (SELECT *, row_number() OVER (ORDER BY r DESC, o, d) AS i, row_number() OVER (ORDER BY s DESC, o, d) AS j FROM p) SELECT (SELECT round(corr(ra, rb), 6) FROM k) AS spearman, "
    f"(SELECT round(sum(r / log2(j + 1)) FILTER (j <= 20) / sum(r / log2(i + 1)) FILTER (i <= 20), 6) FROM o) AS ndcg, (SELECT count(*) / 20.0 FROM o WHERE i <= 20 AND j <= 20) AS top20, (SELECT round(sqrt(sum({js_sql('(r / tr)', '(s / ts)')})), 6) FROM q) AS jsd",
)


def length_histogram(spark, sf):
    """32 equal bins on [0, 99th percentile] of path lengths of both sides; longer trips fall out, the last edge is closed."""
    p = V.points(spark, sf).withColumn("d", F.hypot(F.col("x") - F.lag("x").over(step()), F.col("y") - F.lag("y").over(step())))
    t = p.groupBy("trip", "side").agg(F.sum("d").alias("length"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    top = t.agg(F.greatest(F.percentile("length", F.lit(0.99)), F.lit(1e-6)).alias("top"))
    t = t.crossJoin(F.broadcast(top)).where("length <= top")
    return M.pairs(t.withColumn("bin", F.least(F.lit(31), F.floor(F.col("length") / F.col("top") * 32)).cast("int")), ["bin"])


register("length_histogram", length_histogram, f"WITH {V.POINTS}, d AS (SELECT trip, side, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)), t AS (SELECT trip, side, sum(d) AS length FROM d GROUP BY trip, side HAVING count(*) >= 2), e AS (SELECT greatest(quantile_cont(length, 0.99), 1e-6) AS top FROM t) SELECT CAST(least(31, floor(length / top * 32)) AS INT) AS bin, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM t, e WHERE length <= top GROUP BY 1")


def structure(spark, sf):
    """Usable share, mean points, revisits, closed trips and directness of each side."""
    p = V.points(spark, sf).withColumn("d", F.hypot(F.col("x") - F.lag("x").over(step()), F.col("y") - F.lag("y").over(step())))
    t = p.groupBy("trip", "side").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.round("x", 3), F.round("y", 3)).alias("places"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("path"), F.hypot(F.max_by("x", "seq") - F.min_by("x", "seq"), F.max_by("y", "seq") - F.min_by("y", "seq")).alias("chord"))
    ok = F.col("n") >= 2
    return _rounded(t.groupBy("side").agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("usable"), F.avg(F.when(ok, F.col("n"))).alias("mean_points"), F.avg(F.when(ok, 1 - F.col("places") / F.col("n"))).alias("revisit"), F.avg(F.when(ok, F.when(F.col("chord") < 1000, 1.0).otherwise(0.0))).alias("closed"), F.avg(F.when(ok & (F.col("path") > 0), F.col("chord") / F.col("path"))).alias("directness")))


register("structure_summary", structure, f"WITH {V.POINTS}, d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)), t AS (SELECT trip, side, count(*) AS n, count(DISTINCT (round(x, 3), round(y, 3))) AS places, coalesce(sum(d), 0) AS path, sqrt((arg_max(x, seq) - arg_min(x, seq)) ** 2 + (arg_max(y, seq) - arg_min(y, seq)) ** 2) AS chord FROM d GROUP BY trip, side) SELECT side, round(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END), 6) AS usable, round(avg(CASE WHEN n >= 2 THEN n END), 6) AS mean_points, round(avg(CASE WHEN n >= 2 THEN 1 - places / n END), 6) AS revisit, round(avg(CASE WHEN n >= 2 THEN CASE WHEN chord < 1000 THEN 1.0 ELSE 0.0 END END), 6) AS closed, round(avg(CASE WHEN n >= 2 AND path > 0 THEN chord / path END), 6) AS directness FROM t GROUP BY side")


def input_stats(spark, sf):
    """Number, mean, median (the upper middle), extremes of trip lengths, mean step and mean chord, extents, by side.

    The median comes from the counts of equal lengths, so no side is sorted in one task.
    """
    p = V.points(spark, sf)
    hop = F.hypot(F.col("x") - F.lag("x").over(step()), F.col("y") - F.lag("y").over(step()))
    n = p.withColumn("d", hop).groupBy("trip", "side").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("d").alias("path"), F.hypot(F.max_by("x", "seq") - F.min_by("x", "seq"), F.max_by("y", "seq") - F.min_by("y", "seq")).alias("chord"))
    w = Window.partitionBy("side")
    by = n.groupBy("side", "n").agg(F.count(F.lit(1)).alias("k")).withColumns({"upto": F.sum("k").over(w.orderBy("n")), "all": F.sum("k").over(w)})
    middle = by.where(F.col("upto") > F.expr("all div 2")).groupBy("side").agg(F.min("n").alias("median_n"))
    t = n.groupBy("side").agg(F.count(F.lit(1)).alias("trips"), F.avg("n").alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), (F.sum("path") / F.sum(F.col("n") - 1)).alias("step_mean"), F.avg("chord").alias("chord_mean"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))
    return _rounded(t.join(middle, "side"), 4)


register("input_stats", input_stats, f"WITH {V.POINTS}, d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)), t AS (SELECT trip, side, count(*) AS n, min(y) AS lo, max(y) AS hi, sum(d) AS path, sqrt((arg_max(x, seq) - arg_min(x, seq)) ** 2 + (arg_max(y, seq) - arg_min(y, seq)) ** 2) AS chord FROM d GROUP BY trip, side) SELECT side, count(*) AS trips, round(avg(n), 4) AS mean_n, min(n) AS min_n, max(n) AS max_n, list_sort(list(n))[count(*) // 2 + 1] AS median_n, round(sum(path) / sum(n - 1), 4) AS step_mean, round(avg(chord), 4) AS chord_mean, round(min(lo), 4) AS lowest, round(max(hi), 4) AS highest FROM t GROUP BY side")


def spatial(spark, sf):
    """Distance of radial histograms around the box centre, mass in three rings, and the shift of the centroid."""
    p = V.points(spark, sf).select("side", ((F.col("x") - BOX[0]) / (BOX[1] - BOX[0])).alias("a"), ((F.col("y") - BOX[2]) / (BOX[3] - BOX[2])).alias("b"))
    p = p.withColumn("ring", F.least(F.lit(11), F.floor(F.hypot(F.col("a") - 0.5, F.col("b") - 0.5) * 12)).cast("int"))
    q = M.pairs(p, ["ring"])
    c = p.agg(*(F.avg(F.when(F.col("side") == k, F.col(v))).alias(f"{v}{k}") for v in "ab" for k in (0, 1))).select(F.hypot(F.col("a0") - F.col("a1"), F.col("b0") - F.col("b1")).alias("centroid"))
    three = M.with_totals(M.pairs(p.withColumn("part", (F.col("ring") / 4).cast("int")), ["part"])).agg(F.sum(F.abs(F.col("r") / F.col("tr") - F.col("s") / F.col("ts"))).alias("ring_l1"))
    cover = M.support(M.pairs(p.withColumn("cell", S.cell(F.col("a"), 0.0, 1.0, 16) * 16 + S.cell(F.col("b"), 0.0, 1.0, 16)), ["cell"])).select(F.col("f1").alias("coverage_f1"))
    return _rounded(M.jsd(q, "D", name="radial_jsd").crossJoin(F.broadcast(c)).crossJoin(F.broadcast(three)).crossJoin(F.broadcast(cover)))


register("spatial_diagnostics", spatial, f"WITH {V.POINTS}, u AS (SELECT side, (x - {BOX[0]}) / {BOX[1] - BOX[0]} AS a, (y - {BOX[2]}) / {BOX[3] - BOX[2]} AS b FROM points), v AS (SELECT *, CAST(least(11, floor(sqrt((a - 0.5) ** 2 + (b - 0.5) ** 2) * 12)) AS INT) AS ring FROM u), p AS (SELECT ring, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS r, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS s FROM v GROUP BY ring), {Q}, c AS (SELECT sqrt((avg(a) FILTER (side = 0) - avg(a) FILTER (side = 1)) ** 2 + (avg(b) FILTER (side = 0) - avg(b) FILTER (side = 1)) ** 2) AS centroid FROM v), h AS (SELECT ring // 4 AS part, sum(r) / max(tr) AS x, sum(s) / max(ts) AS y FROM q GROUP BY 1), f AS (SELECT CAST(greatest(0, least(15, floor(a * 16))) AS INT) * 16 + CAST(greatest(0, least(15, floor(b * 16))) AS INT) AS cell, count(*) FILTER (side = 0) > 0 AS r, count(*) FILTER (side = 1) > 0 AS s FROM v GROUP BY 1), f2 AS (SELECT 2.0 * count(*) FILTER (r AND s) / (count(*) FILTER (r) + count(*) FILTER (s)) AS coverage_f1 FROM f) SELECT (SELECT round(coverage_f1, 6) FROM f2) AS coverage_f1, round(sum({js_sql('(r / tr)', '(s / ts)')}) / ln(2.0), 6) AS radial_jsd, (SELECT round(centroid, 6) FROM c) AS centroid, (SELECT round(sum(abs(x - y)), 6) FROM h) AS ring_l1 FROM q")
