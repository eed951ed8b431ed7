"""Attacks and predictors that learn, partitions, designs and reweighting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.functions import sequence as S
from wayfare.operators import clusters as C
from wayfare.operators import graph as G
from wayfare.operators import ranking as R
from wayfare.registry import register
from wayfare.sources import views as V

from .distributions import _rounded
from .roads import CENTERS, CLOSURE, ROADS, nodes, roads, shortest
from .sequences import BOX

#: Landmarks of a trip, and rounds and depth of the boosted trees.
LANDMARKS, TREES, DEPTH = 8, 20, 3


def _landmarks(spark, sf):
    """(trip, f): LANDMARKS places along each trip in the unit box, as one array."""
    p = V.points(spark, sf).select("trip", "seq", S.normalised(F.col("x"), F.lit(BOX[0]), F.lit(BOX[1])).alias("x"), S.normalised(F.col("y"), F.lit(BOX[2]), F.lit(BOX[3])).alias("y"))
    a = p.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).where(F.size("p") >= 2)
    return a.select("trip", F.concat(*(S.landmarks(F.col(f"p.{c}"), LANDMARKS) for c in "xy")).alias("f"))


def membership(spark, sf):
    """A classifier that tells released from reference trips is asked which of members and non-members look released: AUC, balanced accuracy, hits at 1 and 5 % false alarms.

    Orders by number modulo four: 0 members, 1 release, 2 non-members, 3 reference.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    t = _landmarks(spark, sf).withColumn("features", array_to_vector("f")).withColumn("part", F.pmod("trip", F.lit(4)))
    train = t.where("part % 2 = 1").withColumn("label", F.when(F.col("part") == 1, 1.0).otherwise(0.0))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.08, seed=17).fit(train.select("features", "label"))
    asked = model.transform(t.where("part % 2 = 0")).select(F.when(F.col("part") == 0, 1).otherwise(0).alias("label"), vector_to_array("probability")[1].alias("score"))
    out = R.auc(asked, "score", "label").crossJoin(F.broadcast(R.balanced_at_median(asked, "score", "label")))
    for share, name in ((0.01, "tpr_at_1"), (0.05, "tpr_at_5")):
        out = out.crossJoin(F.broadcast(R.tpr_at(asked, "score", "label", share, name)))
    return _rounded(out)


register("attack_membership", membership)

#: Cells of a destination along each axis.
GOAL = 4


def destination_classifier(spark, sf):
    """Destination cell from a trip's first fifth: standardised features, balanced logistic regression, learned on synthetic and tried on real trips."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    p = V.points(spark, sf).select("trip", "side", "seq", S.normalised(F.col("x"), F.lit(BOX[0]), F.lit(BOX[1])).alias("x"), S.normalised(F.col("y"), F.lit(BOX[2]), F.lit(BOX[3])).alias("y"))
    a = p.groupBy("trip", "side").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).where(F.size("p") >= 2)
    at = F.greatest(F.lit(1), F.rint((F.size("p") - 1) * 0.2).cast("int"))
    a = a.select("trip", "side", F.get("p", F.lit(0)).alias("a"), F.get("p", at).alias("b"), F.element_at("p", -1).alias("z"))
    cell = lambda q: S.cell(q["x"], 0.0, 1.0, GOAL) * GOAL + S.cell(q["y"], 0.0, 1.0, GOAL)
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    turn = F.atan2(dx, dy)
    f = F.array(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"), dx, dy, F.hypot(dx, dy), F.sin(turn), F.cos(turn), (cell(F.col("a")) / GOAL).cast("double"), (cell(F.col("a")) % GOAL / F.lit(float(GOAL))).cast("double"))
    t = a.select("trip", "side", array_to_vector(f).alias("raw"), cell(F.col("z")).cast("double").alias("label"))
    train = t.where("side = 1")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    n = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    weighted = scale.transform(train).join(F.broadcast(n), "label").withColumn("weight", 1.0 / F.col("n"))  # a row a cell
    model = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-3, family="multinomial").fit(weighted.select("features", "label", "weight"))
    s = model.transform(scale.transform(t.where("side = 0"))).select("trip", "label", F.posexplode(vector_to_array("probability")).alias("item", "score"))
    one = R.topk_accuracy(s, ["trip"], "item", "label", "score", 1, "top1").crossJoin(F.broadcast(R.topk_accuracy(s, ["trip"], "item", "label", "score", 5, "top5")))
    best = s.groupBy("trip", "label").agg(F.max_by("item", "score").cast("double").alias("guess"))
    c = best.select(F.explode(F.array(F.struct(F.col("label").alias("k"), F.lit(1).alias("truth"), (F.col("label") == F.col("guess")).cast("int").alias("hit")), F.struct(F.col("guess").alias("k"), F.lit(0).alias("truth"), F.lit(0).alias("hit")))).alias("r")).select("r.*")
    per = c.groupBy("k").agg((2 * F.sum("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("f1"), F.sum("truth").alias("truth")).where("truth > 0")
    return _rounded(one.crossJoin(F.broadcast(per.agg(F.avg("f1").alias("macro_f1")))))


register("destination_classifier", destination_classifier)


def kmeans(spark, sf):
    """Eight clusters of the embeddings after ten rounds from the vectors of least hashes: size and inertia."""
    e = V.table(spark, sf, "embeddings").select("vec_id", "embedding").where("embedding IS NOT NULL")
    first = e.orderBy(F.sha2(F.col("vec_id").cast("string"), 256)).limit(8).collect()
    return _rounded(C.summary(e, C.lloyd(e, np.array([r["embedding"] for r in first], float), 10)), 4)


register("ml_kmeans", kmeans)


def components(spark, sf):
    """Shares of variance of the first five principal axes of the embeddings."""
    e = V.table(spark, sf, "embeddings").select("embedding").where("embedding IS NOT NULL")
    values = C.principal(e)[0]
    return _rounded(spark.createDataFrame([(i + 1, float(v / values.sum())) for i, v in enumerate(values[:5])], "axis int, share double"))


register("ml_principal_axes", components)


def centers(spark, sf):
    """Five nodes far from one another: first the one nearest to the middle, then each time the one farthest from those taken."""
    p = nodes(spark, sf).orderBy("node").toPandas()  # the nations
    xy = p[["x", "y"]].to_numpy(float)
    first = int(np.round(np.linalg.norm(xy - np.array([24.0, 48.0]), axis=1), 9).argmin())
    taken = G.farthest_points(xy, 5, first)
    return spark.createDataFrame([(i + 1, int(p["node"][k])) for i, k in enumerate(taken)], "nth int, node int")


def _centers_sql():
    d = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"
    parts = ["t1 AS (SELECT 1 AS nth, node, x, y FROM nodes ORDER BY round(sqrt((x - 24) * (x - 24) + (y - 48) * (y - 48)), 9), node LIMIT 1)"]
    for i in range(2, 6):
        parts.append(f"t{i} AS (SELECT * FROM t{i - 1} UNION ALL (SELECT {i}, n.node, n.x, n.y FROM nodes n, t{i - 1} t GROUP BY n.node, n.x, n.y ORDER BY min({d('n', 't')}) DESC, n.node LIMIT 1))")
    return f"WITH {ROADS}, {', '.join(parts)} SELECT nth, node FROM t5"


register("rnk_k_centers", centers, _centers_sql())


def design(spark, sf):
    """Six nodes chosen one by one for the largest gain in log det of their information (1, x, y)."""
    p = nodes(spark, sf).orderBy("node").toPandas()  # the nations
    x = np.column_stack([np.ones(len(p)), p["x"] / 50, p["y"] / 100])
    return _rounded(spark.createDataFrame([(i + 1, int(p["node"][k]), float(g)) for i, (k, g) in enumerate(C.greedy_logdet(x, 6))], "nth int, node int, gain double"))


register("syn_design", design)

#: Divergence that a reweighting may cost.
BALL = 0.0005


def reweighted(spark, sf):
    """Shares of path-length bins drawn from the synthetic towards the real ones, own * (real / own)^alpha, by the largest alpha in [0, 1] whose divergence from the own shares stays in the ball."""
    p = V.points(spark, sf)
    w = Window.partitionBy("trip").orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(w), (F.col("y") - F.lag("y").over(w)) / 1000
    t = p.withColumn("len", F.sqrt(dx * dx + dy * dy)).groupBy("trip", "side").agg(F.sum("len").alias("len")).where("len IS NOT NULL")
    c = t.groupBy(F.least(F.lit(15), F.floor(F.col("len") / 25)).cast("int").alias("bin")).agg(F.count_if(F.col("side") == 1).alias("s"), F.count_if(F.col("side") == 0).alias("r")).where("r > 0 AND s > 0")
    a = c.agg(F.array_sort(F.collect_list(F.struct("bin", "s", "r"))).alias("b"))  # 16 bins
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda z, v: z + v)
    a = a.withColumns({"q": F.transform("b", lambda x: x["s"] * 1.0), "t": F.transform("b", lambda x: x["r"] * 1.0)})
    a = a.withColumns({"q": F.transform("q", lambda v: v / total(F.col("q"))), "t": F.transform("t", lambda v: v / total(F.col("t")))})

    def shares(alpha):
        raw = F.zip_with("q", "t", lambda q, t: q * F.pow(t / q, alpha))
        return F.transform(raw, lambda v: v / total(raw))

    cost = lambda alpha: total(F.zip_with(shares(alpha), "q", lambda v, q: v * F.ln(v / q)))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        return F.when(cost(mid) <= BALL, F.struct(mid.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    a = a.withColumn("alpha", F.when(cost(F.lit(1.0)) <= BALL, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve)["lo"]))
    rows = F.transform("b", lambda x, i: F.struct(x["bin"].alias("bin"), F.get("q", i).alias("own"), F.get("t", i).alias("target"), F.get("w", i).alias("share")))
    return _rounded(a.withColumn("w", shares(F.col("alpha"))).select("alpha", F.inline(rows)))


_SHARES = "list_transform(list_zip(q, t), lambda z : z[1] * pow(z[2] / z[1], {a}))"
_COST = f"list_sum(list_transform(list_zip({_SHARES}, q), lambda z : z[1] / list_sum({_SHARES}) * ln(z[1] / list_sum({_SHARES}) / z[2])))"
register("syn_reweighted", reweighted, f"WITH RECURSIVE {V.POINTS}, d AS (SELECT trip, side, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + ((y - lag(y) OVER w) / 1000) * ((y - lag(y) OVER w) / 1000)) AS len FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)), t0 AS (SELECT trip, side, sum(len) AS len FROM d GROUP BY trip, side HAVING sum(len) IS NOT NULL), c AS (SELECT CAST(least(15, floor(len / 25)) AS INT) AS bin, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 0) AS r FROM t0 GROUP BY 1), g AS (SELECT bin, CAST(s AS DOUBLE) / sum(s) OVER () AS own, CAST(r AS DOUBLE) / sum(r) OVER () AS target FROM c WHERE r > 0 AND s > 0), l AS (SELECT list(bin ORDER BY bin) AS b, list(own ORDER BY bin) AS q, list(target ORDER BY bin) AS t FROM g), bi(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, CASE WHEN {_COST.format(a='((lo + hi) / 2)')} <= {BALL} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_COST.format(a='((lo + hi) / 2)')} <= {BALL} THEN hi ELSE (lo + hi) / 2 END FROM bi, l WHERE k < 40), al AS (SELECT CASE WHEN {_COST.format(a='1.0')} <= {BALL} THEN 1.0 ELSE lo END AS alpha FROM bi, l WHERE k = 40) SELECT round(alpha, 6) AS alpha, bin, round(own, 6) AS own, round(target, 6) AS target, round(own * pow(target / own, alpha) / sum(own * pow(target / own, alpha)) OVER (), 6) AS share FROM g, al")


def via_paths(spark, sf):
    """The three shortest ways through some third node between all nodes, at most STRETCH times the direct one."""
    d = shortest(spark, sf)
    a = d.where("u != v").select("u", F.col("v").alias("via"), F.col("len").alias("l1"))
    b = d.where("u != v").select(F.col("u").alias("via"), "v", F.col("len").alias("l2"))
    c = a.join(b, "via").where("u != v").join(d.select("u", "v", F.col("len").alias("direct")), ["u", "v"]).withColumn("length", F.round(F.col("l1") + F.col("l2"), 9)).where("length <= direct * 1.5")
    w = Window.partitionBy("u", "v").orderBy("length", "via")
    return _rounded(c.withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("u", "v", "nth", "via", "length"))


register("graph_via_paths", via_paths, f"WITH {ROADS}, {CLOSURE}, c AS (SELECT a.u, b.v, a.v AS via, round(a.len + b.len, 9) AS length, d.len AS direct FROM k6 a JOIN k6 b ON a.v = b.u JOIN k6 d ON d.u = a.u AND d.v = b.v WHERE a.u <> a.v AND b.u <> b.v AND a.u <> b.v), n AS (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY length, via) AS nth FROM c WHERE length <= direct * 1.5) SELECT u, v, CAST(nth AS INT) AS nth, via, round(length, 6) AS length FROM n WHERE nth <= 3")


def context(spark, sf):
    """Public context of each node: its nearest center, its zone of nine, and the share of shortest ways that may pass it."""
    d = shortest(spark, sf).select("u", "v", F.round("len", 6).alias("len"))
    near = d.where(F.col("u").isin(*CENTERS)).groupBy(F.col("v").alias("node")).agg(F.min(F.struct("len", "u")).alias("b")).select("node", F.col("b.u").alias("coarse"))
    a, b = d.select("u", F.col("v").alias("node"), F.col("len").alias("l1")), d.select(F.col("u").alias("node"), "v", F.col("len").alias("l2"))
    on = a.join(b, "node").join(d, ["u", "v"]).where("u != v")
    share = on.groupBy("node").agg(F.avg(F.when(F.abs(F.col("l1") + F.col("l2") - F.col("len")) < 1e-5, 1.0).otherwise(0.0)).alias("importance"))
    n = nodes(spark, sf).select("node", (S.cell(F.col("x"), 0.0, 50.0, 3) * 3 + S.cell(F.col("y"), 0.0, 100.0, 3)).alias("fine"))
    return _rounded(n.join(near, "node").join(share, "node"))


register("graph_context", context, f"WITH {ROADS}, {CLOSURE}, d AS (SELECT u, v, round(len, 6) AS len FROM k6), n AS (SELECT v AS node, arg_min(u, len * 1000 + u / 1000.0) AS coarse FROM d WHERE u IN {CENTERS} GROUP BY v), s AS (SELECT a.v AS node, avg(CASE WHEN abs(a.len + b.len - d.len) < 1e-5 THEN 1.0 ELSE 0.0 END) AS importance FROM d a JOIN d b ON a.v = b.u JOIN d ON d.u = a.u AND d.v = b.v WHERE a.u <> b.v GROUP BY a.v) SELECT nodes.node, CAST(greatest(0, least(2, floor(x / 50 * 3))) AS INT) * 3 + CAST(greatest(0, least(2, floor(y / 100 * 3))) AS INT) AS fine, coarse, round(importance, 6) AS importance FROM nodes JOIN n ON n.node = nodes.node JOIN s ON s.node = nodes.node")


def resistance(spark, sf):
    """Effective resistance between the ends of each road, roads conducting by the inverse of their length: how little else connects them."""
    e = roads(spark, sf).where("u < v").toPandas()  # nations squared
    r = G.effective_resistance(e["u"], e["v"], 1 / e["len"].to_numpy())
    return _rounded(spark.createDataFrame([(int(u), int(v), float(x)) for u, v, x in zip(e["u"], e["v"], r, strict=True)], "u int, v int, resistance double"))


register("graph_resistance", resistance)


def two_portals(spark, sf):
    """Two crossing edges of each pair of regions: the heaviest, and the one whose middle lies farthest from it."""
    c = V.edges(spark, sf).where("ru != rv").groupBy("ru", "rv", "u", "v").agg(F.count(F.lit(1)).alias("weight"))
    n = nodes(spark, sf)
    c = c.join(F.broadcast(n.selectExpr("node AS u", "x AS ux", "y AS uy")), "u").join(F.broadcast(n.selectExpr("node AS v", "x AS vx", "y AS vy")), "v")  # the nations
    c = c.withColumns({"x": (F.col("ux") + F.col("vx")) / 2, "y": (F.col("uy") + F.col("vy")) / 2})
    return G.diverse_portals(c, 2).select("ru", "rv", "u", "v", "nth")


register("graph_diverse_portals", two_portals, f"WITH {V.EDGES}, no AS (SELECT n_nationkey AS node, (n_nationkey * 7 % 25) * 2.0::DOUBLE AS x, (n_nationkey * 11 % 25) * 4.0::DOUBLE AS y FROM nation), c AS (SELECT ru, rv, u, v, count(*) AS weight FROM edges WHERE ru <> rv GROUP BY ru, rv, u, v), g AS (SELECT c.*, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM c JOIN no a ON a.node = u JOIN no b ON b.node = v), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ru, rv ORDER BY weight DESC, u, v) = 1), s AS (SELECT g.* FROM g JOIN f ON f.ru = g.ru AND f.rv = g.rv AND (f.u <> g.u OR f.v <> g.v) QUALIFY row_number() OVER (PARTITION BY g.ru, g.rv ORDER BY round(sqrt((g.x - f.x) * (g.x - f.x) + (g.y - f.y) * (g.y - f.y)), 9) DESC, g.u, g.v) = 1) SELECT ru, rv, u, v, CAST(1 AS INT) AS nth FROM f UNION ALL SELECT ru, rv, u, v, CAST(2 AS INT) FROM s")


#: Members and non-members, each, that are looked for in the release: those of least hashes.
CANDIDATES = 1000
EARTH_M = 6371008.8


def population_linkage(spark, sf):
    """Distance of members and non-members to the nearest released trip, by the mean great-circle distance of LANDMARKS places: AUC and balanced accuracy of nearness.

    Orders by number modulo four: 0 members, 1 release, 2 non-members. Quantity is the latitude, the price in thousands
    the longitude. The candidates are bounded and sent to all tasks, the release is not.
    """
    p = V.points(spark, sf).select("trip", "seq", F.col("x").alias("lat"), (F.col("y") / 1000).alias("lon"))
    a = p.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p")).where(F.size("p") >= 2)
    a = a.select("trip", F.pmod("trip", F.lit(4)).alias("part"), *(S.landmarks(F.col(f"p.{c}"), LANDMARKS).alias(c) for c in ("lat", "lon")))
    h = F.row_number().over(Window.partitionBy("part").orderBy(S.stable("linkage", F.col("trip")), "trip"))
    asked = a.where("part IN (0, 2)").withColumn("nth", h).where(F.col("nth") <= CANDIDATES).orderBy("trip").collect()
    ids, lat, lon = [r["trip"] for r in asked], *(np.radians(np.array([r[c] for r in asked], float).reshape(-1, LANDMARKS)) for c in ("lat", "lon"))
    shared = spark.sparkContext.broadcast((lat, lon))  # 2 * CANDIDATES rows

    def near(batches):
        import pandas as pd

        qa, qo = shared.value
        best = np.full(len(qa), np.inf)
        for b in batches:
            ra, ro = (np.radians(np.array(b[c].tolist(), float).reshape(-1, LANDMARKS)) for c in ("lat", "lon"))
            for lo in range(0, len(ra), 64):
                x, y = ra[None, lo : lo + 64], ro[None, lo : lo + 64]
                half = np.sin((x - qa[:, None]) / 2) ** 2 + np.cos(qa[:, None]) * np.cos(x) * np.sin((y - qo[:, None]) / 2) ** 2
                best = np.minimum(best, (2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(half)))).mean(axis=2).min(axis=1))
        yield pd.DataFrame({"i": np.arange(len(qa)), "d": best})

    found = a.where("part = 1").select("lat", "lon").mapInPandas(near, "i int, d double").groupBy("i").agg(F.min("d").alias("d"))
    who = spark.createDataFrame([(i, int(t % 4 == 0)) for i, t in enumerate(ids)], "i int, label int")
    s = found.join(F.broadcast(who), "i").select((-F.round("d", 3)).alias("score"), "label")
    return _rounded(R.auc(s, "score", "label").crossJoin(F.broadcast(R.balanced_at_median(s, "score", "label"))))


_MARKS = f"n AS (SELECT trip, count(*) AS n FROM points GROUP BY trip HAVING count(*) >= 2), m AS (SELECT n.trip, n, CAST(i AS INT) AS i, i * (n - 1) / {float(LANDMARKS - 1)!r}::DOUBLE AS w FROM n, range({LANDMARKS}) r(i)), lm AS (SELECT m.trip, m.trip % 4 AS part, i, a.x + (b.x - a.x) * (w - floor(w)) AS lat, a.y / 1000 + (b.y / 1000 - a.y / 1000) * (w - floor(w)) AS lon FROM m JOIN points a ON a.trip = m.trip AND a.seq = 1 + CAST(floor(w) AS BIGINT) JOIN points b ON b.trip = m.trip AND b.seq = least(n, 2 + CAST(floor(w) AS BIGINT)))"
register("attack_population_linkage", population_linkage, f"WITH {V.POINTS}, {_MARKS}, k AS (SELECT trip, part FROM (SELECT DISTINCT trip, part FROM lm WHERE part IN (0, 2)) QUALIFY row_number() OVER (PARTITION BY part ORDER BY sha256('linkage|' || CAST(trip AS VARCHAR)), trip) <= {CANDIDATES}), q AS (SELECT lm.* FROM lm JOIN k ON k.trip = lm.trip), d AS (SELECT q.trip, q.part, r.trip AS o, avg(2 * {EARTH_M} * asin(least(1.0, sqrt(pow(sin((radians(r.lat) - radians(q.lat)) / 2), 2) + cos(radians(q.lat)) * cos(radians(r.lat)) * pow(sin((radians(r.lon) - radians(q.lon)) / 2), 2))))) AS d FROM q JOIN lm r ON r.part = 1 AND r.i = q.i GROUP BY q.trip, q.part, r.trip), s AS (SELECT -round(min(d), 3) AS score, CASE WHEN part = 0 THEN 1 ELSE 0 END AS label FROM d GROUP BY trip, part), rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), c AS (SELECT sum(label) AS p, sum(1 - label) AS n, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS s FROM rk), me AS (SELECT quantile_cont(score, 0.5) AS median FROM s) SELECT (SELECT round((s - p * (p + 1) / 2.0) / (p * n), 6) FROM c) AS auc, CAST((SELECT p FROM c) AS BIGINT) AS positives, CAST((SELECT n FROM c) AS BIGINT) AS negatives, (SELECT round((sum(CASE WHEN label = 1 AND score >= median THEN 1.0 ELSE 0.0 END) / sum(label) + sum(CASE WHEN label = 0 AND score < median THEN 1.0 ELSE 0.0 END) / sum(1 - label)) / 2, 6) FROM s, me) AS balanced")


def alternatives(spark, sf):
    """Up to three different short paths between nodes at least ten numbers apart: after each, its roads are lengthened and the search runs again."""
    r = roads(spark, sf).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("len").alias("length"))
    n = nodes(spark, sf).select(F.col("node").cast("long").alias("src"))
    asked = n.join(F.broadcast(n.withColumnRenamed("src", "dst")), F.col("dst") >= F.col("src") + 10)  # the nations
    return _rounded(G.alternative_paths(asked, r, 3).select("src", "dst", "nth", "length", F.concat_ws("-", "path").alias("path")))


register("graph_alternative_paths", alternatives)
