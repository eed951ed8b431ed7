"""Whole evaluations: several synthetic corpora against the real one as one job, a row a method."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.functions import sequence as S
from wayfare.operators import mass as M
from wayfare.operators import privacy as P
from wayfare.operators import ranking as R
from wayfare.registry import register
from wayfare.sources import views as V

from .distributions import _rounded, js_sql
from .sequences import BOX, cell_sql, step

#: Orders with even numbers are real; the others are dealt to three methods.
_METHOD = "CASE WHEN trip % 2 = 0 THEN 'real' ELSE 'm' || CAST(trip // 2 % 3 AS VARCHAR) END"


def method_of():
    return F.when(F.col("trip") % 2 == 0, "real").otherwise(F.concat(F.lit("m"), F.expr("trip div 2 % 3").cast("string")))


def corpus(spark, sf):
    return V.points(spark, sf).withColumn("method", method_of())


def _views(spark, sf):
    """The keyed views that a profile compares: cells, end cells, and bins of path length."""
    p = corpus(spark, sf)
    grid = lambda g: S.cell(F.col("x"), BOX[0], BOX[1], g) * g + S.cell(F.col("y"), BOX[2], BOX[3], g)
    ends = p.withColumn("cell", grid(4)).groupBy("method", "trip").agg(F.min_by("cell", "seq").alias("o"), F.max_by("cell", "seq").alias("d"))
    dx, dy = F.col("x") - F.lag("x").over(step()), (F.col("y") - F.lag("y").over(step())) / 1000
    bins = p.withColumn("len", F.sqrt(dx * dx + dy * dy)).groupBy("method", "trip").agg(F.sum("len").alias("len")).where("len IS NOT NULL").withColumn("bin", F.least(F.lit(31), F.floor(F.col("len") / 20)).cast("int"))
    return {"cell": (p.select("method", grid(16).alias("cell")), ["cell"]), "od": (ends, ["o", "d"]), "length": (bins, ["bin"])}


def profile(spark, sf):
    """Every method's distances to the real corpus, in one row each, with its share of the real number of trips."""
    out = None
    for name, (df, keys) in _views(spark, sf).items():
        one = M.scores_by(M.pairs_by(df, keys), name)
        out = one if out is None else out.join(F.broadcast(one), "method")  # a row a method
    n = corpus(spark, sf).groupBy("method").agg(F.countDistinct("trip").alias("trips"))
    real = n.where("method = 'real'").select(F.col("trips").alias("real_trips"))
    n = n.where("method != 'real'").crossJoin(F.broadcast(real)).select("method", "trips", (F.col("trips") / F.col("real_trips")).alias("volume"))
    return _rounded(out.join(F.broadcast(n), "method"))


def _profile_sql():
    views = {"cell": (f"SELECT {_METHOD} AS method, {cell_sql(16)} AS k FROM points"), "od": (f"SELECT {_METHOD} AS method, arg_min({cell_sql(4)}, seq) * 100 + arg_max({cell_sql(4)}, seq) AS k FROM points GROUP BY trip"), "length": (f"SELECT {_METHOD} AS method, CAST(least(31, floor(sum(len) / 20)) AS INT) AS k FROM (SELECT trip, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + ((y - lag(y) OVER w) / 1000) * ((y - lag(y) OVER w) / 1000)) AS len FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)) GROUP BY trip HAVING sum(len) IS NOT NULL")}
    parts, picks = [], []
    for n, sql in views.items():
        parts.append(f"{n}_v AS ({sql}), {n}_c AS (SELECT method, k, CAST(count(*) AS DOUBLE) AS n FROM {n}_v GROUP BY method, k), {n}_k AS (SELECT m.method, k.k FROM (SELECT DISTINCT method FROM {n}_c WHERE method <> 'real') m, (SELECT DISTINCT k FROM {n}_c) k), {n}_p AS (SELECT a.method, a.k, coalesce(b.n, 0) AS r, coalesce(c.n, 0) AS s FROM {n}_k a LEFT JOIN {n}_c b ON b.method = 'real' AND b.k = a.k LEFT JOIN {n}_c c ON c.method = a.method AND c.k = a.k), {n}_q AS (SELECT method, r, s, r / sum(r) OVER (PARTITION BY method) AS a, s / sum(s) OVER (PARTITION BY method) AS b FROM {n}_p), {n}_t AS (SELECT method, sum(least(a, b)) AS cpc, sum({js_sql('a', 'b')}) / ln(2.0) AS jsd, sum(abs(a - b)) / 2 AS tv, 2.0 * count(*) FILTER (r > 0 AND s > 0) / (count(*) FILTER (r > 0) + count(*) FILTER (s > 0)) AS f1 FROM {n}_q GROUP BY method)")
        picks += [f"round({n}_t.{c}, 6) AS {n}_{c}" for c in ("cpc", "jsd", "tv", "f1")]
    trips = f"nt AS (SELECT {_METHOD} AS method, count(DISTINCT trip) AS trips FROM points GROUP BY 1)"
    return f"WITH {V.POINTS}, {', '.join(parts)}, {trips} SELECT cell_t.method, {', '.join(picks)}, nt.trips, round(CAST(nt.trips AS DOUBLE) / (SELECT trips FROM nt WHERE method = 'real'), 6) AS volume FROM cell_t JOIN od_t USING (method) JOIN length_t USING (method) JOIN nt USING (method)"


register("evaluate_profile", profile, _profile_sql())


def tstr(spark, sf):
    """Next hop learned on each method's routes, tried on real routes whose number is divisible by ten; retention is coverage times quality over that of the other real routes as training."""
    h = V.hops(spark, sf)
    t = R.triples(h, "node").select("trip", "a", "b", "c")
    test = t.where("trip % 10 = 0")
    train = t.where("trip % 10 != 0").withColumn("method", method_of())
    methods = train.select("method").distinct()
    q = R.backoff(train, test.crossJoin(F.broadcast(methods)), by=("method",))
    s = R.hit_scores(q, "hop", by=("method",))
    own = lambda c: F.col("hop_coverage") * F.col(c)
    real = s.where("method = 'real'").select(own("hop_hit_at_1").alias("r1"), own("hop_mrr").alias("r2"))
    kept = lambda c, r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), own(c) / F.col(r)))
    return _rounded(s.crossJoin(F.broadcast(real)).select(*s.columns, kept("hop_hit_at_1", "r1").alias("kept_hit"), kept("hop_mrr", "r2").alias("kept_mrr")))


_TSTR = f"""{V.HOPS}, t AS (SELECT trip, node AS a, lead(node, 1) OVER w AS b, lead(node, 2) OVER w AS c FROM hops WINDOW w AS (PARTITION BY trip ORDER BY seq)), t3 AS (SELECT * FROM t WHERE c IS NOT NULL),
tr AS (SELECT {_METHOD} AS method, a, b, c FROM t3 WHERE trip % 10 <> 0), ms AS (SELECT DISTINCT method FROM tr), te AS (SELECT method, a, b, c, count(*) AS cases FROM t3, ms WHERE trip % 10 = 0 GROUP BY method, a, b, c),
c2 AS (SELECT method, a, b, c, count(*) AS n FROM tr GROUP BY method, a, b, c), c1 AS (SELECT method, b, c, count(*) AS n FROM tr GROUP BY method, b, c),
m2 AS (SELECT *, row_number() OVER (PARTITION BY method, a, b ORDER BY n DESC, c) AS rank, sum(n) OVER (PARTITION BY method, a, b) AS total FROM c2), m1 AS (SELECT *, row_number() OVER (PARTITION BY method, b ORDER BY n DESC, c) AS rank, sum(n) OVER (PARTITION BY method, b) AS total FROM c1),
s2 AS (SELECT method, a, b, max(total) AS total FROM m2 GROUP BY method, a, b), s1 AS (SELECT method, b, max(total) AS total FROM m1 GROUP BY method, b),
z AS (SELECT te.method, te.cases, s2.total IS NOT NULL OR s1.total IS NOT NULL AS covered, CASE WHEN s2.total IS NOT NULL THEN m2.rank ELSE m1.rank END AS rank, coalesce(CASE WHEN s2.total IS NOT NULL THEN m2.n ELSE m1.n END, 0) AS n, coalesce(s2.total, s1.total) AS total FROM te LEFT JOIN s2 ON te.method = s2.method AND te.a = s2.a AND te.b = s2.b LEFT JOIN s1 ON te.method = s1.method AND te.b = s1.b LEFT JOIN m2 ON te.method = m2.method AND te.a = m2.a AND te.b = m2.b AND te.c = m2.c LEFT JOIN m1 ON te.method = m1.method AND te.b = m1.b AND te.c = m1.c)"""


def _tstr_sql():
    s = lambda x: f"sum(CASE WHEN covered THEN cases * {x} ELSE 0 END) / greatest(sum(CASE WHEN covered THEN cases ELSE 0 END), 1)"
    scores = f"y AS (SELECT method, sum(CASE WHEN covered THEN cases ELSE 0 END) / greatest(sum(cases), 1) AS hop_coverage, {s('(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END)')} AS hop_hit_at_1, {s('(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END)')} AS hop_hit_at_5, {s('(CASE WHEN rank <= 5 THEN CAST(1 AS DOUBLE) / rank ELSE 0.0 END)')} AS hop_mrr, {s('(-ln((n + 1e-12) / total))')} AS hop_nll, CAST(sum(cases) AS BIGINT) AS hop_query_count FROM z GROUP BY method), r AS (SELECT hop_coverage * hop_hit_at_1 AS r1, hop_coverage * hop_mrr AS r2 FROM y WHERE method = 'real')"
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in ("hop_coverage", "hop_hit_at_1", "hop_hit_at_5", "hop_mrr", "hop_nll"))
    return f"WITH {_TSTR}, {scores} SELECT method, {cols}, hop_query_count, round(greatest(0.0, least(1.0, hop_coverage * hop_hit_at_1 / r1)), 6) AS kept_hit, round(greatest(0.0, least(1.0, hop_coverage * hop_mrr / r2)), 6) AS kept_mrr FROM y, r"


register("evaluate_tstr", tstr, _tstr_sql())


def selected(spark, sf):
    """The method with the best mean of four validation scores, the first by name on ties."""
    p = profile(spark, sf).withColumn("score", (F.col("cell_cpc") + F.col("od_cpc") + F.col("length_cpc") + F.col("cell_f1")) / 4)
    return p.agg(F.min(F.struct((-F.round("score", 6)).alias("minus"), "method")).alias("best")).select("best.method", (-F.col("best.minus")).alias("score"))


register("rnk_select_method", selected, f"SELECT arg_min(method, round(-score, 6) * 1000 + CAST(substr(method, 2) AS INT) / 1e9) AS method, round(max(score), 6) AS score FROM (SELECT method, (cell_cpc + od_cpc + length_cpc + cell_f1) / 4 AS score FROM ({_profile_sql()}))")


def topk(spark, sf):
    """Share of real first hops that are among the 1 and 5 most probable ones under the synthetic law of the first node."""
    h = V.hops(spark, sf)
    f = h.where("seq <= 2").groupBy("trip", "side").agg(F.max(F.when(F.col("seq") == 1, F.col("node"))).alias("a"), F.max(F.when(F.col("seq") == 2, F.col("node"))).alias("b")).where("b IS NOT NULL")
    law = f.where("side = 1").groupBy("a", F.col("b").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    cases = f.where("side = 0").select("trip", "a", F.col("b").alias("truth")).join(law, "a", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = R.topk_accuracy(cases, ["trip"], "item", "truth", "n", 1, "top1")
    return _rounded(one.crossJoin(F.broadcast(R.topk_accuracy(cases, ["trip"], "item", "truth", "n", 5, "top5"))))


register("rnk_topk_accuracy", topk, f"WITH {V.HOPS}, f AS (SELECT trip, side, max(CASE WHEN seq = 1 THEN node END) AS a, max(CASE WHEN seq = 2 THEN node END) AS b FROM hops WHERE seq <= 2 GROUP BY trip, side HAVING max(CASE WHEN seq = 2 THEN node END) IS NOT NULL), l AS (SELECT a, b AS item, count(*) AS n FROM f WHERE side = 1 GROUP BY a, b), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, item) AS i FROM l), c AS (SELECT f.trip, max(CASE WHEN item = b THEN i END) AS i FROM f LEFT JOIN k ON k.a = f.a WHERE side = 0 GROUP BY f.trip) SELECT round(avg(CASE WHEN i <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN i <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM c")

#: Size of the spatial sample, and zones.
SAMPLE, ZONES = 100, 5


def spatial_sample(spark, sf):
    """SAMPLE real orders by hash, as many from each zone of their first point; what a zone lacks is taken from the rest by hash."""
    p = V.points(spark, sf).where("side = 0 AND seq = 1").select("trip", S.cell(F.col("x"), BOX[0], BOX[1], ZONES).alias("zone"), S.stable("zone", F.col("trip")).alias("h"))
    p = p.withColumn("nth", F.row_number().over(Window.partitionBy("zone").orderBy("h")))
    first = p.where(F.col("nth") <= SAMPLE // ZONES)
    missing = SAMPLE - first.count()  # at most SAMPLE rows
    rest = p.where(F.col("nth") > SAMPLE // ZONES).orderBy("h").limit(missing)
    return first.select("trip", "zone", F.lit(1).alias("round")).union(rest.select("trip", "zone", F.lit(2).alias("round")))


register("rnk_spatial_sample", spatial_sample, f"WITH {V.POINTS}, p AS (SELECT trip, CAST(greatest(0, least({ZONES - 1}, floor((x - {BOX[0]}) / {BOX[1] - BOX[0]} * {ZONES}))) AS INT) AS zone, sha256('zone|' || CAST(trip AS VARCHAR)) AS h FROM points WHERE side = 0 AND seq = 1), n AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY h) AS nth FROM p), a AS (SELECT trip, zone, 1 AS round FROM n WHERE nth <= {SAMPLE // ZONES}), b AS (SELECT trip, zone, 2 AS round, row_number() OVER (ORDER BY h) AS k FROM n WHERE nth > {SAMPLE // ZONES}) SELECT trip, zone, round FROM a UNION ALL SELECT trip, zone, round FROM b WHERE k <= {SAMPLE} - (SELECT count(*) FROM a)")

#: Fine regions that are shared out.
FINE = 60


def quotas(spark, sf):
    """FINE regions shared out to nations by their suppliers: one each, the rest by largest remainder."""
    n = V.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    left = FINE - n.count()  # the nations
    q = P.quantised(n.withColumn("all", F.lit(1)), ["all"], ["nation"], max(0, left))
    return q.select("nation", "n", (F.col("units") + 1).cast("long").alias("regions"))


register("graph_region_quotas", quotas, f"WITH n AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS t, greatest(0, {FINE} - count(*) OVER ()) AS b FROM n), h AS (SELECT *, b * n // t AS q, (b * n) % t AS r FROM t), k AS (SELECT *, b - sum(q) OVER () AS rest, row_number() OVER (ORDER BY r DESC, nation) AS i FROM h) SELECT nation, n, CAST(q + CASE WHEN i <= rest THEN 1 ELSE 0 END + 1 AS BIGINT) AS regions FROM k")


def split_audit(spark, sf):
    """Sizes of a member, non-member and reference split of the customers by hash, overlaps of their parts, and the order-free seal of each part."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("split|"), F.col("c_custkey").cast("string")), 256), 1, 8), 16, 10).cast("long")
    c = V.table(spark, sf, "customer").select("c_custkey", u.alias("u"))
    part = F.when(F.col("u") % 10 < 4, "member").when(F.col("u") % 10 < 8, "nonmember").otherwise("reference")
    c = c.withColumn("part", part)
    again = c.join(c.select(F.col("c_custkey").alias("k"), F.col("part").alias("p")), (F.col("c_custkey") == F.col("k")) & (F.col("part") != F.col("p"))).groupBy("part").agg(F.count(F.lit(1)).alias("overlap"))
    s = c.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("seal"))
    return s.join(again, "part", "left").select("part", "n", "seal", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


register("audit_split", split_audit, "WITH c AS (SELECT c_custkey, CAST('0x' || substr(sha256('split|' || CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) AS u FROM customer), p AS (SELECT *, CASE WHEN u % 10 < 4 THEN 'member' WHEN u % 10 < 8 THEN 'nonmember' ELSE 'reference' END AS part FROM c), o AS (SELECT a.part, count(*) AS overlap FROM p a JOIN p b ON a.c_custkey = b.c_custkey AND a.part <> b.part GROUP BY a.part) SELECT p.part, count(*) AS n, CAST(sum(u) AS BIGINT) AS seal, CAST(coalesce(max(overlap), 0) AS BIGINT) AS overlap FROM p LEFT JOIN o ON o.part = p.part GROUP BY p.part")


def bookkeeping(spark, sf):
    """What a release says of itself: trips, points and those with a route, by method, with an order-free seal of its points."""
    p = corpus(spark, sf)
    said = F.concat_ws("|", F.col("trip").cast("string"), F.col("seq").cast("string"), F.col("l_suppkey").cast("string"))
    seal = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    e = V.edges(spark, sf).select("trip").distinct().withColumn("routed", F.lit(1))
    t = p.groupBy("method", "trip").agg(F.count(F.lit(1)).alias("n"), F.sum(seal).alias("seal")).join(e, "trip", "left")
    return _rounded(t.groupBy("method").agg(F.count(F.lit(1)).alias("trips"), F.sum("n").alias("points"), F.sum("seal").alias("seal"), F.avg(F.coalesce(F.col("routed"), F.lit(0)).cast("double")).alias("yield")))


register("release_bookkeeping", bookkeeping, f"WITH {V.EDGES}, t AS (SELECT {_METHOD} AS method, trip, count(*) AS n, sum(CAST('0x' || substr(sha256(CAST(trip AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)), 1, 8) AS BIGINT)) AS seal FROM points GROUP BY trip) SELECT method, count(*) AS trips, CAST(sum(n) AS BIGINT) AS points, CAST(sum(seal) AS BIGINT) AS seal, round(avg(CASE WHEN trip IN (SELECT trip FROM edges) THEN 1.0 ELSE 0.0 END), 6) AS yield FROM t GROUP BY method")
