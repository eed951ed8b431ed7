"""Train on the synthetic side or on training users, test on held-out users: prediction, ranking, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators import ranking as R
from wayfare.registry import register
from wayfare.sources import views as V

from .distributions import _rounded
from .sequences import step

TRIPLES = f"{V.RUNS}, t AS (SELECT trip, is_test, cell AS a, lead(cell, 1) OVER w AS b, lead(cell, 2) OVER w AS c FROM runs WINDOW w AS (PARTITION BY trip ORDER BY seq)), t3 AS (SELECT * FROM t WHERE c IS NOT NULL)"
_LISTS = """tr AS (SELECT a, b, c FROM {src} WHERE NOT is_test), te AS (SELECT a, b, c, count(*) AS cases FROM {src} WHERE is_test GROUP BY a, b, c),
c2 AS (SELECT a, b, c, count(*) AS n FROM tr GROUP BY a, b, c), c1 AS (SELECT b, c, count(*) AS n FROM tr GROUP BY b, c),
m2 AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, c) AS rank, sum(n) OVER (PARTITION BY a, b) AS total FROM c2), m1 AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, c) AS rank, sum(n) OVER (PARTITION BY b) AS total FROM c1),
s2 AS (SELECT a, b, max(total) AS total FROM m2 GROUP BY a, b), s1 AS (SELECT b, max(total) AS total FROM m1 GROUP BY b),
z AS (SELECT te.cases, s2.total IS NOT NULL OR s1.total IS NOT NULL AS covered, CASE WHEN s2.total IS NOT NULL THEN m2.rank ELSE m1.rank END AS rank, coalesce(CASE WHEN s2.total IS NOT NULL THEN m2.n ELSE m1.n END, 0) AS n, coalesce(s2.total, s1.total) AS total FROM te LEFT JOIN s2 ON te.a = s2.a AND te.b = s2.b LEFT JOIN s1 ON te.b = s1.b LEFT JOIN m2 ON te.a = m2.a AND te.b = m2.b AND te.c = m2.c LEFT JOIN m1 ON te.b = m1.b AND te.c = m1.c)"""


def _scores_sql(prefix):
    s = lambda x: f"round(sum(CASE WHEN covered THEN cases * {x} ELSE 0 END) / greatest(sum(CASE WHEN covered THEN cases ELSE 0 END), 1), 6)"
    return f"SELECT round(sum(CASE WHEN covered THEN cases ELSE 0 END) / greatest(sum(cases), 1), 6) AS {prefix}_coverage, {s('(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END)')} AS {prefix}_hit_at_1, {s('(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END)')} AS {prefix}_hit_at_5, {s('(CASE WHEN rank <= 5 THEN CAST(1 AS DOUBLE) / rank ELSE 0.0 END)')} AS {prefix}_mrr, {s('(-ln((n + 1e-12) / total))')} AS {prefix}_nll, sum(cases) AS {prefix}_query_count FROM z"


def next_cell(spark, sf):
    t = R.triples(V.runs(spark, sf))
    return _rounded(R.hit_scores(R.backoff(t.where("NOT is_test"), t.where("is_test")), "next_cell"))


register("next_cell", next_cell, f"WITH {TRIPLES}, {_LISTS.format(src='t3')} {_scores_sql('next_cell')}")


def destination(spark, sf):
    """First cell and the cell at 30 % of the sequence predict the last one."""
    r = V.runs(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trip")))
    at = F.greatest(F.lit(2), F.ceil(F.col("n") * 0.3))
    t = r.groupBy("trip", "is_test").agg(F.max("n").alias("n"), F.min_by("cell", "seq").alias("a"), F.max(F.when(F.col("seq") == at, F.col("cell"))).alias("b"), F.max_by("cell", "seq").alias("c"))
    t = t.where((F.greatest(F.lit(2), F.ceil(F.col("n") * 0.3)) < F.col("n")) & (F.col("n") >= 3))
    return _rounded(R.hit_scores(R.backoff(t.where("NOT is_test"), t.where("is_test")), "destination"))


register("destination", destination, f"WITH {V.RUNS}, n AS (SELECT *, count(*) OVER (PARTITION BY trip) AS n FROM runs), d AS (SELECT trip, is_test, max(n) AS n, arg_min(cell, seq) AS a, max(CASE WHEN seq = greatest(2, ceil(n * 0.3)) THEN cell END) AS b, arg_max(cell, seq) AS c FROM n GROUP BY trip, is_test), t3 AS (SELECT * FROM d WHERE greatest(2, ceil(n * 0.3)) < n AND n >= 3), {_LISTS.format(src='t3')} {_scores_sql('destination')}")


def continuation(spark, sf):
    """Next hop of a route from the two before it; odd orders train, even ones test."""
    h = V.hops(spark, sf).withColumn("is_test", F.col("side") == 0)
    t = R.triples(h, "node")
    return _rounded(R.hit_scores(R.backoff(t.where("NOT is_test"), t.where("is_test")), "continuation"))


register("continuation", continuation, f"WITH {V.HOPS}, t AS (SELECT trip, side = 0 AS is_test, node AS a, lead(node, 1) OVER w AS b, lead(node, 2) OVER w AS c FROM hops WINDOW w AS (PARTITION BY trip ORDER BY seq)), t3 AS (SELECT * FROM t WHERE c IS NOT NULL), {_LISTS.format(src='t3')} {_scores_sql('continuation')}")


def _corridor_sql(n, k):
    g = ", ".join(f"lead(node, {i}) OVER w AS g{i}" for i in range(n))
    keys = ", ".join(f"g{i}" for i in range(n))
    return f"WITH {V.HOPS}, g AS (SELECT side, {g} FROM hops WINDOW w AS (PARTITION BY trip ORDER BY seq)), c AS (SELECT {keys}, count(*) FILTER (side = 0) AS r, count(*) FILTER (side = 1) AS s FROM g WHERE g{n - 1} IS NOT NULL GROUP BY {keys}), k AS (SELECT *, CASE WHEN s > 0 THEN row_number() OVER (ORDER BY s DESC, {keys}) END AS i, CASE WHEN r > 0 THEN row_number() OVER (ORDER BY r DESC, {keys}) END AS j FROM c), t AS (SELECT CAST(sum(r) FILTER (i <= {k}) AS DOUBLE) AS ws, CAST(sum(r) FILTER (j <= {k}) AS DOUBLE) AS wr, coalesce(sum(r) FILTER (i <= {k} AND j <= {k}), 0) AS b FROM k), u AS (SELECT CASE WHEN ws > 0 THEN b / ws ELSE 0 END AS p, CASE WHEN wr > 0 THEN b / wr ELSE 0 END AS r FROM t) SELECT round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / greatest(p + r, 1e-12), 6) AS f1 FROM u"


for _n in (3, 4):
    register(f"corridors_{_n}", lambda s, d, n=_n: _rounded(R.corridors(V.hops(s, d), n, 100, "node")), _corridor_sql(_n, 100))


#: Routes, of smallest number, that a query is compared with.
CANDIDATES = 512


def _candidates(routes, prefixes):
    """(prefix, cands, above): for each different prefix its CANDIDATES smallest routes that share a bigram with it, and how many of them pass each score.

    The smallest routes of a union of lists lie among the smallest of each list, so lists are cut before they are joined.
    """
    by = routes.select("i", F.explode("codes").alias("code"))
    by = by.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("i"))).where(F.col("nth") <= CANDIDATES)
    hit = prefixes.select("prefix", F.explode("prefix").alias("code")).join(by, "code").groupBy("prefix", "i").agg(F.count(F.lit(1)).cast("int").alias("score"))
    hit = hit.withColumn("nth", F.row_number().over(Window.partitionBy("prefix").orderBy("i"))).where(F.col("nth") <= CANDIDATES)
    g = hit.join(routes, "i").groupBy("prefix").agg(F.collect_list(F.struct("i", "score", "codes")).alias("cands"))
    return g.withColumn("above", F.transform(F.sequence(F.lit(1), F.size("prefix")), lambda s: F.size(F.filter("cands", lambda c: c["score"] > s))))


def retrieval(spark, sf):
    """Routes of side 1 retrieved by bigrams of an observed prefix of side 0, judged by the Jaccard overlap with its hidden suffix.

    Candidates are the CANDIDATES smallest route ids; equal scores go to the larger hidden overlap, which flatters the result.
    Queries with one prefix share their candidates. Only candidates that meet the suffix are ranked: the others have no
    gain, and of one score they come last.
    """
    h = V.hops(spark, sf).withColumn("b", F.lead("node").over(step()))
    h = h.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trip"))).where("b IS NOT NULL")
    code = F.shiftleft(F.col("node").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    cutting = F.greatest(F.lit(3), F.ceil(F.col("n") * 0.3))
    routes = h.where("side = 1").groupBy(F.col("trip").alias("i")).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    query = h.where((F.col("side") == 0) & (cutting < F.col("n") - 1))
    query = query.groupBy("trip").agg(F.array_sort(F.collect_set(F.when(F.col("seq") < cutting, code))).alias("prefix"), F.collect_set(F.when(F.col("seq") >= cutting, code)).alias("suffix"))
    q = query.join(_candidates(routes, query.select("prefix").distinct()), "prefix")
    meets = F.filter("cands", lambda c: F.arrays_overlap(c["codes"], F.col("suffix")))
    both = F.transform(meets, lambda c: F.struct(c["i"].alias("i"), c["score"].alias("score"), F.size(F.array_intersect(c["codes"], F.col("suffix"))).alias("both"), F.size(c["codes"]).alias("ni")))
    rel = F.transform(both, lambda c: F.struct((-c["score"]).alias("s"), (-(c["both"] / (F.size("suffix") + c["ni"] - c["both"]))).alias("r"), c["i"].alias("i")))
    q = q.select("above", F.array_sort(rel).alias("met"))
    place = lambda c, k: F.get("above", -c["s"] - 1) + k + 1 - F.size(F.filter("met", lambda o: o["s"] < c["s"]))
    q = q.select(F.transform("met", lambda c, k: F.struct((-c["r"]).alias("rel"), place(c, k).alias("rank"))).alias("met"), F.array_sort(F.transform("met", lambda c: F.struct(c["r"].alias("r"), c["i"].alias("i")))).alias("best"))
    gain = lambda k: F.aggregate(F.filter("met", lambda c: c["rank"] <= k), F.lit(0.0), lambda a, c: a + c["rel"] / F.log2(c["rank"] + 1.0))
    ideal = lambda k: F.aggregate(F.transform(F.slice("best", 1, k), lambda c, i: -c["r"] / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    first = F.array_min(F.transform(F.filter("met", lambda c: c["rel"] >= 0.1), lambda c: c["rank"]))
    per = q.select(
        *(F.when(first <= k, 1.0).otherwise(0.0).alias(f"recall_at_{k}") for k in (1, 5, 10)),
        *(F.when(ideal(k) > 0, gain(k) / ideal(k)).otherwise(0.0).alias(f"ndcg_at_{k}") for k in (5, 10)),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        F.coalesce(F.array_max(F.transform(F.filter("met", lambda c: c["rank"] == 1), lambda c: c["rel"])), F.lit(0.0)).alias("top1"),
    )
    total = query.agg(F.count(F.lit(1)).alias("queries"))
    return _rounded(per.agg(*(F.avg(c).alias(c) for c in per.columns), F.count(F.lit(1)).alias("covered")).crossJoin(F.broadcast(total)))


register("retrieval", retrieval, f"WITH {V.HOPS}, h AS (SELECT trip, side, seq, node AS a, lead(node) OVER (PARTITION BY trip ORDER BY seq) AS b, count(*) OVER (PARTITION BY trip) AS n FROM hops), g AS (SELECT *, greatest(3, ceil(n * 0.3)) AS k FROM h WHERE b IS NOT NULL), qq AS (SELECT * FROM g WHERE side = 0 AND k < n - 1), pre AS (SELECT DISTINCT trip AS q, a, b FROM qq WHERE seq < k), suf AS (SELECT DISTINCT trip AS q, a, b FROM qq WHERE seq >= k), rt AS (SELECT DISTINCT trip AS i, a, b FROM g WHERE side = 1), hit AS (SELECT q, i, count(*) AS score FROM pre JOIN rt USING (a, b) GROUP BY q, i QUALIFY row_number() OVER (PARTITION BY q ORDER BY i) <= 512), bo AS (SELECT hit.q, hit.i, count(*) AS both_n FROM hit JOIN suf ON suf.q = hit.q JOIN rt ON rt.i = hit.i AND rt.a = suf.a AND rt.b = suf.b GROUP BY hit.q, hit.i), nq AS (SELECT q, count(*) AS nq FROM suf GROUP BY q), ni AS (SELECT i, count(*) AS ni FROM rt GROUP BY i), s AS (SELECT hit.q, hit.i, score, CAST(coalesce(both_n, 0) AS DOUBLE) / (nq + ni - coalesce(both_n, 0)) AS rel FROM hit LEFT JOIN bo ON bo.q = hit.q AND bo.i = hit.i JOIN nq ON nq.q = hit.q JOIN ni ON ni.i = hit.i), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, rel DESC, i) AS rank, row_number() OVER (PARTITION BY q ORDER BY rel DESC, i) AS best FROM s), per AS (SELECT q, max(CASE WHEN rel >= 0.1 AND rank <= 1 THEN 1.0 ELSE 0.0 END) AS r1, max(CASE WHEN rel >= 0.1 AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS r5, max(CASE WHEN rel >= 0.1 AND rank <= 10 THEN 1.0 ELSE 0.0 END) AS r10, CASE WHEN sum(CASE WHEN best <= 5 THEN rel / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 5 THEN rel / log2(best + 1) ELSE 0 END) ELSE 0 END AS n5, CASE WHEN sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) ELSE 0 END AS n10, coalesce(CAST(1 AS DOUBLE) / min(CASE WHEN rel >= 0.1 THEN rank END), 0) AS mrr, max(CASE WHEN rank = 1 THEN rel END) AS top1 FROM r GROUP BY q) SELECT round(avg(r1), 6) AS recall_at_1, round(avg(r5), 6) AS recall_at_5, round(avg(r10), 6) AS recall_at_10, round(avg(n5), 6) AS ndcg_at_5, round(avg(n10), 6) AS ndcg_at_10, round(avg(mrr), 6) AS mrr, round(avg(top1), 6) AS top1, count(*) AS covered, (SELECT count(DISTINCT trip) FROM qq) AS queries FROM per")


def prototypes(spark, sf):
    """The 20 most frequent whole paths of each origin and destination on side 1, tried on side 0 by the F1 of node sets."""
    a = V.hops(spark, sf).groupBy("trip", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "node"))), lambda x: x["node"]).alias("path"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    a = a.select("trip", "side", F.element_at("path", 1).alias("o"), F.element_at("path", -1).alias("d"), F.array_join("path", "-").alias("sig"), F.array_distinct("path").alias("nodes"))
    c = a.where("side = 1").groupBy("o", "d", "sig").agg(F.count(F.lit(1)).alias("freq"), F.first("nodes").alias("proto"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("o", "d").orderBy(F.desc("freq"), "sig"))).where("rank <= 20")
    t = a.where("side = 0").join(c.select("o", "d", "rank", "proto"), ["o", "d"], "left")
    f1 = 2 * F.size(F.array_intersect("nodes", "proto")) / (F.size("nodes") + F.size("proto"))
    t = t.withColumn("f1", F.when(F.col("rank").isNotNull(), f1))
    per = t.groupBy("trip").agg(F.max(F.when(F.col("rank") == 1, F.col("f1"))).alias("top1"), F.max(F.when(F.col("rank") <= 5, F.col("f1"))).alias("best5"), F.min(F.when(F.col("f1") >= 0.85, F.col("rank"))).alias("hit"))
    z = lambda x: F.avg(F.coalesce(x, F.lit(0.0)))
    return _rounded(per.agg(F.avg(F.when(F.col("top1").isNotNull(), 1.0).otherwise(0.0)).alias("coverage"), z(F.col("top1")).alias("top1_f1"), z(F.col("best5")).alias("best5_f1"), z(F.when(F.col("hit") <= 5, 1.0)).alias("top5_hit"), z(1.0 / F.col("hit")).alias("mrr")))


register("route_prototypes", prototypes, f"WITH {V.HOPS}, a AS (SELECT trip, side, arg_min(node, seq) AS o, arg_max(node, seq) AS d, string_agg(CAST(node AS VARCHAR), '-' ORDER BY seq) AS sig, list_sort(list(DISTINCT node)) AS nodes FROM hops GROUP BY trip, side HAVING count(*) >= 2), c AS (SELECT o, d, sig, nodes AS proto, count(*) AS freq FROM a WHERE side = 1 GROUP BY o, d, sig, nodes QUALIFY row_number() OVER (PARTITION BY o, d ORDER BY count(*) DESC, sig) <= 20), k AS (SELECT *, row_number() OVER (PARTITION BY o, d ORDER BY freq DESC, sig) AS rank FROM c), t AS (SELECT trip, rank, CASE WHEN rank IS NOT NULL THEN 2.0 * len(list_intersect(nodes, proto)) / (len(nodes) + len(proto)) END AS f1 FROM a LEFT JOIN k ON a.o = k.o AND a.d = k.d WHERE side = 0), per AS (SELECT trip, max(CASE WHEN rank = 1 THEN f1 END) AS top1, max(CASE WHEN rank <= 5 THEN f1 END) AS best5, min(CASE WHEN f1 >= 0.85 THEN rank END) AS hit FROM t GROUP BY trip) SELECT round(avg(CASE WHEN top1 IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(coalesce(top1, 0)), 6) AS top1_f1, round(avg(coalesce(best5, 0)), 6) AS best5_f1, round(avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5_hit, round(avg(coalesce(CAST(1 AS DOUBLE) / hit, 0)), 6) AS mrr FROM per")


def region_law(spark, sf):
    """Next region given the current one and the destination, learned on side 1 with 0.5 added to each of five regions, back-off to the current one; mean over trips."""
    h = V.compress(V.hops(spark, sf).select("trip", "seq", "region", "side"), "region")
    w = Window.partitionBy("trip")
    e = h.select("trip", "side", F.col("region").alias("a"), F.lead("region").over(step()).alias("b"), F.max_by("region", "seq").over(w).alias("d")).where("b IS NOT NULL")
    t = e.where("side = 1")

    def law(keys):
        c = t.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"))
        k = Window.partitionBy(*keys)
        return c.withColumns({"total": F.sum("n").over(k), "first": F.row_number().over(k.orderBy(F.desc("n"), "b"))})

    two, one = law(["a", "d"]), law(["a"])
    q = e.where("side = 0")
    for k, t2, keys in (("2", two, ["a", "d"]), ("1", one, ["a"])):
        q = q.join(t2.where("first = 1").select(*keys, F.col("b").alias(f"p{k}"), F.col("total").alias(f"t{k}")), keys, "left")
        q = q.join(t2.select(*keys, "b", F.col("n").alias(f"n{k}")), [*keys, "b"], "left")
    use = F.col("t2").isNotNull()
    total, n, p = F.when(use, F.col("t2")).otherwise(F.col("t1")), F.coalesce(F.when(use, F.col("n2")).otherwise(F.col("n1")), F.lit(0)), F.when(use, F.col("p2")).otherwise(F.col("p1"))
    q = q.select("trip", F.when(p == F.col("b"), 1.0).otherwise(0.0).alias("hit"), F.when(total.isNull(), F.ln(F.lit(5.0))).otherwise(-F.ln((n + 0.5) / (total + 2.5))).alias("loss"))
    per = q.groupBy("trip").agg(F.avg("hit").alias("hit"), F.avg("loss").alias("loss"))
    return _rounded(per.agg(F.avg("hit").alias("accuracy"), F.avg("loss").alias("nll"), F.count(F.lit(1)).alias("trips")))


register("next_region_law", region_law, f"WITH {V.HOPS}, g0 AS (SELECT *, lag(region) OVER (PARTITION BY trip ORDER BY seq) AS pr FROM hops), g AS (SELECT trip, seq, region, side FROM g0 WHERE pr IS NULL OR pr <> region), e0 AS (SELECT trip, side, region AS a, lead(region) OVER (PARTITION BY trip ORDER BY seq) AS b, last_value(region) OVER (PARTITION BY trip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d FROM g), e AS (SELECT * FROM e0 WHERE b IS NOT NULL), c2 AS (SELECT a, d, b, count(*) AS n FROM e WHERE side = 1 GROUP BY a, d, b), c1 AS (SELECT a, b, count(*) AS n FROM e WHERE side = 1 GROUP BY a, b), m2 AS (SELECT a, d, sum(n) AS total, arg_min(b, (-n) * 100 + b) AS p FROM c2 GROUP BY a, d), m1 AS (SELECT a, sum(n) AS total, arg_min(b, (-n) * 100 + b) AS p FROM c1 GROUP BY a), q AS (SELECT e.trip, CASE WHEN coalesce(m2.p, m1.p) = e.b THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN coalesce(m2.total, m1.total) IS NULL THEN ln(5.0) ELSE -ln((coalesce(CASE WHEN m2.total IS NOT NULL THEN c2.n ELSE c1.n END, 0) + 0.5) / (coalesce(m2.total, m1.total) + 2.5)) END AS loss FROM e LEFT JOIN m2 ON m2.a = e.a AND m2.d = e.d LEFT JOIN m1 ON m1.a = e.a LEFT JOIN c2 ON c2.a = e.a AND c2.d = e.d AND c2.b = e.b LEFT JOIN c1 ON c1.a = e.a AND c1.b = e.b WHERE e.side = 0), per AS (SELECT trip, avg(hit) AS hit, avg(loss) AS loss FROM q GROUP BY trip) SELECT round(avg(hit), 6) AS accuracy, round(avg(loss), 6) AS nll, count(*) AS trips FROM per")


def test_table(spark, sf):
    """Holm-adjusted p values of one test a nation, made from order counts, and competition places."""
    o = V.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    o = o.select(F.col("c_nationkey").alias("name"), "n", (1.0 / (1.0 + F.col("n"))).alias("p"))
    h = R.holm(o).withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))
    return _rounded(h.select("name", "p", "adjusted", "place"))


register("holm_and_places", test_table, "WITH o AS (SELECT c_nationkey AS name, count(*) AS n, 1.0 / (1.0 + count(*)) AS p FROM customer GROUP BY c_nationkey), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM o) SELECT name, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) AS DOUBLE), 6) AS adjusted, CAST(rank() OVER (ORDER BY n DESC) AS INT) AS place FROM r")


def attack_auc(spark, sf):
    """AUC and balanced accuracy at the median of text length as a score of the quality label."""
    d = V.table(spark, sf, "documents").select("doc_id", F.length("text").alias("score")).join(V.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    b = R.balanced_at_median(d, "score", "label")
    return _rounded(R.auc(d, "score", "label").crossJoin(F.broadcast(b)))


register("attack_auc", attack_auc, "WITH d AS (SELECT length(text) AS score, quality AS label FROM documents JOIN labels USING (doc_id)), k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM d), c AS (SELECT sum(label) AS p, sum(1 - label) AS n, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS s FROM k), m AS (SELECT quantile_cont(score, 0.5) AS median FROM d) SELECT (SELECT round((s - p * (p + 1) / 2.0) / (p * n), 6) FROM c) AS auc, CAST((SELECT p FROM c) AS BIGINT) AS positives, CAST((SELECT n FROM c) AS BIGINT) AS negatives, (SELECT round((sum(CASE WHEN label = 1 AND score >= median THEN 1.0 ELSE 0.0 END) / sum(label) + sum(CASE WHEN label = 0 AND score < median THEN 1.0 ELSE 0.0 END) / sum(1 - label)) / 2, 6) FROM d, m) AS balanced")
