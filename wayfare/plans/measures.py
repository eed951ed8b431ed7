"""Private measurements, graph queries, statistics and attacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.operators import graph as G
from wayfare.operators import privacy as P
from wayfare.operators import ranking as R
from wayfare.registry import register
from wayfare.sources import views as V

from .distributions import _rounded
from .sequences import step

BUDGET = 1_000_000
_HAMILTON = "h AS (SELECT *, sum(n) OVER (PARTITION BY trip) AS t FROM c), h2 AS (SELECT *, 1000000 * n // t AS q, (1000000 * n) % t AS r FROM h), h3 AS (SELECT *, 1000000 - sum(q) OVER (PARTITION BY trip) AS rest, row_number() OVER (PARTITION BY trip ORDER BY r DESC, {atom}) AS i FROM h2), units AS (SELECT *, q + CASE WHEN i <= rest THEN 1 ELSE 0 END AS units FROM h3)"


def _vector(spark, sf):
    """Cell counts moved by a fixed pattern, as a stand-in for a noisy vector whose draws are not repeatable."""
    return V.ev(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("x", (F.col("n") + (F.col("cell") * 37 % 101 - 50) * 3).cast("double"))


def projection(spark, sf):
    x = _vector(spark, sf)
    total = V.table(spark, sf, "events").count()
    return _rounded(P.simplex(x, "x", float(total), ["cell"]).select("cell", "projected"), 4)


register("dp_simplex", projection, f"WITH {V.EV}, x AS (SELECT cell, CAST(count(*) + (cell * 37 % 101 - 50) * 3 AS DOUBLE) AS x FROM ev GROUP BY cell), c AS (SELECT *, row_number() OVER (ORDER BY x DESC, cell) AS n, sum(x) OVER (ORDER BY x DESC, cell ROWS UNBOUNDED PRECEDING) AS c FROM x), t AS (SELECT *, (c - (SELECT count(*) FROM events)) / n AS t FROM c), k AS (SELECT arg_max(t, n) AS cut FROM t WHERE x > t) SELECT cell, round(greatest(x - cut, 0.0), 4) AS projected FROM t, k")


def lift(spark, sf):
    """Clipped log lift of each cell over the uniform law, shrunk by its signal-to-noise weight, and whether noise of scale 20 dominates it."""
    noise = P.expected_noise(20.0)
    c = V.ev(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    c = c.crossJoin(F.broadcast(t)).withColumn("lift", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.ln((F.col("n") + 1e-9) / F.col("total") * F.col("k")))))
    return _rounded(c.select("cell", "lift", (F.col("lift") * F.col("n") / (F.col("n") + noise)).alias("shrunk"), (F.col("n") < noise).alias("dominated")))


_N = repr(P.expected_noise(20.0))
register("dp_log_lift", lift, f"WITH {V.EV}, c AS (SELECT cell, count(*) AS n FROM ev GROUP BY cell), l AS (SELECT cell, n, greatest(-2.0, least(2.0, ln((n + 1e-9) / sum(n) OVER () * count(*) OVER ()))) AS lift FROM c) SELECT cell, round(lift, 6) AS lift, round(lift * n / (n + {_N}), 6) AS shrunk, n < {_N} AS dominated FROM l")


def dominated(spark, sf):
    """Share of the exact mass of the cells that expected noise of several scales reaches or passes."""
    c = V.ev(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    t = [F.struct(F.lit(x).alias("scale"), (F.sum(F.when(F.col("n") <= P.expected_noise(x), F.col("n")).otherwise(0)) / F.sum("n")).alias("dominated")) for x in SCALES]
    return _rounded(c.agg(F.array(*t).alias("t")).select(F.inline("t")))


SCALES = (5.0, 20.0, 100.0, 200.0)
register("dp_dominated_mass", dominated, f"WITH {V.EV}, c AS (SELECT cell, count(*) AS n FROM ev GROUP BY cell), q(scale, noise) AS (VALUES {', '.join(f'({x}::DOUBLE, {P.expected_noise(x)!r}::DOUBLE)' for x in SCALES)}) SELECT scale, round(sum(CASE WHEN n <= noise THEN n ELSE 0 END) / sum(n), 6) AS dominated FROM c, q GROUP BY scale")


def _network(spark, sf):
    """Every directed pair of neighbouring hops, with a public length."""
    e = V.edges(spark, sf).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct()
    return e.withColumn("length", 1.0 + (F.col("u") * 13 + F.col("v") * 7) % 10)


_NET = f"{V.EDGES}, net AS (SELECT DISTINCT u, v, 1.0 + (u * 13 + v * 7) % 10 AS length FROM edges)"
register("graph_components", lambda s, d: G.weak_components(_network(s, d)), f"WITH RECURSIVE {_NET}, un AS (SELECT u, v FROM net UNION SELECT v, u FROM net), walk AS (SELECT u AS node, u AS root FROM un UNION SELECT un.v, walk.root FROM walk JOIN un ON walk.node = un.u) SELECT CAST(node AS BIGINT) AS node, CAST(min(root) AS BIGINT) AS root FROM walk GROUP BY node")
register("graph_hops", lambda s, d: G.hop_distances(_network(s, d), 1), f"WITH RECURSIVE {_NET}, walk(node, hops) AS (SELECT 1, 0 UNION SELECT net.v, hops + 1 FROM walk JOIN net ON net.u = walk.node WHERE hops < (SELECT count(*) FROM nation)) SELECT CAST(node AS BIGINT) AS node, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY node")


def largest(spark, sf):
    """Edges of the largest weakly connected part."""
    return G.largest_component(_network(spark, sf)).select("u", "v")


register("graph_largest_component", largest, f"WITH RECURSIVE {_NET}, un AS (SELECT u, v FROM net UNION SELECT v, u FROM net), walk AS (SELECT u AS node, u AS root FROM un UNION SELECT un.v, walk.root FROM walk JOIN un ON walk.node = un.u), c AS (SELECT node, min(root) AS root FROM walk GROUP BY node), b AS (SELECT root FROM c GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v FROM net JOIN c ON c.node = u JOIN b ON b.root = c.root")


def paths(spark, sf):
    """Shortest lengths between all pairs of nodes; unreachable pairs have no row."""
    n = _network(spark, sf)
    nodes = n.select("u").union(n.select("v")).distinct()
    asked = nodes.select(F.col("u").alias("src")).crossJoin(F.broadcast(nodes.select(F.col("u").alias("dst"))))
    return _rounded(G.shortest_paths(asked, n).where("length IS NOT NULL").select("src", "dst", "length"))


_PATHS = ", ".join(f"k{i + 1} AS (SELECT a.u, b.v, min(a.length + b.length) AS length FROM k{i} a JOIN k{i} b ON a.v = b.u GROUP BY a.u, b.v)" for i in range(6))
register("graph_shortest_paths", paths, f"WITH {_NET}, k0 AS (SELECT u, v, CAST(length AS DOUBLE) AS length FROM net UNION ALL SELECT DISTINCT x, x, 0.0 FROM (SELECT u AS x FROM net UNION SELECT v FROM net)), {_PATHS} SELECT CAST(u AS BIGINT) AS src, CAST(v AS BIGINT) AS dst, round(min(length), 6) AS length FROM k6 GROUP BY u, v")


def quotient(spark, sf):
    labels = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("region"))
    return _rounded(G.quotient(_network(spark, sf), labels))


register("graph_quotient", quotient, f"WITH {_NET}, q AS (SELECT a.n_regionkey AS ru, b.n_regionkey AS rv, length FROM net JOIN nation a ON a.n_nationkey = u JOIN nation b ON b.n_nationkey = v WHERE a.n_regionkey <> b.n_regionkey) SELECT ru, rv, count(*) AS crossings, round(sum(CAST(1 AS DOUBLE) / length), 6) AS weight FROM q GROUP BY ru, rv")


def priors(spark, sf):
    """Public prior of each region: half of each road's length at either end, and its share."""
    n = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("u"), F.col("n_regionkey").alias("region"))
    e = _network(spark, sf)
    half = e.select("u", F.col("length")).union(e.select(F.col("v").alias("u"), "length")).join(n, "u").groupBy("region").agg((F.sum("length") / 2).alias("mass"))
    t = half.agg(F.sum("mass").alias("total"))
    return _rounded(half.crossJoin(F.broadcast(t)).select("region", "mass", (F.col("mass") / F.col("total")).alias("share")))


register("graph_region_priors", priors, f"WITH {_NET}, h AS (SELECT u, length FROM net UNION ALL SELECT v, length FROM net), r AS (SELECT n_regionkey AS region, sum(length) / 2 AS mass FROM h JOIN nation ON n_nationkey = u GROUP BY 1) SELECT region, round(CAST(mass AS DOUBLE), 6) AS mass, round(CAST(mass / sum(mass) OVER () AS DOUBLE), 6) AS share FROM r")


def cycle_rank(spark, sf):
    """Nodes, undirected edges, parts and independent cycles of the network."""
    e = _network(spark, sf).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    c = G.weak_components(e).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("root").alias("parts"))
    return e.agg(F.count(F.lit(1)).alias("edges")).crossJoin(F.broadcast(c)).select("nodes", "edges", "parts", (F.col("edges") - F.col("nodes") + F.col("parts")).alias("cycles"))


register("graph_cycle_rank", cycle_rank, f"WITH RECURSIVE {_NET}, ue AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM net), un AS (SELECT u, v FROM net UNION SELECT v, u FROM net), walk AS (SELECT u AS node, u AS root FROM un UNION SELECT un.v, walk.root FROM walk JOIN un ON walk.node = un.u), c AS (SELECT node, min(root) AS root FROM walk GROUP BY node), t AS (SELECT count(*) AS nodes, count(DISTINCT root) AS parts FROM c) SELECT nodes, (SELECT count(*) FROM ue) AS edges, parts, (SELECT count(*) FROM ue) - nodes + parts AS cycles FROM t")


def crossing_portals(spark, sf):
    c = V.edges(spark, sf).where("ru != rv").groupBy("ru", "rv", "u", "v").agg(F.count(F.lit(1)).alias("weight"))
    return G.portals(c, 3).select("ru", "rv", "u", "v", "nth", "offset")


register("graph_portals", crossing_portals, f"WITH {V.EDGES}, c AS (SELECT ru, rv, u, v, count(*) AS weight FROM edges WHERE ru <> rv GROUP BY ru, rv, u, v), n AS (SELECT *, row_number() OVER (PARTITION BY ru, rv ORDER BY weight DESC, u, v) AS nth FROM c) SELECT ru, rv, u, v, CAST(nth AS INT) AS nth, CAST(row_number() OVER (ORDER BY ru, rv, nth) - 1 AS INT) AS \"offset\" FROM n WHERE nth <= 3")


#: Student's t at 0.975 for one to nine degrees of freedom.
T975 = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163)
_Z = 1.959963984540054
#: Coefficients of the expansion of t at 0.975 in powers of 1 / degrees of freedom.
_SERIES = ((_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160)


def t975(df):
    """Student's t at 0.975: exact up to nine degrees of freedom, then by its expansion, right to six digits or so."""
    series = F.lit(_Z)
    for i, c in enumerate(_SERIES, 1):
        series = series + c / F.pow(df.cast("double"), F.lit(float(i)))
    return F.when(df < 1, F.lit(None)).when(df <= len(T975), F.element_at(F.array(*map(F.lit, T975)), F.greatest(F.lit(1), F.least(F.lit(len(T975)), df)).cast("int"))).otherwise(series)


def t975_sql(df):
    series = " + ".join([repr(_Z), *(f"{c!r} / pow(CAST({df} AS DOUBLE), {i})" for i, c in enumerate(_SERIES, 1))])
    return f"(CASE WHEN {df} < 1 THEN NULL WHEN {df} <= {len(T975)} THEN [{', '.join(map(repr, T975))}][greatest(1, least({len(T975)}, {df}))] ELSE {series} END)"


def intervals(spark, sf):
    """Mean balance and the half-width of its 95 % interval by Student's t, by nation."""
    c = V.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sd"), F.count(F.lit(1)).alias("n"))
    return _rounded(c.select("c_nationkey", "mean", (t975(F.col("n") - 1) * F.col("sd") / F.sqrt("n")).alias("half"), "n"), 4)


register("stat_intervals", intervals, f"SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, round({t975_sql('(count(*) - 1)')} * stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS half, count(*) AS n FROM customer GROUP BY c_nationkey")


def audit(spark, sf):
    """Relative L1 error that float Laplace noise (for research only, drawn by hash) puts on the cell counts: mean and half-width over ten seeds, by budget."""
    c = V.ev(spark, sf).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    draws = spark.range(10).select(F.col("id").cast("int").alias("seed")).crossJoin(spark.createDataFrame([(0.5,), (1.0,), (2.0,), (4.0,)], "epsilon double"))
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col("cell").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0 - 0.5
    noise = F.abs(F.ln(1 - 2 * F.abs(u)) / F.col("epsilon"))
    e = c.crossJoin(F.broadcast(draws)).groupBy("epsilon", "seed").agg((F.sum(noise * 20) / F.sum("n")).alias("error"))  # 40 rows
    g = e.groupBy("epsilon").agg(F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"), F.count(F.lit(1)).alias("n"))
    return _rounded(g.select("epsilon", "mean", (t975(F.col("n") - 1) * F.col("sd") / F.sqrt("n")).alias("half"), "n"))


register("audit_budgets", audit, f"WITH {V.EV}, c AS (SELECT cell, count(*) AS n FROM ev GROUP BY cell), d AS (SELECT CAST(s AS INT) AS seed, epsilon FROM range(10) r(s), (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) e(epsilon)), u AS (SELECT *, CAST('0x' || substr(sha256(CAST(seed AS VARCHAR) || '|' || CAST(cell AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5 AS u FROM c, d), e AS (SELECT epsilon, seed, sum(abs(ln(1 - 2 * abs(u)) / epsilon) * 20) / sum(n) AS error FROM u GROUP BY epsilon, seed) SELECT epsilon, round(avg(error), 6) AS mean, round({t975_sql('(count(*) - 1)')} * stddev_samp(error) / sqrt(count(*)), 6) AS half, count(*) AS n FROM e GROUP BY epsilon")


def margins(spark, sf):
    """Coverage times quality of each segment over that of the reference segment, clipped, its similarity, and whether it differs by the practical margin."""
    c = V.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.greatest("c_acctbal", F.lit(0.0)) / 10000).alias("quality"))
    ref = c.where("c_mktsegment = 'BUILDING'").select((F.col("coverage") * F.col("quality")).alias("ref"))
    c = c.crossJoin(F.broadcast(ref)).withColumn("own", F.col("coverage") * F.col("quality"))
    return _rounded(c.select("c_mktsegment", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("own") / F.col("ref"))).alias("retention"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("quality"))).alias("similarity"), (F.abs(F.col("own") - F.col("ref")) >= F.greatest(F.lit(0.005), 0.01 * F.abs("ref"))).alias("differs")))


register("stat_retention", margins, "WITH c AS (SELECT c_mktsegment, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS coverage, avg(greatest(c_acctbal, 0.0) / 10000) AS quality FROM customer GROUP BY c_mktsegment), r AS (SELECT coverage * quality AS ref FROM c WHERE c_mktsegment = 'BUILDING') SELECT c_mktsegment, round(greatest(0.0, least(1.0, coverage * quality / ref)), 6) AS retention, round(greatest(0.0, least(1.0, 1 - quality)), 6) AS similarity, abs(coverage * quality - ref) >= greatest(0.005, 0.01 * abs(ref)) AS differs FROM c, r")

#: Vectors of a block; two blocks are compared as one matrix.
VECTORS = 512
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _blocks(e, names):
    """Rows of at most about VECTORS vectors, dealt by a hash."""
    n = e.count()
    of = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, -(-n // VECTORS))))
    return e.groupBy(of.alias("_block")).agg(F.collect_list("vec_id").alias(names[0]), F.collect_list("embedding").alias(names[1])).select(*names)


def full_linkage(spark, sf):
    """Distance of every even vector to the nearest odd one: all pairs of blocks are compared, and each block of queries keeps its least distances."""
    e = V.table(spark, sf, "embeddings").select("vec_id", "embedding").where("embedding IS NOT NULL")
    asked, release = _blocks(e.where("vec_id % 2 = 0"), ("ids", "q")), _blocks(e.where("vec_id % 2 = 1"), ("others", "x"))

    def nearest(batches):
        for p in batches:
            for ids, q, x in zip(p["ids"], p["q"], p["x"], strict=True):
                q, x = np.array(q.tolist(), float), np.array(x.tolist(), float)
                at = ((x**2).sum(axis=1)[None, :] - 2 * (q @ x.T)).argmin(axis=1)
                yield pd.DataFrame({"vec_id": ids, "distance": np.sqrt(((q - x[at]) ** 2).sum(axis=1))})

    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(8 << 20))  # a row holds two blocks
    pairs = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).crossJoin(release.select("x"))
    d = pairs.mapInPandas(nearest, "vec_id long, distance double").groupBy("vec_id").agg(F.min("distance").alias("distance"))
    return _rounded(d, 4)


register("attack_linkage", full_linkage, "SELECT q.vec_id, round(min(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 4) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 2 = 0 AND e.vec_id % 2 = 1 GROUP BY q.vec_id")


def linkage_auc(spark, sf):
    """How well nearness to the release tells members (ids divisible by 4) from other even vectors: AUC and balanced accuracy at the median."""
    d = full_linkage(spark, sf).select((-F.col("distance")).alias("score"), F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0).alias("label"))
    return _rounded(R.auc(d, "score", "label").crossJoin(F.broadcast(R.balanced_at_median(d, "score", "label"))))


register("attack_linkage_auc", linkage_auc, "WITH d AS (SELECT -round(min(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 4) AS score, CASE WHEN q.vec_id % 4 = 0 THEN 1 ELSE 0 END AS label FROM embeddings q, embeddings e WHERE q.vec_id % 2 = 0 AND e.vec_id % 2 = 1 GROUP BY q.vec_id), k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM d), c AS (SELECT sum(label) AS p, sum(1 - label) AS n, sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS s FROM k), m AS (SELECT quantile_cont(score, 0.5) AS median FROM d) SELECT (SELECT round((s - p * (p + 1) / 2.0) / (p * n), 6) FROM c) AS auc, CAST((SELECT p FROM c) AS BIGINT) AS positives, CAST((SELECT n FROM c) AS BIGINT) AS negatives, (SELECT round((sum(CASE WHEN label = 1 AND score >= median THEN 1.0 ELSE 0.0 END) / sum(label) + sum(CASE WHEN label = 0 AND score < median THEN 1.0 ELSE 0.0 END) / sum(1 - label)) / 2, 6) FROM d, m) AS balanced")


#: Draws of the paired bootstrap.
PAIRED_DRAWS = 10_000


def paired(rows, draws):
    """(n, difference, low, high, p, draws) of the paired differences (id, d): mean, 95 % interval and one-sided p = (1 + draws at or below 0) / (draws + 1).

    A row's weight in a draw is Poisson(1), from a hash of its id and the draw: the resampling with replacement
    of tables whose rows nobody gathers. Draw -1 is the rows themselves.
    """
    law = np.floor(np.cumsum([np.exp(-1) / f for f in np.cumprod([1, *range(1, 12)])]) * 2.0**32).astype(np.uint64).astype(np.uint32)

    def sums(batches):
        nth = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        s, n = np.zeros(draws + 1), np.zeros(draws + 1)
        for p in batches:
            for lo in range(0, len(p), 64):
                x = p["d"].to_numpy(float)[lo : lo + 64]
                h = p["h"].to_numpy(np.int64)[lo : lo + 64].astype(np.uint64)[:, None] + nth[None, :]
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u, w = (h >> np.uint64(32)).astype(np.uint32), np.zeros(h.shape, np.uint8)
                for edge in law:
                    w += u >= edge
                s[1:] += x @ w
                n[1:] += w.sum(axis=0)
                s[0], n[0] = s[0] + x.sum(), n[0] + len(x)
        yield pd.DataFrame({"draw": np.arange(-1, draws), "s": s, "n": n})

    dealt = rows.where("d IS NOT NULL").select(F.xxhash64(F.lit("paired"), "id").alias("h"), F.col("d").cast("double").alias("d"))
    t = dealt.mapInPandas(sums, "draw int, s double, n double").groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").withColumn("mean", F.col("s") / F.col("n"))
    drawn = F.when(F.col("draw") >= 0, F.col("mean"))
    own = lambda c: F.max(F.when(F.col("draw") < 0, F.col(c)))
    return t.agg(own("n").cast("long").alias("n"), own("mean").alias("difference"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"), ((1 + F.count_if(drawn <= 0)) / (F.count(drawn) + 1)).alias("p"), F.count(drawn).alias("draws"))


def paired_bootstrap(spark, sf):
    """Paired bootstrap of an order's total price less the extended prices of its lines, in thousands."""
    lines = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_extendedprice").alias("lines"))
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice").join(lines, "id")
    # AQE would read the small join as one partition, but each row costs all draws
    dealt = o.select("id", ((F.col("o_totalprice") - F.col("lines")) / 1000).alias("d")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return _rounded(paired(dealt, PAIRED_DRAWS))


register("stat_bootstrap", paired_bootstrap)
