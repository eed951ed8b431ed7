"""Predicates and scalar functions on sequences and points."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfare.functions import sequence as S
from wayfare.operators import curves
from wayfare.registry import register
from wayfare.sources import views as V

#: Box of the order-line points, and edges of uneven buckets.
BOX = (1.0, 50.0, 900.0, 105000.0)
EDGES = [0.0, 5.0, 10.0, 25.0, 60.0, 1000.0]


def step():
    """Along each trip."""
    return Window.partitionBy("trip").orderBy("seq")



def _arrays(df, value):
    return df.groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", value))), lambda x: x[value]).alias("items"))


def bbox_filter(spark, sf):
    p = V.points(spark, sf).where(F.col("x").between(5, 45) & F.col("y").between(2000, 60000))
    return p.groupBy("trip").agg(F.count(F.lit(1)).alias("kept"), F.round(F.min("y"), 6).alias("low")).where("kept >= 2")


register("fil_bbox", bbox_filter, f"WITH {V.POINTS} SELECT trip, count(*) AS kept, round(min(y), 6) AS low FROM points WHERE x BETWEEN 5 AND 45 AND y BETWEEN 2000 AND 60000 GROUP BY trip HAVING count(*) >= 2")


def compressed(spark, sf):
    return V.runs(spark, sf).groupBy("trip").agg(F.count(F.lit(1)).alias("n"), F.sum("cell").alias("cells"))


register("fil_compress", compressed, f"WITH {V.RUNS} SELECT trip, count(*) AS n, sum(cell) AS cells FROM runs GROUP BY trip")


def normalised(spark, sf):
    p = V.points(spark, sf)
    w = Window.partitionBy("trip")
    p = p.select("trip", S.normalised(F.col("y"), F.min("y").over(w), F.max("y").over(w)).alias("z"))
    return p.groupBy("trip").agg(F.round(F.avg("z"), 6).alias("mean_z"))


register("fil_normalise", normalised, f"WITH {V.POINTS}, z AS (SELECT trip, (y - min(y) OVER (PARTITION BY trip)) / greatest(max(y) OVER (PARTITION BY trip) - min(y) OVER (PARTITION BY trip), 1e-12) AS z FROM points) SELECT trip, round(avg(z), 6) AS mean_z FROM z GROUP BY trip")


def record_normaliser(spark, sf):
    """Finite points only, trips of two points and some length."""
    p = V.points(spark, sf).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    p = p.withColumn("d", F.hypot(F.col("x") - F.lag("x").over(step()), F.col("y") - F.lag("y").over(step())))
    return p.groupBy("trip").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 6).alias("length")).where("n >= 2 AND length > 0")


register("fil_records", record_normaliser, f"WITH {V.POINTS}, d AS (SELECT trip, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM points WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) WINDOW w AS (PARTITION BY trip ORDER BY seq)) SELECT trip, count(*) AS n, round(sum(d), 6) AS length FROM d GROUP BY trip HAVING count(*) >= 2 AND round(sum(d), 6) > 0")


def linspace(spark, sf):
    a = _arrays(V.ev(spark, sf), "cell").select("trip", S.sampled(F.col("items"), 8).alias("items"))
    return a.select("trip", F.posexplode("items").alias("pos", "cell"))


register("seq_sample", linspace, f"WITH {V.EV}, n AS (SELECT trip, count(*) AS n FROM ev GROUP BY trip), k AS (SELECT trip, n, unnest(range(CASE WHEN n <= 8 THEN n ELSE 8 END)) AS pos FROM n) SELECT k.trip, CAST(pos AS INT) AS pos, cell FROM k JOIN ev ON ev.trip = k.trip AND ev.seq = 1 + CASE WHEN n <= 8 THEN pos ELSE CAST(round_even(pos * (n - 1) / 7.0, 0) AS BIGINT) END")


def fractional(spark, sf):
    a = V.ev(spark, sf).groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("items"))
    return a.select("trip", F.posexplode(S.landmarks(F.col("items"), 5)).alias("pos", "v")).select("trip", "pos", F.round("v", 6).alias("v"))


register("seq_landmarks", fractional, f"WITH {V.EV}, n AS (SELECT trip, count(*) AS n FROM ev GROUP BY trip), k AS (SELECT trip, n, unnest(range(5)) AS pos FROM n), p AS (SELECT trip, pos, pos * (n - 1) / 4.0 AS p, n FROM k) SELECT p.trip, CAST(pos AS INT) AS pos, round(a.value + (b.value - a.value) * (p - floor(p)), 6) AS v FROM p JOIN ev a ON a.trip = p.trip AND a.seq = 1 + CAST(floor(p) AS BIGINT) JOIN ev b ON b.trip = p.trip AND b.seq = least(n, 2 + CAST(floor(p) AS BIGINT))")


def grid(spark, sf):
    p = V.points(spark, sf)
    return p.groupBy((S.cell(F.col("x"), BOX[0], BOX[1], 16) * 16 + S.cell(F.col("y"), BOX[2], BOX[3], 16)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


_CELL = "CAST(greatest(0, least({g} - 1, floor(({v} - {a}) / {span} * {g}))) AS INT)"


def cell_sql(g, prefix=""):
    return f"({_CELL.format(g=g, v=prefix + 'x', a=BOX[0], span=BOX[1] - BOX[0])} * {g} + {_CELL.format(g=g, v=prefix + 'y', a=BOX[2], span=BOX[3] - BOX[2])})"


register("seq_grid_cell", grid, f"WITH {V.POINTS} SELECT {cell_sql(16)} AS cell, count(*) AS n FROM points GROUP BY 1")


def lengths(spark, sf):
    """Both spherical lengths of a trip with quantity as latitude and price in thousands as longitude."""
    p = V.points(spark, sf).select("trip", "seq", F.col("x").alias("lat"), (F.col("y") / 1000).alias("lon"))
    p = p.withColumns({"lat0": F.lag("lat").over(step()), "lon0": F.lag("lon").over(step())}).where("lat0 IS NOT NULL")
    c = [F.col(k) for k in ("lat0", "lon0", "lat", "lon")]
    return p.groupBy("trip").agg(F.round(F.sum(S.equirectangular_km(*c)), 4).alias("flat_km"), F.round(F.sum(S.haversine_km(*c)), 4).alias("round_km"), F.round(F.sum(S.haversine_km(*c, radius=6371000.0)), 2).alias("metres"))


_HAV = "2 * {r} * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(lat0)) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))))"
register("seq_lengths", lengths, f"WITH {V.POINTS}, s AS (SELECT trip, x AS lat, y / 1000 AS lon, lag(x) OVER w AS lat0, lag(y / 1000) OVER w AS lon0 FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)) SELECT trip, round(sum(sqrt(pow((lat - lat0) * 111.32, 2) + pow((lon - lon0) * 111.32 * cos(radians((lat0 + lat) / 2)), 2))), 4) AS flat_km, round(sum({_HAV.format(r='6371.0088')}), 4) AS round_km, round(sum({_HAV.format(r='6371000.0')}), 2) AS metres FROM s WHERE lat0 IS NOT NULL GROUP BY trip")


def buckets(spark, sf):
    return V.ev(spark, sf).groupBy(S.bucket(F.col("value"), EDGES).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


register("seq_bucket", buckets, f"WITH {V.EV} SELECT CAST({' + '.join(f'CASE WHEN value >= {e} THEN 1 ELSE 0 END' for e in EDGES[1:-1])} AS INT) AS bucket, count(*) AS n FROM ev GROUP BY 1")


def _ends(spark, sf):
    p = V.points(spark, sf)
    return p.groupBy("trip", "side").agg(*(F.min_by(c, "seq").alias(f"{c}0") for c in "xy"), *(F.max_by(c, "seq").alias(f"{c}1") for c in "xy"), F.count(F.lit(1)).alias("n"))


ENDS = "ends AS (SELECT trip, side, arg_min(x, seq) AS x0, arg_min(y, seq) AS y0, arg_max(x, seq) AS x1, arg_max(y, seq) AS y1, count(*) AS n FROM points GROUP BY trip, side)"


def od_family(spark, sf):
    """Four distance classes by eight bearings of first to last point in the unit box."""
    e = _ends(spark, sf).where("n >= 2")
    dx, dy = (F.col("x1") - F.col("x0")) / (BOX[1] - BOX[0]), (F.col("y1") - F.col("y0")) / (BOX[3] - BOX[2])
    family = S.bucket(F.hypot(dx, dy), [0, 0.15, 0.35, 0.6, 9]) * 8 + S.sector(dy, dx, 8)
    return e.groupBy(family.alias("family"), "side").agg(F.count(F.lit(1)).alias("n"))


_DX, _DY = f"((x1 - x0) / {BOX[1] - BOX[0]})", f"((y1 - y0) / {BOX[3] - BOX[2]})"
_TURN = f"(CASE WHEN atan2({_DY}, {_DX}) < 0 THEN atan2({_DY}, {_DX}) + {2 * math.pi!r} ELSE atan2({_DY}, {_DX}) END)"
register("seq_od_family", od_family, f"WITH {V.POINTS}, {ENDS} SELECT CAST(8 * (CASE WHEN sqrt({_DX} ** 2 + {_DY} ** 2) >= 0.15 THEN 1 ELSE 0 END + CASE WHEN sqrt({_DX} ** 2 + {_DY} ** 2) >= 0.35 THEN 1 ELSE 0 END + CASE WHEN sqrt({_DX} ** 2 + {_DY} ** 2) >= 0.6 THEN 1 ELSE 0 END) + least(7, floor({_TURN} / {2 * math.pi!r} * 8)) AS INT) AS family, side, count(*) AS n FROM ends WHERE n >= 2 GROUP BY 1, 2")


def phases(spark, sf):
    """Segments by the phase of their middle along the trip's length."""
    p = V.points(spark, sf).withColumn("d", F.hypot(F.col("x") - F.lag("x").over(step()), F.col("y") - F.lag("y").over(step()))).where("d IS NOT NULL")
    upto = F.sum("d").over(step().rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("d").over(Window.partitionBy("trip"))
    p = p.withColumns({"at": upto, "total": total}).where("total > 0")
    return p.groupBy(S.phase((F.col("at") - F.col("d") / 2) / F.col("total"), 4).alias("phase")).agg(F.count(F.lit(1)).alias("n"))


register("seq_phase", phases, f"WITH {V.POINTS}, d AS (SELECT trip, seq, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)), t AS (SELECT *, sum(d) OVER (PARTITION BY trip ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto, sum(d) OVER (PARTITION BY trip) AS total FROM d WHERE d IS NOT NULL) SELECT CAST(greatest(0, least(3, floor((upto - d / 2) / total * 4))) AS INT) AS phase, count(*) AS n FROM t WHERE total > 0 GROUP BY 1")


def shape(spark, sf):
    """Path length, sinuosity (1 if degenerate) and directness."""
    p = V.points(spark, sf).withColumn("d", F.hypot(F.col("x") - F.lag("x").over(step()), F.col("y") - F.lag("y").over(step())))
    t = p.groupBy("trip").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("path"), F.hypot(F.max_by("x", "seq") - F.min_by("x", "seq"), F.max_by("y", "seq") - F.min_by("y", "seq")).alias("chord"))
    return t.select("trip", F.round("path", 4).alias("path"), F.round(F.when(F.col("chord") > 1e-9, F.col("path") / F.col("chord")).otherwise(1.0), 4).alias("sinuosity"), F.round(F.when(F.col("path") > 1e-9, F.col("chord") / F.col("path")).otherwise(1.0), 4).alias("directness"))


register("seq_shape", shape, f"WITH {V.POINTS}, d AS (SELECT trip, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM points WINDOW w AS (PARTITION BY trip ORDER BY seq)), p AS (SELECT trip, coalesce(sum(d), 0) AS path FROM d GROUP BY trip), {ENDS}, t AS (SELECT p.trip, path, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS chord FROM p JOIN ends ON p.trip = ends.trip) SELECT trip, round(path, 4) AS path, round(CASE WHEN chord > 1e-9 THEN path / chord ELSE 1.0 END, 4) AS sinuosity, round(CASE WHEN path > 1e-9 THEN chord / path ELSE 1.0 END, 4) AS directness FROM t")


def signatures(spark, sf):
    a = _arrays(V.runs(spark, sf), "cell")
    return a.groupBy(S.signature(F.col("items"), 3).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


register("seq_signature", signatures, f"WITH {V.RUNS}, s AS (SELECT trip, string_agg(CAST(cell AS VARCHAR), '-' ORDER BY seq) AS signature FROM runs WHERE seq <= 3 GROUP BY trip) SELECT signature, count(*) AS n FROM s GROUP BY signature")


def qgrams(spark, sf):
    """Distinct bigrams of each trip, counted over trips."""
    a = _arrays(V.runs(spark, sf), "cell").select("trip", F.explode(F.array_distinct(S.grams(F.col("items"), 2))).alias("g"))
    return a.groupBy(F.col("g")[0].alias("a"), F.col("g")[1].alias("b")).agg(F.count(F.lit(1)).alias("trips"))


register("seq_qgrams", qgrams, f"WITH {V.RUNS}, g AS (SELECT DISTINCT trip, cell AS a, lead(cell) OVER (PARTITION BY trip ORDER BY seq) AS b FROM runs) SELECT a, b, count(*) AS trips FROM g WHERE b IS NOT NULL GROUP BY a, b")


def textures(spark, sf):
    r = V.runs(spark, sf).withColumn("b", F.lead("cell").over(step())).where("b IS NOT NULL")
    r = r.withColumn("mass", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("trip")))
    return r.groupBy(S.texture(F.col("cell"), F.col("b")).alias("bucket")).agg(F.round(F.sum("mass"), 6).alias("mass"))


register("seq_texture", textures, f"WITH {V.RUNS}, g AS (SELECT trip, cell, lead(cell) OVER (PARTITION BY trip ORDER BY seq) AS b FROM runs), m AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY trip) AS mass FROM g WHERE b IS NOT NULL) SELECT CAST((CAST(cell AS BIGINT) * 2654435761 + CAST(b AS BIGINT) * 2246822519) % 1024 AS INT) AS bucket, round(sum(CAST(mass AS DOUBLE)), 6) AS mass FROM m GROUP BY 1")


def hash_sample(spark, sf):
    """The ten trips of each side with the least hashes."""
    t = V.slots(spark, sf).withColumn("h", S.stable("17", F.col("trip")))
    w = Window.partitionBy("side").orderBy("h", "trip")
    return t.withColumn("nth", F.row_number().over(w)).where("nth <= 10").select("side", "trip", "nth")


register("rnk_hash_sample", hash_sample, f"WITH {V.SLOTS}, r AS (SELECT side, trip, row_number() OVER (PARTITION BY side ORDER BY sha256('17|' || CAST(trip AS VARCHAR)), trip) AS nth FROM slots) SELECT side, trip, CAST(nth AS INT) AS nth FROM r WHERE nth <= 10")


def gap_segments(spark, sf):
    """A user's events cut where the gap passes six hours or the value jumps; segments of two events stay."""
    e = V.table(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    cutting = (F.col("t") - F.lag("t").over(w) > 6 * 3600 * 1_000_000) | (F.abs(F.col("value") - F.lag("value").over(w)) > 200)
    e = e.withColumn("new", F.when(F.coalesce(cutting, F.lit(True)), 1).otherwise(0))
    e = e.withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")).where("n >= 2")


register("src_gap_segments", gap_segments, "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, abs(value - lag(value) OVER w) AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR jump IS NULL OR gap > 21600000000 OR jump > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM e) SELECT user_id, segment, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, segment HAVING count(*) >= 2")


def shapes(spark, sf):
    """Trips with equal end cells, each with the next one by number: warping, discrete Frechet and Hausdorff distances on 32 points, summed up by pair of cells."""
    p = V.points(spark, sf).withColumn("cell", S.cell(F.col("x"), BOX[0], BOX[1], 4) * 4 + S.cell(F.col("y"), BOX[2], BOX[3], 4))
    t = p.groupBy("trip").agg(F.min_by("cell", "seq").alias("o"), F.max_by("cell", "seq").alias("d"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", (F.col("y") / 1000).alias("y")))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))
    t = t.withColumn("points", S.sampled(F.col("points"), 32))
    w = Window.partitionBy("o", "d").orderBy("trip")
    t = t.withColumn("next", F.lead(F.struct("trip", "points")).over(w)).where("next IS NOT NULL")
    c = curves.compared(t.select("trip", "o", "d", F.col("points").alias("a"), F.col("next.points").alias("b")), ["trip", "o", "d"])
    return c.groupBy("o", "d").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("dtw"), 4).alias("dtw"), F.round(F.sum("frechet"), 4).alias("frechet"), F.round(F.sum("hausdorff"), 4).alias("hausdorff"))


_FREE = "c AS (SELECT trip, seq, x, y / 1000 AS y, " + cell_sql(4) + " AS cell FROM points), e AS (SELECT trip, arg_min(cell, seq) AS o, arg_max(cell, seq) AS d, list({'x': x, 'y': y} ORDER BY seq) AS p FROM (SELECT trip, seq, x, y, cell FROM c) GROUP BY trip), pr AS (SELECT o, d, trip, p AS a, lead(p) OVER (PARTITION BY o, d ORDER BY trip) AS b FROM e), q AS (SELECT * FROM pr WHERE b IS NOT NULL)"
_GRID = "g(o, d, trip, a, b, k, w, l) AS (SELECT o, d, trip, a, b, 0, CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]) FROM q UNION ALL SELECT o, d, trip, a, b, k + 1, list_append(w, s.c + CASE WHEN k = 0 THEN 0 ELSE least(CASE WHEN k >= len(b) THEN w[k - len(b) + 1] ELSE 1e300 END, CASE WHEN k % len(b) > 0 THEN w[k] ELSE 1e300 END, CASE WHEN k >= len(b) AND k % len(b) > 0 THEN w[k - len(b)] ELSE 1e300 END) END), list_append(l, greatest(s.c, CASE WHEN k = 0 THEN 0 ELSE least(CASE WHEN k >= len(b) THEN l[k - len(b) + 1] ELSE 1e300 END, CASE WHEN k % len(b) > 0 THEN l[k] ELSE 1e300 END, CASE WHEN k >= len(b) AND k % len(b) > 0 THEN l[k - len(b)] ELSE 1e300 END) END)) FROM (SELECT *, sqrt((a[k // len(b) + 1].x - b[k % len(b) + 1].x) ** 2 + (a[k // len(b) + 1].y - b[k % len(b) + 1].y) ** 2) AS c FROM g WHERE k < len(a) * len(b)) s)"
register("seq_shape_distances", shapes, f"WITH RECURSIVE {V.POINTS}, {_FREE}, {_GRID}, h AS (SELECT trip, list_max(list_transform(a, lambda s : list_min(list_transform(b, lambda t : sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2))))) AS ab, list_max(list_transform(b, lambda s : list_min(list_transform(a, lambda t : sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2))))) AS ba FROM q), f AS (SELECT o, d, g.trip, w[len(w)] / (len(a) + len(b)) AS dtw, l[len(l)] AS frechet, greatest(ab, ba) AS hausdorff FROM g JOIN h ON h.trip = g.trip WHERE k = len(a) * len(b)) SELECT o, d, count(*) AS pairs, round(sum(dtw), 4) AS dtw, round(sum(frechet), 4) AS frechet, round(sum(hausdorff), 4) AS hausdorff FROM f GROUP BY o, d")


def _shaped(spark, sf, side):
    """(trip, o, d, bin, points) of one side's trips: end cells, length bin (null for a single point), 32 points. Its rows are dealt once, by trip."""
    li = V.table(spark, sf, "lineitem").where(F.col("l_orderkey") % 2 == side)
    li = li.select(F.col("l_orderkey").alias("trip"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")).repartition("trip")
    t = li.groupBy("trip").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "x", "y"))).alias("p"))
    n, at = F.size("p"), lambda i: F.element_at("p", i)
    cell = lambda q: S.cell(q["x"], BOX[0], BOX[1], 4) * 4 + S.cell(q["y"], BOX[2], BOX[3], 4)
    step = lambda q, r: F.hypot(r["x"] - q["x"], r["y"] / 1000 - q["y"] / 1000)
    steps = F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n - 1), step)
    length = F.aggregate(steps, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))
    t = t.select("trip", cell(at(1)).alias("o"), cell(at(-1)).alias("d"), F.when(n >= 2, F.least(F.lit(5), F.floor(F.log1p(length)))).cast("int").alias("bin"), S.sampled(F.col("p"), 32).alias("p"))
    return t.select("trip", "o", "d", "bin", F.transform("p", lambda q: F.struct(q["x"].alias("x"), (q["y"] / 1000).alias("y"))).alias("points"))


def pooled_curves(spark, sf):
    """Each real trip's least distances over all synthetic trips with its end cells and length bin, else with its end cells and bin 0, else over all; on 32 points."""
    found = curves.nearest(_shaped(spark, sf, 0).where("bin IS NOT NULL"), _shaped(spark, sf, 1))
    return found.select("trip", "other", F.round("dtw", 6).alias("dtw"), F.round("frechet", 6).alias("frechet"), "pool")


register("seq_curves", pooled_curves)
