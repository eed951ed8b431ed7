"""Raw trajectory formats as (trip, seq, lat, lon): read as text, parsed with column functions, filtered by point.

Every reader keeps trips of at least two points. A box is (lat0, lat1, lon0, lon1), both ends inclusive.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Boxes of the cities.
BOXES = {"geolife": (39.75, 40.15, 116.10, 116.65), "porto": (41.10, 41.20, -8.70, -8.55), "sf": (37.60, 37.85, -122.55, -122.30)}

TRIP = "trip string, points array<struct<lat: double, lon: double>>"


def inside(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line number in the file, value), for small files of one trip each: lines are numbered inside whole files only."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return t


def _trips(points: DataFrame, order: str, least: int = 2) -> DataFrame:
    g = points.groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))
    return g.where(F.size("points") >= least)


def plt(spark: SparkSession, path: str, box=BOXES["geolife"]) -> DataFrame:
    """One trip a file: six header lines, then latitude, longitude, ... ; unreadable lines and points outside the box go."""
    f = F.split("value", ",")
    p = _lines(spark, path).where("line >= 6").select(F.col("file").alias("trip"), "line", F.get(f, 0).try_cast("double").alias("lat"), F.get(f, 1).try_cast("double").alias("lon"))
    return _trips(p.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & inside(F.col("lat"), F.col("lon"), box)), "line")


def polylines(spark: SparkSession, path: str, box=BOXES["porto"], most: int = 100, key: str = "TRIP_ID") -> DataFrame:
    """CSV with a POLYLINE of [[lon, lat], ...]: the first `most` points inside the box."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    p = F.from_json("POLYLINE", "array<array<double>>")
    good = F.filter(F.transform(p, lambda x: F.struct(F.get(x, 1).alias("lat"), F.get(x, 0).alias("lon"))), lambda x: inside(x["lat"], x["lon"], box))
    trip = F.col(key) if key in rows.columns else F.sha2("POLYLINE", 256)
    return rows.select(trip.cast("string").alias("trip"), F.slice(good, 1, most).alias("points")).where(F.size("points") >= 2)


def dat(spark: SparkSession, path: str) -> DataFrame:
    """Lines `id: x,y; x,y; ...` in local coordinates."""
    t = spark.read.text(path).where(F.col("value").contains(":")).select(F.split("value", ":", 2).alias("f"))
    pair = F.transform(F.split(F.get("f", 1), ";"), lambda x: F.split(F.trim(x), ","))
    pts = F.filter(F.transform(pair, lambda x: F.struct(F.get(x, 0).try_cast("double").alias("lat"), F.get(x, 1).try_cast("double").alias("lon"))), lambda x: x["lat"].isNotNull() & x["lon"].isNotNull())
    return t.select(F.trim(F.get("f", 0)).alias("trip"), pts.alias("points")).where(F.size("points") >= 2)


def taxi(spark: SparkSession, path: str, box=BOXES["sf"], gap_s: float = 300, speed_kmh: float = 160, least_points: int = 5, least_s: float = 120, least_km: float = 0.5) -> DataFrame:
    """Occupied trips of `lat lon occupied time` files: (trip, points, km, seconds).

    A trip breaks where the taxi is free or outside the box, the time to the row before is not in (0, gap_s],
    or the speed is too high; a breaking row that is itself valid begins the next trip.
    """
    from wayfare.functions.sequence import equirectangular_km

    f = F.split(F.trim("value"), r"\s+")
    p = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.get(f, 0).try_cast("double").alias("lat"), F.get(f, 1).try_cast("double").alias("lon"), F.get(f, 2).try_cast("int").alias("occupied"), F.get(f, 3).try_cast("double").alias("ts")).where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    w = Window.partitionBy("file").orderBy("ts")
    dt = F.col("ts") - F.lag("ts").over(w)
    km = equirectangular_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    p = p.withColumns({"ok": (F.col("occupied") == 1) & inside(F.col("lat"), F.col("lon"), box), "dt": dt, "km": km})
    broken = F.col("dt").isNull() | (F.col("dt") <= 0) | (F.col("dt") > gap_s) | (F.col("km") / (F.col("dt") / 3600) > speed_kmh)
    p = p.withColumn("cut", F.when(~F.col("ok") | broken, 1).otherwise(0)).withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("ok")
    g = p.groupBy("file", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"), F.sum(F.when(F.col("cut") == 0, F.col("km")).otherwise(0.0)).alias("km"), (F.max("ts") - F.min("ts")).alias("seconds"))
    g = g.where((F.size("points") >= least_points) & (F.col("seconds") >= least_s) & (F.col("km") >= least_km))
    return g.select(F.concat_ws(":", "file", "segment").alias("trip"), "points", "km", "seconds")


def smallest_hashes(trips: DataFrame, n: int) -> DataFrame:
    """The n trips with the least SHA-256 of their name."""
    return trips.orderBy(F.sha2("trip", 256), "trip").limit(n)


def normalised(trips: DataFrame) -> DataFrame:
    """Finite points on the globe only; trips of fewer than two points or of no length go."""
    ok = lambda x: ~F.isnan(x["lat"]) & ~F.isnan(x["lon"]) & (F.abs(x["lat"]) <= 90) & (F.abs(x["lon"]) <= 180)
    t = trips.withColumn("points", F.filter("points", ok)).where(F.size("points") >= 2)
    return t.where(F.exists("points", lambda x: (x["lat"] != F.element_at("points", 1)["lat"]) | (x["lon"] != F.element_at("points", 1)["lon"])))


def checked_capacity(trips: DataFrame, capacity: int) -> DataFrame:
    """trips, or an error if there are more than the public capacity; their number is not told."""
    if trips.limit(capacity + 1).count() > capacity:
        raise ValueError("more records than the public capacity")
    return trips


def ways_in_box(ways: DataFrame, box, pad: float = 0.08) -> DataFrame:
    """OSM ways with a vertex inside the padded box."""
    dy, dx = (box[1] - box[0]) * pad, (box[3] - box[2]) * pad
    wide = (box[0] - dy, box[1] + dy, box[2] - dx, box[3] + dx)
    return ways.where(F.exists("geometry", lambda p: inside(p["lat"], p["lon"], wide)))


def ways_of_classes(ways: DataFrame, classes: list[str]) -> DataFrame:
    return ways.where(F.element_at("tags", "highway").isin(classes)) if classes else ways


def thinned(ways: DataFrame, box, most: int, grid: int = 80) -> DataFrame:
    """At most `most` ways, dealt round robin over the cells of their centroids, longest first."""
    n = F.size("geometry")
    mean = lambda k: F.aggregate("geometry", F.lit(0.0), lambda a, p: a + p[k]) / n
    step = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.hypot(F.get("geometry", i)["lat"] - F.get("geometry", i - 1)["lat"], F.get("geometry", i)["lon"] - F.get("geometry", i - 1)["lon"]))
    cell = lambda v, a, b: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((v - a) / (b - a) * grid)))
    w = ways.where(n >= 2).withColumns({"_cell": cell(mean("lat"), box[0], box[1]) * grid + cell(mean("lon"), box[2], box[3]), "_len": F.aggregate(step, F.lit(0.0), lambda a, x: a + x)})
    w = w.withColumn("_turn", F.row_number().over(Window.partitionBy("_cell").orderBy(F.desc("_len"), "id")))
    return w.orderBy("_turn", "_cell").limit(most).drop("_cell", "_len", "_turn")


def routes(records: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(slot, edges array<struct<u, v>>) of records with node_sequence, with pairs array<array<int>>, or with edge ids in cpath or edge_ids, resolved through edges (edge_id, u, v).

    Not accepted or empty: an empty route that keeps its slot. An unknown edge id is an error.
    """
    empty = F.array().cast("array<struct<u: long, v: long>>")
    cols = set(records.columns)
    ok = F.coalesce(F.col("accepted"), F.lit(False)) if "accepted" in cols else F.lit(True)
    if "node_sequence" in cols:
        n = F.size("node_sequence")
        walk = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("node_sequence", i).cast("long").alias("u"), F.get("node_sequence", i + 1).cast("long").alias("v")))).otherwise(empty)
        return records.select("slot", F.when(ok, walk).otherwise(empty).alias("edges"))
    if "pairs" in cols:
        walk = F.transform("pairs", lambda p: F.struct(F.get(p, 0).cast("long").alias("u"), F.get(p, 1).cast("long").alias("v")))
        return records.select("slot", F.when(ok, F.coalesce(walk, empty)).otherwise(empty).alias("edges"))
    ids = "cpath" if "cpath" in cols else "edge_ids"
    long = records.where(ok).select("slot", F.posexplode(ids).alias("seq", "edge_id")).join(edges, "edge_id", "left")
    long = long.withColumn("u", F.when(F.col("u").isNull(), F.raise_error(F.concat(F.lit("unknown edge "), F.col("edge_id").cast("string")))).otherwise(F.col("u")))
    walks = long.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))), lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))).alias("edges"))
    return records.select("slot").join(walks, "slot", "left").select("slot", F.coalesce("edges", empty).alias("edges"))


def write_json(path: str, payload: dict) -> None:
    """A JSON file that is new and appears whole; NaN becomes null."""
    if os.path.exists(path):
        raise FileExistsError(path)

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and x != x else x

    part = f"{path}.part"
    with open(part, "w") as f:
        json.dump(plain(payload), f, allow_nan=False, indent=1)
    os.replace(part, path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, JSON or CSV that never replaces what is there; NaN becomes null."""
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    clean.write.mode("errorifexists").format(kind).save(path)


def split(ids: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """ids with is_train: a share chosen by hash, so every machine chooses alike and the parts are disjoint."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    return ids.withColumn("is_train", u < share)
