"""Loading corpora by name or suffix, match caches with resume, subsets and splits by manifest, serialized arrays."""

from __future__ import annotations

import hashlib
import json
import os
import pickle
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import formats as S

POINTS = "array<struct<lat: double, lon: double>>"
#: Names of the built-in corpora, their readers, and the file each is kept in below the data folder.
NAMED = {"geolife": (S.plt, "geolife"), "beijing": (S.plt, "geolife"), "porto": (S.polylines, "porto/train.csv"), "oldenburg": (S.dat, "oldenburg.dat"), "sf": (S.taxi, "cabspotting"), "cabspotting": (S.taxi, "cabspotting")}


def read_trips(spark: SparkSession, spec: str, limit: int | None = None, data: str = "data") -> DataFrame:
    """(trip, points) of a built-in corpus by its name, or of a file by its suffix: json, parquet, npy, npz, pkl.

    limit keeps the trips of smallest name. npy, npz and pkl files are opened on the driver, once; pickles run code,
    so only files of one's own may be read that way. Any other suffix is an error.
    """
    key = spec.lower()
    if key in NAMED:
        reader, place = NAMED[key]
        found = reader(spark, f"{data.rstrip('/')}/{place}").select("trip", "points")
    elif key.endswith(".parquet"):
        found = spark.read.parquet(spec).select("trip", "points")
    elif key.endswith(".json"):
        rows = spark.read.text(spec, wholetext=True).select(F.from_json("value", "array<array<array<double>>>").alias("all"))
        trips = rows.select(F.posexplode("all").alias("n", "p"))
        found = trips.select(_name(F.col("n")).alias("trip"), F.transform("p", lambda x: F.struct(F.get(x, 0).alias("lat"), F.get(x, 1).alias("lon"))).alias("points"))
    elif key.endswith((".npy", ".npz", ".pkl", ".pickle")):
        found = _from_arrays(spark, _opened(spec))
    else:
        raise ValueError(f"no reader for {spec!r}: a corpus name, or .json, .parquet, .npy, .npz, .pkl")
    found = found.where(F.size("points") >= 2)
    return found if limit is None else found.orderBy("trip").limit(limit)


def _name(n):
    return F.lpad(n.cast("string"), 9, "0")


def _opened(path: str) -> list:
    if path.lower().endswith((".npy", ".npz")):
        z = np.load(path, allow_pickle=True)
        if hasattr(z, "files"):
            z = z[next((k for k in ("trajectories", "trajs") if k in z.files), z.files[0])]
        return list(z)
    with open(path, "rb") as f:
        got = pickle.load(f)
    return list(got["trajectories"] if isinstance(got, dict) and "trajectories" in got else got)


def _from_arrays(spark: SparkSession, trips: Iterable) -> DataFrame:
    rows = [(f"{i:09d}", [(float(p[0]), float(p[1])) for p in t]) for i, t in enumerate(trips)]
    return spark.createDataFrame(rows, f"trip string, points {POINTS}")


def taxi_history(spark: SparkSession, path: str, box=S.BOXES["sf"], most: int = 400) -> DataFrame:
    """(trip, points): the whole history of each taxi file in order of time, occupied or not, thinned to `most` points at even places."""
    from wayfare.functions.sequence import sampled

    f = F.split(F.trim("value"), r"\s+")
    p = spark.read.text(path).select(F.col("_metadata.file_path").alias("trip"), F.get(f, 0).try_cast("double").alias("lat"), F.get(f, 1).try_cast("double").alias("lon"), F.get(f, 3).try_cast("double").alias("ts"))
    p = p.where("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL").where(S.inside(F.col("lat"), F.col("lon"), box))
    t = S._trips(p, "ts")
    return t.select("trip", sampled(F.col("points"), most).alias("points"))


ELEMENT = "id: string, nodes: array<string>, geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>"
WAY = "id string, nodes array<string>, geometry array<struct<lat: double, lon: double>>, tags map<string, string>"


def osm_ways(spark: SparkSession, path: str, elements: bool = False) -> DataFrame:
    """Ways (id, nodes, geometry, tags) with as many places as nodes: JSON lines, or one object whose `elements` hold them."""
    if elements:
        rows = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", f"elements array<struct<{ELEMENT}>>")["elements"]))
    else:
        rows = spark.read.schema(WAY).json(path)
    return rows.where(F.col("id").isNotNull() & (F.size("nodes") >= 2) & (F.size("nodes") == F.size("geometry")))


REQUIRED = {"source_index", "cpath", "connected", "accepted"}


def match_records(records: DataFrame) -> tuple[DataFrame, int]:
    """The records of a match cache and the index of the first, after checks: all columns there, indices without a gap or repeat, no accepted path that is not connected."""
    lacking = REQUIRED - set(records.columns)
    if lacking:
        raise ValueError(f"match records lack {sorted(lacking)}")
    i = F.col("source_index").cast("long")
    n, low, high, different, wrong = records.agg(F.count(F.lit(1)), F.min(i), F.max(i), F.count_distinct(i), F.count_if(F.col("accepted") & ~F.col("connected"))).first()
    if n and (different != n or high - low + 1 != n):
        raise ValueError("source indices are not contiguous")
    if wrong:
        raise ValueError(f"{wrong} accepted paths are not connected")
    return records, int(low or 0)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_matches(trips: DataFrame, match: Callable[[DataFrame], DataFrame], path: str, chunks: int, bound: dict) -> DataFrame:
    """The matches of all trips (trip, ...), written chunk by chunk below `path`; chunks that are whole are not matched again.

    bound: what the cache belongs to (parameters, hashes of inputs). A cache that was bound to something else is an error.
    """
    spark = trips.sparkSession
    seal = hashlib.sha256(json.dumps({"chunks": chunks, **bound}, sort_keys=True).encode()).hexdigest()
    mark = f"{path}/bound-{seal}"
    if _exists(spark, path) and not _exists(spark, mark):
        raise ValueError("the cache belongs to other inputs")
    if not _exists(spark, mark):
        spark.createDataFrame([(seal,)], "seal string").coalesce(1).write.json(mark)
    for k in range(chunks):
        place = f"{path}/chunk-{k:05d}"
        if not _exists(spark, f"{place}/_SUCCESS"):
            match(trips.where(F.pmod(F.xxhash64("trip"), F.lit(chunks)) == k)).write.mode("overwrite").parquet(place)
    return spark.read.parquet(*(f"{path}/chunk-{k:05d}" for k in range(chunks)))


def subset(records: DataFrame, manifest: DataFrame, key: str = "slot") -> DataFrame:
    """Records named by a manifest (position, key), with their position. A repeated or unknown key is an error."""
    n, different = manifest.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n != different:
        raise ValueError("the manifest repeats a record")
    if manifest.join(records.select(key), key, "left_anti").limit(1).count():
        raise ValueError("the manifest names a record that is not there")
    return records.join(manifest.select(key, "position"), key)


def attack_split(train: DataFrame, test: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """(key, part): member and non-member candidates by hash, as many of each, at most `most` and half of the test records; the other test records are the reference."""
    many = min(most, train.count(), test.count() // 2)
    if many <= 0:
        raise ValueError("no record is left for the reference")
    if train.select(key).join(test.select(key), key).limit(1).count():
        raise ValueError("train and test records overlap")
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    member = train.select(key).orderBy(h, key).limit(many).withColumn("part", F.lit("member"))
    other = test.select(key).orderBy(h, key).limit(many).withColumn("part", F.lit("nonmember"))
    rest = test.select(key).join(other.select(key), key, "left_anti").withColumn("part", F.lit("reference"))
    return member.union(other).union(rest)


def round_split(records: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """records with is_train: exactly round(n * share) of them, those of least hashes."""
    n = round(records.count() * share)
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    train = records.select(key).orderBy(h, key).limit(n).withColumn("is_train", F.lit(True))
    return records.join(train, key, "left").withColumn("is_train", F.coalesce("is_train", F.lit(False)))


def by_order(records: DataFrame, key: str, share: float) -> DataFrame:
    """records with is_train: the first share of them in order of the key, by the ranks that ranges of the key give."""
    n = records.count()
    w = Window.partitionBy("_part").orderBy(key)
    ranges = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = records.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5])).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else F.lit(0)
    r = records.withColumn("_part", part)
    before = r.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    r = r.withColumn("_i", F.row_number().over(w)).join(F.broadcast(before), "_part")
    return r.withColumn("is_train", F.col("_i") + F.col("_before") <= round(n * share)).drop("_part", "_i", "_before")


def write_arrays(path: str, **arrays: np.ndarray) -> None:
    """An npz file that is new and appears whole; for results that fit the driver."""
    if os.path.exists(path):
        raise FileExistsError(path)
    part = f"{path}.part"
    with open(part, "wb") as f:
        np.savez_compressed(f, **arrays)
    os.replace(part, path)


def write_pickle(path: str, value: object) -> None:
    """A pickle that is new and appears whole; for results that fit the driver."""
    if os.path.exists(path):
        raise FileExistsError(path)
    part = f"{path}.part"
    with open(part, "wb") as f:
        pickle.dump(value, f, protocol=pickle.HIGHEST_PROTOCOL)
    os.replace(part, path)
