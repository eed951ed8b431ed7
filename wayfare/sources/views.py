"""Sequences, points and routes read from the relational tables.

ev      events as cell sequences of users on a 10 x 10 grid
runs    ev without consecutive repeats, numbered anew
points  order lines as points of a trip
hops    supplier nations along an order, consecutive repeats removed
edges   directed pairs of neighbouring hops
slots   one row for each order; orders without an edge keep theirs
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("cell"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("trip"), seq.alias("seq"), "cell", F.floor(F.col("cell") / 10).cast("int").alias("row"), (F.col("cell") % 10).alias("col"), (F.col("user_id") % 2).cast("int").alias("side"), (F.col("user_id") % 5 == 4).alias("is_test"), "value")


def compress(df: DataFrame, value: str, trip: str = "trip", seq: str = "seq") -> DataFrame:
    """Rows whose value differs from the one before in the trip, numbered anew."""
    w = Window.partitionBy(trip).orderBy(seq)
    kept = df.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")
    return kept.withColumn(seq, F.row_number().over(w))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(ev(spark, sf_dir).select("trip", "seq", "cell", "side", "is_test"), "cell")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return li.select(F.col("l_orderkey").alias("trip"), seq.alias("seq"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 2).cast("int").alias("side"), "l_suppkey")


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip, seq, node, region, side). Suppliers and nations grow with the table or are fixed; AQE picks the joins."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("node"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("region"))
    p = points(spark, sf_dir).select("trip", "seq", "side", "l_suppkey").join(s, "l_suppkey").join(n, "node")
    return compress(p.select("trip", "seq", "node", "region", "side"), "node")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("trip").orderBy("seq")
    h = hops(spark, sf_dir)
    e = h.select("trip", "seq", "side", F.col("node").alias("u"), F.lead("node").over(w).alias("v"), F.col("region").alias("ru"), F.lead("region").over(w).alias("rv"))
    return e.where("v IS NOT NULL")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip")).distinct().select("trip", (F.col("trip") % 2).cast("int").alias("side"))


# The same views for the SQL equivalents.
EV = """ev AS (SELECT user_id AS trip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CAST(json_extract_string(props, '$.k') AS INT) AS cell, CAST(json_extract_string(props, '$.k') AS INT) // 10 AS row,
  CAST(json_extract_string(props, '$.k') AS INT) % 10 AS col, CAST(user_id % 2 AS INT) AS side, user_id % 5 = 4 AS is_test, value FROM events)"""
RUNS = (
    EV
    + """, runs0 AS (SELECT *, lag(cell) OVER (PARTITION BY trip ORDER BY seq) AS before FROM ev),
runs AS (SELECT trip, row_number() OVER (PARTITION BY trip ORDER BY seq) AS seq, cell, side, is_test FROM runs0 WHERE before IS NULL OR before <> cell)"""
)
POINTS = """points AS (SELECT l_orderkey AS trip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq,
  l_quantity AS x, l_extendedprice AS y, CAST(l_orderkey % 2 AS INT) AS side, l_suppkey FROM lineitem)"""
HOPS = (
    POINTS
    + """, hops0 AS (SELECT trip, seq, side, s_nationkey AS node, n_regionkey AS region, lag(s_nationkey) OVER (PARTITION BY trip ORDER BY seq) AS before
  FROM points JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
hops AS (SELECT trip, row_number() OVER (PARTITION BY trip ORDER BY seq) AS seq, node, region, side FROM hops0 WHERE before IS NULL OR before <> node)"""
)
EDGES = (
    HOPS
    + """, edges0 AS (SELECT trip, seq, side, node AS u, lead(node) OVER w AS v, region AS ru, lead(region) OVER w AS rv FROM hops WINDOW w AS (PARTITION BY trip ORDER BY seq)),
edges AS (SELECT * FROM edges0 WHERE v IS NOT NULL)"""
)
SLOTS = "slots AS (SELECT DISTINCT l_orderkey AS trip, CAST(l_orderkey % 2 AS INT) AS side FROM lineitem)"
