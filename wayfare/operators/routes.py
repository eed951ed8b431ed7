"""Route counters and the measures of a synthetic route corpus against a real one.

Routes come as edges (trip, seq, u, v, side); slots (trip, side) has a row for every route, also those
without an edge. All shares are over slots where the measure says so, never over survivors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec



def step() -> WindowSpec:
    """Along each route; built when used, so that workers can import this module."""
    return Window.partitionBy("trip").orderBy("seq")


def valid(edges: DataFrame) -> DataFrame:
    """Edges of routes that are connected head to tail."""
    before = F.lag("v").over(step())
    e = edges.withColumn("_ok", F.when(before.isNull() | (before == F.col("u")), 1).otherwise(0))
    return e.withColumn("_all", F.min("_ok").over(Window.partitionBy("trip"))).where("_all = 1").drop("_ok", "_all")


def turns(edges: DataFrame) -> DataFrame:
    """Pairs of neighbouring edges (u, v, w)."""
    return edges.withColumn("w", F.lead("v").over(step())).where("w IS NOT NULL")


def outdegree(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").distinct().groupBy("u").agg(F.count(F.lit(1)).alias("k"))


def decisions(edges: DataFrame, degrees: DataFrame, slots: DataFrame) -> DataFrame:
    """Turns at nodes with several ways out; `mass` gives each slot of its side a unit, split over its decisions, as a share of the slots."""
    t = turns(edges).join(degrees.select(F.col("u").alias("v"), "k"), "v").where("k > 1")
    n = slots.groupBy("side").agg(F.count(F.lit(1)).alias("slots"))
    t = t.withColumn("own", F.count(F.lit(1)).over(Window.partitionBy("trip"))).join(F.broadcast(n), "side")  # one row a side
    return t.withColumn("mass", 1.0 / (F.col("slots") * F.col("own")))


def families(edges: DataFrame) -> DataFrame:
    """Compressed region path of each route as text: (trip, side, family)."""
    first = edges.where("seq = 1").select("trip", "side", F.lit(0).alias("seq"), F.col("ru").alias("region"))
    rest = edges.select("trip", "side", "seq", F.col("rv").alias("region"))
    r = first.union(rest).withColumn("_b", F.lag("region").over(step())).where("_b IS NULL OR _b != region")
    return r.groupBy("trip", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "region"))), lambda x: x["region"].cast("string")), "-").alias("family"))


def branches(edges: DataFrame) -> DataFrame:
    """Conditional overlap of exits and accuracy of the dominant exit, weighted by real mass, at entries with several real exits."""
    t = turns(edges).withColumn("m", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("trip")))
    c = t.groupBy("u", "v", "w").agg(F.sum(F.when(F.col("side") == 0, F.col("m")).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("side") == 1, F.col("m")).otherwise(0.0)).alias("s"))
    k = Window.partitionBy("u", "v")
    c = c.withColumns({"tr": F.sum("r").over(k), "ts": F.sum("s").over(k), "exits": F.sum(F.when(F.col("r") > 0, 1).otherwise(0)).over(k), "i": F.row_number().over(k.orderBy(F.desc(F.round("r", 9)), "w")), "j": F.row_number().over(k.orderBy(F.desc(F.round("s", 9)), "w"))})
    c = c.where("exits > 1")
    per = c.groupBy("u", "v").agg(F.max("tr").alias("mass"), F.max("ts").alias("other"), F.sum(F.when(F.col("ts") > 0, F.least(F.col("r") / F.col("tr"), F.col("s") / F.col("ts"))).otherwise(0.0)).alias("overlap"), F.max(F.when((F.col("i") == 1) & (F.col("j") == 1) & (F.col("ts") > 0), 1.0).otherwise(0.0)).alias("same"))
    return per.agg((F.sum(F.col("mass") * F.col("overlap")) / F.greatest(F.sum("mass"), F.lit(1e-12))).alias("branch_cpc"), (F.sum(F.col("mass") * F.col("same")) / F.greatest(F.sum("mass"), F.lit(1e-12))).alias("exit_acc"))


def prefixes(edges: DataFrame) -> DataFrame:
    """Prefixes of each route's region path with mass 1 / (length - 1), by its first and last node: (side, o, d, prefix, mass)."""
    ends = edges.groupBy("trip", "side").agg(F.min_by("u", "seq").alias("o"), F.max_by("v", "seq").alias("d"))
    f = families(edges).withColumn("path", F.split("family", "-")).where(F.size("path") >= 2).join(ends, ["trip", "side"])
    f = f.withColumn("n", F.explode(F.sequence(F.lit(2), F.size("path"))))
    return f.select("side", "trip", "o", "d", F.array_join(F.slice("path", 1, F.col("n")), "-").alias("prefix"), (1.0 / (F.size("path") - 1)).alias("mass"))


def retention(edges: DataFrame, lengths: Column) -> DataFrame:
    """Per route: length, backbone length, closed length, closed walks and repeated edges; lengths: column of the edge's length.

    A fold along the route keeps the nodes of the backbone and the lengths between them. Where an edge comes back to
    a node of the backbone, everything behind that node is one closed walk and leaves it.
    """
    e = edges.groupBy("trip", "side").agg(F.array_sort(F.collect_list(F.struct("seq", "u", "v", lengths.cast("double").alias("length")))).alias("walk"))
    none = F.array().cast("array<double>")
    start = F.struct(F.array(F.get("walk", F.lit(0))["u"]).alias("nodes"), none.alias("lens"), F.lit(0.0).alias("closed"), F.lit(0).cast("long").alias("walks"))
    sums = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def step_on(s: Column, x: Column) -> Column:
        at = F.array_position(s["nodes"], x["v"]).cast("int")
        kept = F.slice(s["lens"], 1, F.greatest(at - 1, F.lit(0)))
        back = F.struct(F.slice(s["nodes"], 1, F.greatest(at, F.lit(1))).alias("nodes"), kept.alias("lens"), (s["closed"] + sums(s["lens"]) - sums(kept) + x["length"]).alias("closed"), (s["walks"] + 1).alias("walks"))
        on = F.struct(F.concat(s["nodes"], F.array(x["v"])).alias("nodes"), F.concat(s["lens"], F.array(x["length"])).alias("lens"), s["closed"].alias("closed"), s["walks"].alias("walks"))
        return F.when(at > 0, back).otherwise(on)

    e = e.withColumn("end", F.aggregate("walk", start, step_on))
    pairs = F.transform("walk", lambda x: F.struct(x["u"], x["v"]))
    return e.select(F.col("trip").cast("long").alias("trip"), F.col("side").cast("int").alias("side"), sums(F.transform("walk", lambda x: x["length"])).alias("total"), sums(F.col("end.lens")).alias("backbone"), F.col("end.closed").alias("closed"), F.col("end.walks").alias("walks"), (F.size("walk") - F.size(F.array_distinct(pairs))).cast("long").alias("repeats"))
