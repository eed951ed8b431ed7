"""Graph operators: components, quotient graphs, shortest paths, Voronoi labels, portals, bridges.

Road graphs are public and small next to the trips, so they are broadcast to tasks as arrays after their size has
been checked; requests are distributed. Components run on edge tables of any size.
"""

from __future__ import annotations

import heapq
import itertools
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edges of a graph that may be broadcast.
MOST_EDGES = 5_000_000


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that executors share (spark.checkpoint.dir), so that later jobs do not compute it anew."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wayfare-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def weak_components(edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, root): least node of each weakly connected component of (u, v); labels spread along edges and over their own labels."""
    both = _written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = _written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("root")))
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        step = label.join(near, "node").select("node", F.least("root", "m").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("m")), "root", "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        new = _written(jump)
        if new.join(label.withColumnRenamed("root", "old"), "node").where("root != old").limit(1).count() == 0:
            return new
        label = new
    raise RuntimeError("labels did not settle")


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes, the one with the least node on ties."""
    c = weak_components(edges)
    best = c.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1).select("root")
    return edges.join(c.join(F.broadcast(best), "root").select(F.col("node").alias("u")), "u", "left_semi")


def network(ways: DataFrame) -> DataFrame:
    """Directed rows (u, v, lat0, lon0, lat1, lon1, highway) of OSM ways (id, nodes, geometry, tags): one for each neighbouring pair and direction that `oneway` allows; none of length 0."""
    n = F.size("nodes")
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v"), F.get("geometry", i).alias("p"), F.get("geometry", i + 1).alias("q")))
    one = F.lower(F.coalesce(F.element_at("tags", "oneway"), F.when(F.element_at("tags", "junction") == "roundabout", "yes").otherwise("no")))
    w = ways.where(n >= 2).select(F.inline(pairs), one.alias("one"), F.element_at("tags", "highway").alias("highway"))
    ahead = w.where(~F.col("one").isin("-1", "reverse")).select("u", "v", F.col("p.lat").alias("lat0"), F.col("p.lon").alias("lon0"), F.col("q.lat").alias("lat1"), F.col("q.lon").alias("lon1"), "highway")
    back = w.where(~F.col("one").isin("yes", "true", "1")).select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("q.lat").alias("lat0"), F.col("q.lon").alias("lon0"), F.col("p.lat").alias("lat1"), F.col("p.lon").alias("lon1"), "highway")
    return ahead.union(back).where("u != v AND (lat0 != lat1 OR lon0 != lon1)")


def merged_graph(ways: DataFrame, places: int = 6) -> DataFrame:
    """(u, v, weight) with u < v: the undirected graph of OSM ways, whose nodes are places rounded to `places` decimals ("lat,lon"), and whose weights are lengths in degrees, the least of parallel ones."""
    name = lambda p: F.concat_ws(",", F.round(p["lat"], places).cast("string"), F.round(p["lon"], places).cast("string"))
    n = F.size("geometry")
    steps = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get("geometry", i).alias("p"), F.get("geometry", i + 1).alias("q")))
    e = ways.where(n >= 2).select(F.inline(steps))
    a, b = name(F.col("p")), name(F.col("q"))
    r = lambda c: F.round(c, places)
    w = F.hypot(r(F.col("p.lat")) - r(F.col("q.lat")), r(F.col("p.lon")) - r(F.col("q.lon")))
    return e.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), w.alias("weight")).where("u != v").groupBy("u", "v").agg(F.min("weight").alias("weight"))


def diverse_portals(crossings: DataFrame, k: int = 6) -> DataFrame:
    """(ru, rv, u, v, nth): up to k crossing edges (ru, rv, u, v, weight, x, y) of each pair of regions: the heaviest, then each time the one farthest from those taken, smaller (u, v) on ties."""

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["weight", "u", "v"], ascending=[False, True, True], ignore_index=True)
        by_name = p.sort_values(["u", "v"]).index.to_numpy()
        xy = p[["x", "y"]].to_numpy(float)
        taken = [0]
        near = np.hypot(*(xy - xy[0]).T)
        while len(taken) < min(k, len(p)):
            near[taken] = -1.0
            taken.append(int(by_name[np.round(near[by_name], 9).argmax()]))
            near = np.minimum(near, np.hypot(*(xy - xy[taken[-1]]).T))
        return p.iloc[taken][["ru", "rv", "u", "v"]].assign(nth=np.arange(1, len(taken) + 1, dtype=np.int32))

    c = crossings.select("ru", "rv", "u", "v", "weight", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = ", ".join(f"{n} {t}" for n, t in c.dtypes if n in ("ru", "rv", "u", "v"))
    return c.groupBy("ru", "rv").applyInPandas(choose, f"{kind}, nth int")  # a group is the border of two regions


def quotient(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(ru, rv, crossings, weight): edges between regions, with the sum of inverse lengths. labels: (node, region)."""
    a, b = labels.select(F.col("node").alias("u"), F.col("region").alias("ru")), labels.select(F.col("node").alias("v"), F.col("region").alias("rv"))
    return edges.join(a, "u").join(b, "v").where("ru != rv").groupBy("ru", "rv").agg(F.count(F.lit(1)).alias("crossings"), F.sum(1.0 / F.col("length")).alias("weight"))


class Graph:
    """Adjacency arrays of a directed graph with lengths."""

    def __init__(self, u: Iterable[int], v: Iterable[int], length: Iterable[float]):
        u, v, length = np.asarray(u, np.int64), np.asarray(v, np.int64), np.asarray(length, float)
        self.nodes = np.unique(np.concatenate([u, v]))
        a, self.to = np.searchsorted(self.nodes, u), np.searchsorted(self.nodes, v)
        order = np.lexsort((self.to, a))
        self.to, self.length = self.to[order], length[order]
        self.first = np.searchsorted(a[order], np.arange(len(self.nodes) + 1))

    @classmethod
    def collected(cls, edges: DataFrame) -> Graph:
        """From (u, v, length), after checking its size."""
        n = edges.count()
        if n > MOST_EDGES:
            raise ValueError(f"{n} edges are too many to broadcast")
        p = edges.select("u", "v", "length").toPandas()
        return cls(p["u"], p["v"], p["length"])

    def index(self, node: int) -> int:
        i = int(np.searchsorted(self.nodes, node))
        return i if i < len(self.nodes) and self.nodes[i] == node else -1

    def search(self, sources: list[int], target: int = -1, allowed: np.ndarray | None = None, heuristic=None, most: int = 1 << 62) -> tuple[dict, dict, dict]:
        """Distances, predecessors and origin of all settled nodes, up to the target or `most` of them; equal distances go to the smaller origin."""
        dist = {s: 0.0 for s in sources}
        origin, before, done = {s: s for s in sources}, {}, {}
        heap = [(heuristic(s) if heuristic else 0.0, s, s) for s in sources]
        heapq.heapify(heap)
        while heap and len(done) < most:
            _, o, x = heapq.heappop(heap)
            if x in done or origin[x] != o:
                continue
            done[x] = dist[x]
            if x == target:
                break
            for k in range(self.first[x], self.first[x + 1]):
                y = int(self.to[k])
                if y in done or (allowed is not None and not allowed[y]):
                    continue
                d = dist[x] + float(self.length[k])
                if y not in dist or d < dist[y] - 1e-15 or (abs(d - dist[y]) <= 1e-15 and o < origin[y]):
                    dist[y], before[y], origin[y] = d, x, o
                    heapq.heappush(heap, (d + (heuristic(y) if heuristic else 0.0), o, y))
        return done, before, origin

    def path(self, source: int, target: int, **kw) -> list[int] | None:
        """Nodes of a shortest path; None without one; [source] if both are one node."""
        a, b = self.index(source), self.index(target)
        if a < 0 or b < 0:
            return None
        done, before, _ = self.search([a], b, **kw)
        if b not in done:
            return None
        out = [b]
        while out[-1] != a:
            out.append(before[out[-1]])
        return [int(self.nodes[i]) for i in reversed(out)]

    def voronoi(self, centers: list[int]) -> dict[int, int]:
        """Nearest center of each reached node, the smaller center on ties."""
        _, _, origin = self.search([self.index(c) for c in sorted(centers)])
        return {int(self.nodes[i]): int(self.nodes[o]) for i, o in origin.items()}

    def k_paths(self, source: int, target: int, k: int, penalty: float = 1.6) -> list[list[int]]:
        """Up to k different paths: after each, its edges are lengthened and the search runs again."""
        keep, out = self.length.copy(), []
        for _ in range(4 * k):
            p = self.path(source, target)
            if p is None:
                break
            if p not in out:
                out.append(p)
            if len(out) == k:
                break
            for a, b in zip(p, p[1:], strict=False):
                i, j = self.index(a), self.index(b)
                for e in range(self.first[i], self.first[i + 1]):
                    if self.to[e] == j:
                        self.length[e] *= penalty
        self.length = keep
        return out


def shortest_paths(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, path, length) of every different request; path is null without one."""
    graph = requests.sparkSession.sparkContext.broadcast(Graph.collected(edges))

    def route(batches):
        g = graph.value
        for p in batches:
            rows = []
            for s, d in zip(p["src"], p["dst"], strict=True):
                found = g.path(int(s), int(d))
                size = None
                if found is not None:
                    size = 0.0
                    for a, b in zip(found, found[1:], strict=False):
                        i, j = g.index(a), g.index(b)
                        size += min(float(g.length[e]) for e in range(g.first[i], g.first[i + 1]) if g.to[e] == j)
                rows.append((s, d, found, size))
            yield pd.DataFrame(rows, columns=["src", "dst", "path", "length"])

    return requests.select("src", "dst").distinct().mapInPandas(route, "src long, dst long, path array<long>, length double")


def alternative_paths(requests: DataFrame, edges: DataFrame, k: int, penalty: float = 1.6) -> DataFrame:
    """(src, dst, nth, path, length) of up to k different paths of each request, found by lengthening the edges of those before."""
    graph = requests.sparkSession.sparkContext.broadcast(Graph.collected(edges))

    def route(batches):
        g = graph.value
        size = {(int(g.nodes[i]), int(g.nodes[g.to[e]])): float(g.length[e]) for i in range(len(g.nodes)) for e in range(g.first[i + 1] - 1, g.first[i] - 1, -1)}
        for p in batches:
            rows = [(s, d, n, path, sum(size[x] for x in itertools.pairwise(path))) for s, d in zip(p["src"], p["dst"], strict=True) for n, path in enumerate(g.k_paths(int(s), int(d), k, penalty), 1)]
            yield pd.DataFrame(rows, columns=["src", "dst", "nth", "path", "length"])

    return requests.select("src", "dst").distinct().mapInPandas(route, "src long, dst long, nth int, path array<long>, length double")


def road_network(ways: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """(edge_id, u, v, lat0, lon0, lat1, lon1, highway, length_m): the directed rows of `network` in its largest weak part, numbered from 1 in order of (u, v), for networks that fit MOST_EDGES."""
    from wayfare.functions.sequence import haversine_km

    rows = network(ways)
    if labels:
        rows = rows.where(F.col("highway").isin(*labels))
    rows = rows.dropDuplicates(["u", "v"])
    if rows.count() > MOST_EDGES:
        raise ValueError("too many edges for one network")
    code = rows.select("u").union(rows.select("v")).distinct().withColumn("id", F.row_number().over(Window.orderBy("u")).cast("long"))  # at most 2 * MOST_EDGES nodes
    e = rows.join(code.selectExpr("u", "id AS a"), "u").join(code.selectExpr("u AS v", "id AS b"), "v")
    big = largest_component(e.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("a"), F.col("v").alias("b"))
    e = e.join(big, ["a", "b"], "left_semi").withColumn("length_m", haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")) * 1000)
    return e.select(F.row_number().over(Window.orderBy("u", "v")).alias("edge_id"), "u", "v", "lat0", "lon0", "lat1", "lon1", "highway", "length_m")


def hop_distances(edges: DataFrame, source: int) -> DataFrame:
    """(node, hops) from one node along directed edges, by rounds over the frontier until it is empty."""
    spark = edges.sparkSession
    seen = spark.createDataFrame([(source, 0)], "node long, hops int")
    e = _written(edges.select("u", "v").distinct())
    front = seen
    for i in itertools.count(1):
        front = _written(front.join(e, front["node"] == e["u"]).select(F.col("v").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(i)))
        if front.limit(1).count() == 0:
            return seen
        seen = _written(seen.union(front))


def effective_resistance(u, v, conductance: np.ndarray) -> np.ndarray:
    """Resistance between the ends of each edge of an undirected network of conductors that fits the driver."""
    nodes = np.unique(np.concatenate([u, v]))
    a, b = np.searchsorted(nodes, u), np.searchsorted(nodes, v)
    lap = np.zeros((len(nodes), len(nodes)))
    np.add.at(lap, (a, a), conductance)
    np.add.at(lap, (b, b), conductance)
    np.add.at(lap, (a, b), -conductance)
    np.add.at(lap, (b, a), -conductance)
    p = np.linalg.pinv(lap, hermitian=True)
    return p[a, a] + p[b, b] - 2 * p[a, b]


def region_paths(near: dict[int, list[int]], source: int) -> dict[int, list[int]]:
    """A path of fewest moves from one region to every other that can be reached; among equals the one found first over ascending neighbours."""
    paths, front = {source: [source]}, [source]
    while front:
        ahead = []
        for x in front:
            for y in sorted(near[x]):
                if y not in paths:
                    paths[y] = [*paths[x], y]
                    ahead.append(y)
        front = ahead
    return {y: p for y, p in paths.items() if y != source}


def farthest_points(points: np.ndarray, k: int, first: int = 0) -> list[int]:
    """Greedy centers: each next one is the point farthest from those before, the smaller index on ties."""
    out = [first]
    near = np.linalg.norm(points - points[first], axis=1)
    while len(out) < min(k, len(points)):
        out.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(points - points[out[-1]], axis=1))
    return out


def bridge(weights: np.ndarray, target: int, beta: float) -> np.ndarray:
    """Row-stochastic law of walks to `target` with probability in proportion to prior * exp(-beta * cost): weights holds the costs, inf for no edge."""
    w = np.where(np.isfinite(weights), np.exp(-beta * np.where(np.isfinite(weights), weights, 0)), 0.0)
    p = w / np.maximum((np.isfinite(weights)).sum(axis=1, keepdims=True), 1)
    p[target] = 0
    z = np.linalg.solve(np.eye(len(p)) - p, np.eye(len(p))[target])
    law = p * z[None, :]
    total = law.sum(axis=1, keepdims=True)
    return np.divide(law, total, out=np.zeros_like(law), where=total > 0)


def killed_bridge(kernel: np.ndarray, target: int, beta: float) -> np.ndarray:
    """Row-stochastic law of walks to `target` in proportion to the kernel's own probability times exp(-beta) a move; rows that cannot reach it are 0."""
    w = kernel * np.exp(-beta)
    w[target] = 0
    z = np.linalg.solve(np.eye(len(w)) - w, np.eye(len(w))[target])
    law = w * z[None, :]
    total = law.sum(axis=1, keepdims=True)
    return np.divide(law, total, out=np.zeros_like(law), where=total > 0)


def expected_moves(law: np.ndarray, source: int, target: int) -> float:
    """Mean number of moves of walks from source to target."""
    return expected_cost(law, np.ones_like(law), source, target)


def expected_cost(law: np.ndarray, weights: np.ndarray, source: int, target: int) -> float:
    """Mean cost of walks from source to target under a law."""
    live = np.delete(np.arange(len(law)), target)
    step = (law * np.where(np.isfinite(weights), weights, 0)).sum(axis=1)
    visits = np.linalg.solve(np.eye(len(live)) - law[np.ix_(live, live)].T, (live == source).astype(float))
    return float(visits @ step[live])


def portals(crossings: DataFrame, k: int = 6) -> DataFrame:
    """The k heaviest crossing edges (ru, rv, u, v, weight) of each pair of regions with their offset in one numbering."""
    w = Window.partitionBy("ru", "rv").orderBy(F.desc("weight"), "u", "v")
    p = crossings.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return p.withColumn("offset", F.row_number().over(Window.orderBy("ru", "rv", "nth")) - 1)  # pairs of regions x k rows
