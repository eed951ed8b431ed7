"""Hand-computed cases and properties of the operators."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import graph as G
from wayfare.operators import mass as M
from wayfare.operators import privacy as P
from wayfare.operators import routes as R
from wayfare.sources import formats as S

#: Regions of seven places, and three ways from the first: by 3 and 4, straight to 5, and around 3 and 7 before 5.
REGION = {1: 5, 2: 5, 3: 6, 4: 7, 5: 7, 6: 8, 7: 6}
NORTH, WEST, AROUND = [(1, 2), (2, 3), (3, 4), (4, 6)], [(1, 2), (2, 5), (5, 6)], [(1, 2), (2, 3), (3, 7), (7, 2), (2, 5)]


def corpus(spark, real, syn):
    rows = [(i * 2 + side, n + 1, side, u, v, REGION[u], REGION[v]) for side, routes in ((0, real), (1, syn)) for i, r in enumerate(routes) for n, (u, v) in enumerate(r)]
    slots = [(i * 2 + side, side) for side, routes in ((0, real), (1, syn)) for i in range(len(routes))]
    return spark.createDataFrame(rows, "trip long, seq int, side int, u int, v int, ru int, rv int"), spark.createDataFrame(slots, "trip long, side int")


def degrees(spark):
    return spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 1), (5, 1), (7, 1)], "u int, k long")


def test_families_and_support(spark):
    e, _ = corpus(spark, [NORTH], [WEST])
    assert {(r["side"], r["family"]) for r in R.families(e).collect()} == {(0, "5-6-7-8"), (1, "5-7-8")}
    assert M.cpc(M.pairs(R.families(e), ["family"])).first()["cpc"] == 0
    s = M.support(M.pairs(e, ["u", "v"])).first()
    assert (s["recall"], s["precision"], s["f1"]) == pytest.approx((1 / 4, 1 / 3, 2 / 7))
    assert M.support(M.pairs(R.turns(e), ["u", "v", "w"])).first()["f1"] == 0
    assert M.cpc(M.pairs(e, ["u", "v"])).select(M.iou(F.col("cpc")).alias("x")).first()["x"] == pytest.approx(1 / 7)


def bounded(spark, real, syn):
    """Overlap of decision masses over the real one, and of their shares."""
    e, slots = corpus(spark, real, syn)
    p = M.pairs(R.decisions(e, degrees(spark), slots), ["u", "v", "w"], "mass")
    q = M.with_totals(p).agg((F.sum(F.least("r", "s")) / F.max("tr")).alias("x")).first()
    return q["x"], M.cpc(p).first()["cpc"]


def test_a_missing_route_lowers_the_bounded_overlap_only(spark):
    assert bounded(spark, [NORTH, NORTH, WEST], [NORTH, [], WEST]) == pytest.approx((2 / 3, 5 / 6))


def test_each_route_has_unit_decision_mass(spark):
    assert bounded(spark, [NORTH, AROUND], [AROUND, AROUND])[1] == pytest.approx(2 / 3)


def test_branches(spark):
    e, _ = corpus(spark, [NORTH, WEST, NORTH], [NORTH])
    b = R.branches(e).first()
    assert (b["branch_cpc"], b["exit_acc"]) == pytest.approx((4 / 7, 1.0))


def plainly_folded(walk):
    """Backbone and closed walks by cutting out, again and again, the first walk that returns to one of its nodes."""
    rest, loops = list(walk), []
    while True:
        nodes = [rest[0][0], *(v for _, v in rest)] if rest else []
        hit = next(((nodes.index(v), i) for i, v in enumerate(nodes) if v in nodes[:i]), None)
        if hit is None:
            return rest, loops
        loops.append(rest[hit[0] : hit[1]])
        rest = rest[: hit[0]] + rest[hit[1] :]


def test_retention(spark):
    rng = random.Random(8)
    walks = [[(1, 2), (2, 3), (3, 7), (7, 2), (2, 3), (3, 4)], NORTH]
    for _ in range(40):
        nodes = [rng.randrange(5) for _ in range(rng.randrange(2, 14))]
        nodes = [x for i, x in enumerate(nodes) if i == 0 or x != nodes[i - 1]]
        if len(nodes) > 1:
            walks.append(list(zip(nodes, nodes[1:], strict=False)))
    rows = [(i, n + 1, 0, u, v, 0, 0) for i, w in enumerate(walks) for n, (u, v) in enumerate(w)]
    e = spark.createDataFrame(rows, "trip long, seq int, side int, u int, v int, ru int, rv int")
    length = lambda u, v: 1.0 + (u * 3 + v) % 4
    got = {r["trip"]: tuple(r)[2:] for r in R.retention(e, 1.0 + (F.col("u") * 3 + F.col("v")) % 4).collect()}
    for i, w in enumerate(walks):
        back, loops = plainly_folded(w)
        total = lambda x: sum(length(u, v) for u, v in x)
        assert got[i] == pytest.approx((total(w), total(back), sum(map(total, loops)), len(loops), len(w) - len(set(w))))
    assert got[0][3:] == (1, 1)


def test_a_broken_route_is_not_valid(spark):
    e, _ = corpus(spark, [NORTH, [(1, 2), (3, 4)]], [])
    assert {r["trip"] for r in R.valid(e).select("trip").distinct().collect()} == {0}


def test_divergences_with_an_empty_side(spark):
    p = spark.createDataFrame([(1, 2.0, 0.0), (2, 1.0, 0.0)], "k int, r double, s double")
    got = {k: M.jsd(p, k, 4).first()["jsd"] for k in "ABCDEFGH"}
    assert got["B"] == 1 and got["D"] == 1 and got["C"] is None and got["H"] is None
    none = p.where("k > 5")
    assert M.jsd(none, "D").first()["jsd"] == 0 and M.cpc(none).first()["cpc"] == 0
    same = spark.createDataFrame([(1, 2.0, 4.0), (2, 1.0, 2.0)], "k int, r double, s double")
    assert all(M.jsd(same, k, 2).first()["jsd"] == pytest.approx(0, abs=1e-6) for k in "ABCDEFGH" if k not in "E")


def test_budget_parts_add_up():
    assert sum(P.allocate("1/3").values()) == Fraction(1, 3)
    with pytest.raises(ValueError):
        P.allocate(0)


def test_discrete_laplace_law():
    rng = random.Random(5)
    n, scale = 20000, Fraction(3, 2)
    c = Counter(P.discrete_laplace(scale, rng) for _ in range(n))
    q = np.exp(-1 / 1.5)
    for z in (-2, -1, 0, 1, 2):
        assert c[z] / n == pytest.approx((1 - q) / (1 + q) * q ** abs(z), abs=0.012)
    assert P.expected_noise(1.5) == pytest.approx(sum(abs(z) * k for z, k in c.items()) / n, rel=0.05)


def test_largest_remainder(spark):
    c = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 1)], "trip int, atom int, n long")
    assert [r["units"] for r in P.quantised(c, ["trip"], ["atom"], 10).orderBy("atom").collect()] == [4, 3, 3]


def test_simplex_projection(spark):
    x = np.array([3.0, -1.0, 0.5, 2.0])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, x double")
    got = [r["projected"] for r in P.simplex(df, "x", 4.0, ["k"]).orderBy("k").collect()]
    assert got == pytest.approx(P.simplex_vector(x, 4.0)) and sum(got) == pytest.approx(4.0)


def test_sinkhorn_margins():
    rng = np.random.default_rng(1)
    m = P.sinkhorn(rng.random((4, 3)), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]))
    assert m.sum(axis=1) == pytest.approx([0.1, 0.2, 0.3, 0.4]) and m.sum(axis=0) == pytest.approx([0.5, 0.25, 0.25])


def test_graph_search():
    g = G.Graph([0, 1, 0, 2, 3], [1, 2, 3, 4, 2], [1, 1, 1.5, 1, 0.2])
    assert g.path(0, 2) == [0, 3, 2] and g.path(2, 0) is None and g.path(1, 1) == [1]
    assert g.k_paths(0, 2, 2) == [[0, 3, 2], [0, 1, 2]]
    assert g.voronoi([0, 2])[4] == 2


def test_components_and_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7)], "u long, v long")
    assert {r["node"]: r["root"] for r in G.weak_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7}
    assert {r["node"]: r["hops"] for r in G.hop_distances(e, 1).collect()} == {1: 0, 2: 1, 3: 2}
    assert G.largest_component(e).count() == 2


def test_bridge_prefers_the_short_way():
    inf = np.inf
    cost = np.array([[inf, 1.0, 3.0], [inf, inf, 1.0], [inf, inf, inf]])
    got = [G.expected_cost(G.bridge(cost, 2, b), cost, 0, 2) for b in (0.0, 1.0, 5.0)]
    assert got[0] > got[1] > got[2] > 2 and got[0] == pytest.approx((2 * 0.5 + 3 * 0.5))


def test_network_directions(spark):
    ways = spark.createDataFrame([("a", ["1", "2"], [(0.0, 0.0), (0.0, 1.0)], {"highway": "primary", "oneway": "yes"}), ("b", ["2", "3"], [(0.0, 1.0), (1.0, 1.0)], {"highway": "primary"}), ("c", ["3", "4"], [(1.0, 1.0), (2.0, 1.0)], {"highway": "x", "oneway": "-1"})], "id string, nodes array<string>, geometry array<struct<lat: double, lon: double>>, tags map<string, string>")
    assert sorted((r["u"], r["v"]) for r in G.network(ways).collect()) == [("1", "2"), ("2", "3"), ("3", "2"), ("4", "3")]
    assert S.ways_of_classes(ways, ["primary"]).count() == 2 and S.ways_of_classes(ways, []).count() == 3
    assert S.ways_in_box(ways, (0.0, 0.5, 0.0, 0.5)).count() == 1 and S.thinned(ways, (0.0, 2.0, 0.0, 2.0), 2).count() == 2


def test_formats(spark, tmp_path):
    (tmp_path / "p.csv").write_text('TRIP_ID,POLYLINE\n1,"[[-8.6,41.15],[-8.61,41.16]]"\n2,"[]"\n')
    got = S.polylines(spark, str(tmp_path / "p.csv")).collect()
    assert [[tuple(p) for p in r["points"]] for r in got] == [[(41.15, -8.6), (41.16, -8.61)]]
    (tmp_path / "t.txt").write_text("37.70 -122.4 0 100\n37.701 -122.4 1 160\n37.702 -122.4 1 220\n37.703 -122.4 1 280\n37.704 -122.4 0 340\n")
    (r,) = S.taxi(spark, str(tmp_path / "t.txt"), least_points=2, least_s=60, least_km=0.01).collect()
    assert len(r["points"]) == 3 and tuple(r["points"][0]) == (37.701, -122.4)
    for k in (1, 2):
        (tmp_path / f"{k}.plt").write_text("h\n" * 6 + "39.9,116.3,0\n39.91,116.31,0\nbad\n")
    assert S.plt(spark, str(tmp_path / "*.plt")).count() == 2
    (tmp_path / "o.dat").write_text("7: 1,2; 3,4; 5,6\n8: 1,2\n")
    assert [(r["trip"], len(r["points"])) for r in S.dat(spark, str(tmp_path / "o.dat")).collect()] == [("7", 3)]


def test_routes_keep_their_slots(spark):
    r = spark.createDataFrame([(0, [1, 2, 3], True), (1, [], True), (2, [4, 5], False)], "slot int, node_sequence array<int>, accepted boolean")
    assert [len(x["edges"]) for x in S.routes(r).orderBy("slot").collect()] == [2, 0, 0]
    c = spark.createDataFrame([(0, [10, 11], True), (1, [10], False)], "slot int, cpath array<int>, accepted boolean")
    known = spark.createDataFrame([(10, 1, 2), (11, 2, 3)], "edge_id int, u int, v int")
    assert [len(x["edges"]) for x in S.routes(c, known).orderBy("slot").collect()] == [2, 0]
    with pytest.raises(Exception, match="unknown edge"):
        S.routes(c, known.where("edge_id = 10")).collect()


def test_capacity_and_sinks(spark, tmp_path):
    t = spark.range(5)
    assert S.checked_capacity(t, 5).count() == 5
    with pytest.raises(ValueError):
        S.checked_capacity(t, 4)
    S.write_json(str(tmp_path / "a.json"), {"x": float("nan")})
    assert "null" in (tmp_path / "a.json").read_text()
    with pytest.raises(FileExistsError):
        S.write_json(str(tmp_path / "a.json"), {})
    S.write_table(t, str(tmp_path / "t"))
    with pytest.raises(Exception):
        S.write_table(t, str(tmp_path / "t"))
    s = S.split(spark.range(1000), "id", 0.8, "x")
    assert 760 < s.where("is_train").count() < 840


def test_sessions_on_a_stream(spark, tmp_path):
    from wayfare.streaming import sessions

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    q = sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("sessions_out").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("sessions_out"), sessions(e)
    assert 0 < got.count() <= want.count()


def test_curves_by_brute_force(spark):
    from wayfare.operators import curves

    def walks(i, j, n, m):
        yield from ([[(i, j)]] if (i, j) == (n - 1, m - 1) else ([(i, j), *w] for p, q in ((1, 0), (0, 1), (1, 1)) if i + p < n and j + q < m for w in walks(i + p, j + q, n, m)))

    rng = random.Random(4)
    draw = lambda n: [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(n)]
    rows = [(i, draw(rng.randrange(5)), draw(rng.randrange(5))) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    got = {r["k"]: r for r in curves.compared(df, ["k"]).collect()}
    for k, a, b in rows:
        if not a or not b:
            assert got[k]["dtw"] is None or np.isnan(got[k]["dtw"])
            continue
        each = [[float(np.hypot(a[i][0] - b[j][0], a[i][1] - b[j][1])) for i, j in w] for w in walks(0, 0, len(a), len(b))]
        assert got[k]["dtw"] == pytest.approx(min(map(sum, each)) / (len(a) + len(b))) and got[k]["frechet"] == pytest.approx(min(map(max, each)))


def test_curves_of_trips(spark):
    from wayfare import registry

    found = registry.queries()["seq_curves"](spark, "/root/testdata/sf0.001").collect()
    assert found and all(0 <= r["dtw"] and r["frechet"] >= 0 and r["pool"] >= 1 and r["other"] % 2 == 1 for r in found)


def test_hops_reach_the_end_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "u long, v long")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r["node"]: r["hops"] for r in G.hop_distances(e, 0).collect()} == {i: i for i in range(71)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_paths_between_all_nodes(spark):
    from wayfare import registry
    from wayfare.sources import views as V

    sf = "/root/testdata/sf0.001"
    net = {(r["u"], r["v"]): 1.0 + (r["u"] * 13 + r["v"] * 7) % 10 for r in V.edges(spark, sf).select("u", "v").distinct().collect()}
    nodes = {x for p in net for x in p}
    d = {(a, b): 0.0 if a == b else net.get((a, b), float("inf")) for a in nodes for b in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    got = {(r["src"], r["dst"]): r["length"] for r in registry.queries()["graph_shortest_paths"](spark, sf).collect()}
    assert got == {p: x for p, x in d.items() if x < float("inf")} and len(got) == len(nodes) ** 2


def test_every_even_vector_is_linked(spark):
    from wayfare import registry

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    release = np.array([v for k, v in x.items() if k % 2])
    want = {k: float(np.linalg.norm(release - v, axis=1).min()) for k, v in x.items() if k % 2 == 0}
    got = {r["vec_id"]: r["distance"] for r in registry.queries()["attack_linkage"](spark, sf).collect()}
    assert len(got) > 64 and got == pytest.approx(want, abs=1e-4)


def test_paired_bootstrap(spark):
    from wayfare.plans import measures

    rng = np.random.default_rng(3)
    d = rng.normal(0.2, 1.0, 400)
    found = measures.paired(spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "id long, d double"), 2000).first()
    means = d[rng.integers(0, 400, (2000, 400))].mean(axis=1)
    assert found["n"] == 400 and found["draws"] == 2000 and found["difference"] == pytest.approx(d.mean())
    assert (found["low"], found["high"]) == pytest.approx(tuple(np.quantile(means, (0.025, 0.975))), abs=0.02)
    assert 1 / 2001 <= found["p"] == pytest.approx((1 + (means <= 0).sum()) / 2001, abs=0.01)
    same = spark.createDataFrame([(i, 0.0) for i in range(9)], "id long, d double")
    assert measures.paired(same, 100).first()["p"] == 1


def test_nearest_curves_by_brute_force(spark):
    from wayfare.operators import curves

    rng = random.Random(5)
    draw = lambda: [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(rng.randrange(1, 5))]
    real = [(i, *key, draw()) for i, key in enumerate([(0, 0, 1)] * 4 + [(0, 0, 2)] * 3 + [(5, 5, 1)] * 3)]
    syn = [(100 + i, *key, draw()) for i, key in enumerate([(0, 0, 1)] * 5 + [(0, 0, 0)] * 4 + [(7, 7, 3)] * 2)]
    schema = "trip long, o int, d int, bin int, points array<struct<x: double, y: double>>"
    found = {r["trip"]: r for r in curves.nearest(spark.createDataFrame(real, schema), spark.createDataFrame(syn, schema), 2).collect()}
    assert sorted(found) == list(range(10))
    for t, o, d, b, points in real:
        pool = [s for s in syn if s[1:4] == (o, d, b)] or [s for s in syn if s[1:4] == (o, d, 0)] or syn
        warp, leash = curves.distances([[{"x": x, "y": y} for x, y in points]] * len(pool), [[{"x": x, "y": y} for x, y in s[4]] for s in pool])
        assert found[t]["pool"] == len(pool) and found[t]["dtw"] == pytest.approx(warp.min()) and found[t]["frechet"] == pytest.approx(leash.min())


CURVES = "trip long, o int, d int, bin int, points array<struct<x: double, y: double>>"


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_nearest_curves_shuffle_trips_and_not_pairs(spark):
    from wayfare.operators import curves

    rng = random.Random(7)
    wrote = []
    for n in (500, 2000):
        side = lambda k, n=n: spark.createDataFrame([(2 * i + k, 0, 0, 1, [(rng.random(), rng.random()) for _ in range(3)]) for i in range(n)], CURVES)
        before = shuffled(spark)
        assert curves.nearest(side(0), side(1)).where(f"pool = {n}").count() == n
        wrote.append(shuffled(spark) - before)
    assert 0 < wrote[1] < 6 * wrote[0]


@pytest.mark.parametrize("most", [1 << 15, 40])
def test_nearest_curves_of_many_copies(spark, most):
    from wayfare.operators import curves

    rng = random.Random(6)
    draw = lambda n: [(float(rng.randrange(7)), float(rng.randrange(7))) for _ in range(n)]
    shapes = [draw(rng.choice((0, 1, 2, 3, 4, 9))) for _ in range(150)]
    numbers = rng.sample(range(5000), 900)
    real = [(t, 0, 0, rng.choice((1, 2)), rng.choice(shapes[:60])) for t in numbers[:200]] + [(t, 3, 3, 1, draw(2)) for t in numbers[200:230]]
    syn = [(t, 0, 0, rng.choice((1, 2, None)), rng.choice(shapes[40:])) for t in numbers[230:]]
    got = {r["trip"]: r for r in curves.nearest(spark.createDataFrame(real, CURVES), spark.createDataFrame(syn, CURVES), most).collect()}
    assert len(got) == len(real)
    points = lambda rows: [[{"x": x, "y": y} for x, y in r[4]] for r in rows]
    for r in real:
        pool = sorted(s for s in syn if s[1:4] == r[1:4]) or sorted(syn, key=lambda s: s[0])
        found = got[r[0]]
        assert found["pool"] == len(pool)
        warp, leash = curves.distances(points([r]) * len(pool), points(pool))
        if not r[4]:
            assert np.isnan(found["dtw"]) and np.isnan(found["frechet"])
            continue
        assert (found["dtw"], found["frechet"]) == (np.nanmin(warp), np.nanmin(leash))
        assert found["other"] == pool[int(np.nanargmin(warp))][0]


def test_student_quantiles(spark):
    from wayfare.plans import measures

    want = {1: 12.7062047, 5: 2.5705818, 9: 2.2621572, 10: 2.2281389, 30: 2.0422725, 100: 1.9839715, 1000: 1.9623391}
    got = {r["n"]: r["t"] for r in spark.createDataFrame([(n,) for n in want], "n int").select("n", measures.t975(F.col("n")).alias("t")).collect()}
    assert got == pytest.approx(want, abs=2e-5)


def test_sums_below_need_no_single_task(spark):
    rng = random.Random(2)
    rows = [(float(x), rng.randrange(5)) for x in rng.sample(range(9000), 700)]
    got = {r["x"]: r["b"] for r in M.below(spark.createDataFrame(rows, "x double, n int"), "x", "n", "b").collect()}
    assert got == {x: sum(n for y, n in rows if y < x) for x, _ in rows}
    assert M.below(spark.createDataFrame([], "x double, n int"), "x", "n", "b").count() == 0


def test_region_paths_are_shortest():
    from wayfare.plans import blocks

    near = blocks.adjacency()
    assert G.region_paths(near, 0)[5] == [0, 1, 5]
    for a in near:
        for b, path in G.region_paths(near, a).items():
            assert path[0] == a and path[-1] == b and all(v in near[u] for u, v in zip(path, path[1:], strict=False))
            assert len(path) - 1 == sum(abs(p - q) for p, q in zip(divmod(a, blocks.SIDE), divmod(b, blocks.SIDE), strict=True))


def test_nearest_nodes_and_segments_by_brute_force(spark):
    from wayfare.operators import spatial

    rng = random.Random(6)
    pts = [(i, i % 7, rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(150)] + [(200, 0, 4000.0, 1.0)]
    nds = [(k, float(rng.randrange(-30, 30)), float(rng.randrange(-30, 30))) for k in range(25)]
    p, n = spark.createDataFrame(pts, "trip long, seq int, x double, y double"), spark.createDataFrame(nds, "node int, x double, y double")
    got = {r["trip"]: (r["node"], r["distance"]) for r in spatial.nearest(p, n, ["trip", "seq"], 3.0, rounds=4).collect()}
    for t, _, x, y in pts:
        d, k = min((float(np.hypot(a - x, b - y)), k) for k, a, b in nds)
        assert got[t] == (k, pytest.approx(d))
    segs = [(k, a, b, a + rng.uniform(-9, 9), b + rng.uniform(-9, 9)) for k, a, b in nds]
    s = spark.createDataFrame(segs, "edge int, x0 double, y0 double, x1 double, y1 double")
    got = {r["trip"]: (r["edge"], r["distance"]) for r in spatial.nearest_segments(p, s, ["trip", "seq"], 6.0).collect()}

    def off(x, y, a, b, c, d):
        t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / max((c - a) ** 2 + (d - b) ** 2, 1e-12)))
        return float(np.hypot(a + t * (c - a) - x, b + t * (d - b) - y))

    for t, _, x, y in pts:
        d, k = min((off(x, y, *z), k) for k, *z in segs)
        assert (t in got) == (d <= 6) and (t not in got or got[t] == (k, pytest.approx(d)))


def test_noise_is_drawn_once_and_projected(spark):
    from wayfare.plans import blocks

    sf = "/root/testdata/sf0.001"
    a, b = ({r["atom"]: r for r in blocks.noisy(spark, sf, random.Random(k)).collect()} for k in (1, 2))
    exact = {r["b"]: 0 for r in blocks.released(spark, sf, "portals").collect()}
    for r in blocks.released(spark, sf, "portals").collect():
        exact[r["b"]] += r["units"]
    assert set(a) == {-1, *range(len(blocks.PORTALS))} and a != b
    gaps = [abs(x[k]["noisy"] - exact.get(k, 0)) for x in (a, b) for k in x]
    assert np.mean(gaps) == pytest.approx(P.expected_noise(float(blocks.BUDGET)), rel=0.35)
    assert sum(r["projected"] for r in a.values()) == pytest.approx(sum(r["noisy"] for r in a.values())) and min(r["projected"] for r in a.values()) >= 0
    assert P.release({"x": 5}, 1, Fraction(1, 10**9), random.Random(0), bound=7)["x"] in range(-7, 8)


def test_hausdorff_by_plain_loops():
    from wayfare.operators import curves

    rng = random.Random(7)
    draw = lambda: [{"x": float(rng.randrange(9)), "y": float(rng.randrange(9))} for _ in range(rng.randrange(1, 6))]
    a, b = [draw() for _ in range(30)], [draw() for _ in range(30)]
    off = lambda p, q: max(min(float(np.hypot(s["x"] - t["x"], s["y"] - t["y"])) for t in q) for s in p)
    assert curves.hausdorff(a, b) == pytest.approx([max(off(p, q), off(q, p)) for p, q in zip(a, b, strict=True)])
    assert np.isnan(curves.hausdorff([[]], [draw()]))[0]


def test_road_networks_keep_their_largest_part(spark):
    place = lambda lat, lon: {"lat": lat, "lon": lon}
    rows = [("1", ["a", "b", "c"], [place(1.0, 1.0), place(1.0, 1.1), place(1.0, 1.2)], {"highway": "primary"}), ("2", ["x", "y"], [place(5.0, 5.0), place(5.0, 5.1)], {"highway": "primary", "oneway": "yes"}), ("3", ["c", "d"], [place(1.0, 1.2), place(1.1, 1.2)], {"highway": "track"})]
    ways = spark.createDataFrame(rows, "id string, nodes array<string>, geometry array<struct<lat: double, lon: double>>, tags map<string, string>")
    net = G.road_network(ways).orderBy("edge_id").collect()
    assert [(r["edge_id"], r["u"], r["v"]) for r in net] == [(1, "a", "b"), (2, "b", "a"), (3, "b", "c"), (4, "c", "b"), (5, "c", "d"), (6, "d", "c")]
    assert net[4]["length_m"] == pytest.approx(0.1 * 111195, rel=1e-3)
    assert G.road_network(ways, ("primary",)).count() == 4


def test_alternative_paths(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 3, 1.5), (3, 2, 1.0), (2, 0, 9.0)], "u long, v long, length double")
    got = G.alternative_paths(spark.createDataFrame([(0, 2), (2, 1), (0, 2)], "src long, dst long"), e, 2).orderBy("src", "nth").collect()
    assert [(r["src"], r["nth"], list(r["path"]), r["length"]) for r in got] == [(0, 1, [0, 1, 2], 2.0), (0, 2, [0, 3, 2], 2.5), (2, 1, [2, 0, 1], 10.0)]
