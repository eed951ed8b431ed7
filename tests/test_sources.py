"""Readers, caches, splits and the ledger on small files."""

import json
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import clusters as C
from wayfare.operators import graph as G
from wayfare.operators import ledger as L
from wayfare.sources import formats as S
from wayfare.sources import readers as R

TRIPS = [[(41.1 + i / 100, -8.6 + i / 50 + j / 200) for j in range(2 + i % 3)] for i in range(5)]


def found(df):
    return [[(p["lat"], p["lon"]) for p in r["points"]] for r in df.orderBy("trip").collect()]


def test_corpora_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TRIPS))
    np.savez(tmp_path / "a.npz", trajectories=np.array([np.array(t) for t in TRIPS] + [None], object)[:-1])
    R.write_pickle(str(tmp_path / "a.pkl"), TRIPS)
    for name in ("a.json", "a.npz", "a.pkl"):
        assert found(R.read_trips(spark, str(tmp_path / name))) == TRIPS
    spark.createDataFrame([(str(i), t) for i, t in enumerate(TRIPS)], f"trip string, points {R.POINTS}").write.parquet(str(tmp_path / "a.parquet"))
    assert found(R.read_trips(spark, str(tmp_path / "a.parquet"), limit=2)) == TRIPS[:2]
    with pytest.raises(ValueError):
        R.read_trips(spark, str(tmp_path / "a.txt"))
    with pytest.raises(FileExistsError):
        R.write_pickle(str(tmp_path / "a.pkl"), TRIPS)
    R.write_arrays(str(tmp_path / "b.npz"), x=np.arange(3))
    assert np.load(tmp_path / "b.npz")["x"].tolist() == [0, 1, 2]


def test_corpora_by_name(spark, tmp_path):
    (tmp_path / "porto").mkdir()
    (tmp_path / "porto" / "train.csv").write_text('"TRIP_ID","POLYLINE"\n"t1","[[-8.61,41.15],[-8.62,41.16],[0.0,0.0]]"\n"t2","[[-8.61,41.15]]"\n')
    got = R.read_trips(spark, "Porto", data=str(tmp_path)).collect()
    assert [(r["trip"], len(r["points"])) for r in got] == [("t1", 2)]


def test_whole_taxi_histories(spark, tmp_path):
    rows = [f"{37.7 + i / 10000:.5f} -122.4 {i % 2} {5000 - i}" for i in range(900)] + ["bad line", "1.0 1.0 1 3"]
    (tmp_path / "cab.txt").write_text("\n".join(rows))
    (t,) = R.taxi_history(spark, str(tmp_path)).collect()
    lat = [p["lat"] for p in t["points"]]
    want = [37.7 + (899 - i) / 10000 for i in np.linspace(0, 899, 400).round().astype(int)]
    assert lat == pytest.approx(want, abs=2e-5)


def test_osm_ways(spark, tmp_path):
    way = {"id": "7", "nodes": ["a", "b", "c"], "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.0, "lon": 2.0000001}, {"lat": 1.5, "lon": 2.0}], "tags": {"highway": "primary"}}
    (tmp_path / "lines.json").write_text(json.dumps(way) + "\n" + json.dumps({**way, "id": "8", "nodes": ["a"]}) + "\n")
    (tmp_path / "one.json").write_text(json.dumps({"elements": [way, {"type": "node"}]}))
    for path, elements in (("lines.json", False), ("one.json", True)):
        (r,) = R.osm_ways(spark, str(tmp_path / path), elements).collect()
        assert r["id"] == "7" and r["tags"]["highway"] == "primary" and len(r["geometry"]) == 3
    (e,) = G.merged_graph(R.osm_ways(spark, str(tmp_path / "lines.json"))).collect()
    assert (e["u"], e["v"], e["weight"]) == ("1.0,2.0", "1.5,2.0", 0.5)


def test_match_records_are_checked(spark):
    schema = "source_index long, cpath array<int>, connected boolean, accepted boolean"
    good = [(4, [1], True, True), (5, [], False, False), (6, [2, 3], True, False)]
    records, first = R.match_records(spark.createDataFrame(good, schema))
    assert first == 4 and records.count() == 3 and R.match_records(spark.createDataFrame([], schema))[1] == 0
    for bad in (good + [(9, [], True, True)], good + [(6, [], True, True)], [(4, [1], False, True)]):
        with pytest.raises(ValueError):
            R.match_records(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError):
        R.match_records(records.drop("cpath"))


def test_match_cache_resumes(spark, tmp_path):
    path, done = f"file://{tmp_path}/cache", []
    trips = spark.createDataFrame([(f"t{i}", i) for i in range(40)], "trip string, n int")

    def match(df):
        done.append(1)
        if len(done) == 3:
            raise RuntimeError("lost")
        return df.withColumn("route", F.col("n") * 2)

    with pytest.raises(RuntimeError):
        R.cached_matches(trips, match, path, 4, {"radius": 200})
    got = R.cached_matches(trips, match, path, 4, {"radius": 200})
    assert len(done) == 5 and got.count() == 40 and got.where("route != 2 * n").count() == 0
    with pytest.raises(ValueError):
        R.cached_matches(trips, match, path, 4, {"radius": 100})


def test_subsets_and_splits(spark):
    records = spark.createDataFrame([(i, f"r{i}") for i in range(30)], "slot long, route string")
    manifest = spark.createDataFrame([(0, 7), (1, 3)], "position int, slot long")
    assert [r["route"] for r in R.subset(records, manifest).orderBy("position").collect()] == ["r7", "r3"]
    for bad in ([(0, 7), (1, 7)], [(0, 99)]):
        with pytest.raises(ValueError):
            R.subset(records, spark.createDataFrame(bad, "position int, slot long"))
    s = R.round_split(records, "slot", 0.35, "x")
    assert s.where("is_train").count() == 10 and s.count() == 30
    assert {r["slot"] for r in R.by_order(records, "slot", 0.4).where("is_train").collect()} == set(range(12))
    train, test = records.where("slot < 12"), records.where("slot >= 12")
    parts = R.attack_split(train, test, "slot", 5, "a")
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"member": 5, "nonmember": 5, "reference": 13}
    assert parts.select("slot").distinct().count() == 23
    with pytest.raises(ValueError):
        R.attack_split(train, records, "slot", 5, "a")


def test_four_encodings_of_routes(spark):
    edges = spark.createDataFrame([(10, 1, 2), (11, 2, 3)], "edge_id int, u int, v int")
    want = {0: [(1, 2), (2, 3)], 1: []}
    a = spark.createDataFrame([(0, [1, 2, 3]), (1, [])], "slot int, node_sequence array<int>")
    b = spark.createDataFrame([(0, [10, 11], True), (1, [10], False)], "slot int, cpath array<int>, accepted boolean")
    c = spark.createDataFrame([(0, [10, 11]), (1, [])], "slot int, edge_ids array<int>")
    d = spark.createDataFrame([(0, [[1, 2], [2, 3]]), (1, None)], "slot int, pairs array<array<int>>")
    for r in (a, b, c, d):
        assert {x["slot"]: [(e["u"], e["v"]) for e in x["edges"]] for x in S.routes(r, edges).collect()} == want


def test_ledger_spends_once(tmp_path):
    book = L.Ledger(str(tmp_path / "l.db"))
    book.reserve("city", "r1", Fraction(1, 2))
    with pytest.raises(ValueError):
        book.reserve("city", "r2", Fraction(1, 3))
    book.reserve("other", "r2", Fraction(1, 3))
    assert book.total() == Fraction(5, 6)
    f = tmp_path / "out.bin"
    f.write_bytes(b"x")
    book.seal("city", [str(f)])
    assert book.verify("city", [str(f)]) and not book.verify("other", [str(f)])
    f.write_bytes(b"y")
    assert not L.Ledger(str(tmp_path / "l.db")).verify("city", [str(f)])
    with pytest.raises(ValueError):
        book.seal("city", [str(f)])
    assert L.chained("", {"a": 1}) != L.chained("z", {"a": 1})


def test_clusters_axes_and_designs(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (40, 3)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    centers = C.lloyd(df, x[[0, 50, 100]], 5)
    got = sorted((r["cluster"], r["n"], r["inertia"]) for r in C.summary(df, centers).collect())
    assert [n for _, n, _ in got] == [40, 40, 40]
    assert sum(i for _, _, i in got) == pytest.approx(sum(((x[k * 40 : k * 40 + 40] - x[k * 40 : k * 40 + 40].mean(axis=0)) ** 2).sum() for k in range(3)))
    values, axes = C.principal(df)
    assert values == pytest.approx(np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x))
    a, taken = rng.normal(size=(8, 3)), []
    for row, gain in C.greedy_logdet(a, 4):
        det = lambda rows: np.linalg.slogdet(np.eye(3) + a[rows].T @ a[rows])[1]
        assert gain == pytest.approx(det([*taken, row]) - det(taken)) and gain == pytest.approx(max(det([*taken, k]) - det(taken) for k in range(8) if k not in taken))
        taken.append(row)


def test_effective_resistance():
    # two resistors of 1 and 2 in a row, and two of 3 and 6 side by side
    assert G.effective_resistance(np.array([0, 1]), np.array([1, 2]), np.array([1, 0.5])) == pytest.approx([1, 2])
    assert G.effective_resistance(np.array([0, 0]), np.array([1, 1]), np.array([1 / 3, 1 / 6])) == pytest.approx([2, 2])


def test_diverse_portals(spark):
    rows = [(0, 1, u, u + 100, w, float(x), 0.0) for u, w, x in ((1, 5, 0), (2, 9, 3), (3, 1, 10), (4, 2, -6), (5, 1, 10))]
    got = G.diverse_portals(spark.createDataFrame(rows, "ru int, rv int, u int, v int, weight int, x double, y double"), 3).orderBy("nth").collect()
    assert [r["u"] for r in got] == [2, 4, 3]


def test_command_line(spark, tmp_path, capsys):
    from wayfare.__main__ import main

    assert main(["list", "jsd_"]) == 0 and capsys.readouterr().out.split() == [f"jsd_{k}" for k in "abcdefgh"]
    assert main(["sql", "fil_bbox"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "corridors_*", "--data", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out/corridors_3").count() == 1
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "--data", "x", "--out", "y"])
