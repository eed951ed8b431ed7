"""Bridges, walks, transport and the ledger against plain versions."""

import itertools
import random

import numpy as np
import pytest

from wayfare.operators import graph as G
from wayfare.operators import transport as T


def test_common_mass_by_all_subsequences():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 8))] for _ in "ab")
        w = {k: rng.choice((0.5, 1.0, 2.5)) for k in range(4)}

        def within(x, y):
            it = iter(y)
            return all(c in it for c in x)

        subs = [s for n in range(len(a) + 1) for s in itertools.combinations(a, n) if within(s, b)]
        assert T.common_mass(a, b) == max(map(len, subs))
        assert T.common_mass(a, b, w) == pytest.approx(max(sum(w[x] for x in s) for s in subs))


def test_transport_by_all_assignments():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randrange(1, 6)
        gain = np.array([[rng.randrange(9) for _ in range(n)] for _ in range(n)], float)
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert T.transport([1] * n, [1] * n, gain) == best
    # masses: units of one row split as the demand asks
    assert T.transport([3, 1], [2, 2], np.array([[5.0, 1.0], [0.0, 4.0]])) == 5 * 2 + 1 + 4


def test_killed_bridge_gives_the_conditioned_law():
    """Against all walks of up to twelve moves, by their probabilities."""
    k = np.array([[0, 0.6, 0.4, 0], [0.3, 0, 0, 0.7], [0.5, 0, 0, 0.5], [0, 0.5, 0.5, 0]])
    for beta in (0.0, 0.7):
        law = G.killed_bridge(k, 3, beta)
        first, moves, total = np.zeros(4), 0.0, 0.0
        front = [((0,), 1.0)]
        for n in range(1, 26):
            ahead = []
            for path, p in front:
                for y in range(4):
                    q = p * k[path[-1], y] * np.exp(-beta)
                    if q <= 1e-9:
                        continue
                    if y == 3:
                        nxt = (*path, y)[1]
                        first[nxt] += q
                        moves, total = moves + q * n, total + q
                    else:
                        ahead.append(((path + (y,))[:2] + (y,), q))
            front = ahead
        assert law[0] == pytest.approx(first / total, abs=1e-3)
        assert G.expected_moves(law, 0, 3) == pytest.approx(moves / total, abs=1e-2)


def test_walks_reach_their_ends(spark):
    from wayfare.plans import blocks, synthesis

    near = blocks.adjacency()
    rows = synthesis.walks(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(v in near[u] for r in rows for u, v in itertools.pairwise(r["regions"]))
    again = synthesis.walks(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    for r in synthesis.bridges(spark, "/root/testdata/sf0.001").collect():
        assert r["beta"] in synthesis.BETAS and r["moves"] >= sum(abs(a - b) for a, b in zip(divmod(r["o"], 4), divmod(r["d"], 4), strict=True))


def test_draws_follow_their_law(spark):
    from pyspark.sql import functions as F

    from wayfare.plans import synthesis

    law = spark.createDataFrame([(0, 10), (1, 30), (2, 60)], "cell int, n long")
    got = {r["cell"]: r["n"] for r in synthesis._drawn(law, spark.range(20000).withColumnRenamed("id", "slot"), "s").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k: v / 20000 for k, v in got.items()} == pytest.approx({0: 0.1, 1: 0.3, 2: 0.6}, abs=0.012)


def test_lifted_walks_are_road_paths(spark):
    from wayfare.plans import roads, synthesis

    sf = "/root/testdata/sf0.001"
    net = {(r["u"], r["v"]) for r in roads.roads(spark, sf).collect()}
    rows = synthesis.lifted(spark, sf).collect()
    kinds = {r["kind"] for r in rows}
    assert rows and kinds <= {"restricted", "fallback", "none"} and "restricted" in kinds
    for r in rows:
        assert (r["path"] is None) == (r["kind"] == "none")
        assert all(e in net for e in itertools.pairwise(r["path"] or []))
