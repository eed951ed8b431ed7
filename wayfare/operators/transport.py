"""Matching route corpora: common subsequences by weight, and exact optimal transport of small strata."""

from __future__ import annotations

import numpy as np
import pandas as pd


def common_mass(left: list[int], right: list[int], weights: dict[int, float] | None = None) -> float:
    """Largest total weight of a common subsequence; every token weighs 1 without weights. One row of the table is kept."""
    best = np.zeros(len(right) + 1)
    tokens = np.asarray(right)
    for x in left:
        w = 1.0 if weights is None else weights.get(x, 0.0)
        take = np.where(tokens == x, best[:-1] + w, 0.0)
        best[1:] = np.maximum(best[1:], np.maximum.accumulate(take))
    return float(best[-1])


def transport(supply: list[int], demand: list[int], gain: np.ndarray) -> float:
    """Largest total gain of moving whole units of `supply` to `demand` (equal sums): successive shortest paths.

    Each round sends along the path of most gain from a source with units left to a sink with room, over forward arcs
    and flow that may be taken back.
    """
    n, m = gain.shape
    left, room, flow = list(supply), list(demand), np.zeros((n, m), np.int64)
    while any(left):
        # costs of the nodes by Bellman and Ford: sources 0..n-1, sinks n..n+m-1
        dist = np.full(n + m, np.inf)
        dist[:n][np.array(left) > 0] = 0.0
        before = np.full(n + m, -1)
        for _ in range(n + m):
            ahead = dist[:n, None] - gain
            i = ahead.argmin(axis=0)
            best = ahead[i, np.arange(m)]
            better = best < dist[n:] - 1e-12
            dist[n:][better], before[n:][better] = best[better], i[better]
            back = np.where(flow > 0, dist[None, n:] + gain, np.inf)
            j = back.argmin(axis=1)
            best = back[np.arange(n), j]
            again = best < dist[:n] - 1e-12
            dist[:n][again], before[:n][again] = best[again], n + j[again]
            if not better.any() and not again.any():
                break
        end = n + min((k for k in range(m) if room[k] > 0), key=lambda k: (dist[n + k], k))
        path = [end]
        while before[path[-1]] >= 0:
            path.append(int(before[path[-1]]))
        path.reverse()
        arcs = list(zip(path, path[1:], strict=False))
        most = min(left[path[0]], room[end - n], *(flow[v, u - n] for u, v in arcs if u >= n))
        for u, v in arcs:
            if u < n:
                flow[u, v - n] += most
            else:
                flow[v, u - n] -= most
        left[path[0]] -= most
        room[end - n] -= most
    return float((flow * gain).sum())


MATCHED = "o long, d long, real_all long, syn_all long, real double, syn double, matched double"


def matched_stratum(p: pd.DataFrame) -> pd.DataFrame:
    """One stratum: mean edges of a real and of a synthetic route, and the mean number that the best transport between them matches."""
    sides = [p[p["side"] == k] for k in (0, 1)]
    seqs, masses = [], []
    for s in sides:
        count: dict[tuple, int] = {}
        for route in s["route"]:
            count[tuple(route)] = count.get(tuple(route), 0) + 1
        seqs.append(sorted(count))
        masses.append([count[k] for k in sorted(count)])
    mean = [sum(c * len(x) for c, x in zip(m, q, strict=True)) / max(1, sum(m)) for m, q in zip(masses, seqs, strict=True)]
    matched = 0.0
    if seqs[0] and seqs[1]:
        gain = np.array([[common_mass(list(a), list(b)) for b in seqs[1]] for a in seqs[0]])
        a, b = sum(masses[0]), sum(masses[1])
        matched = transport([c * b for c in masses[0]], [c * a for c in masses[1]], gain) / (a * b)
    alls = [int(s["all"].iloc[0]) if len(s) else 0 for s in sides]
    return pd.DataFrame([(p["o"].iloc[0], p["d"].iloc[0], *alls, *mean, matched)], columns=[c.split()[0] for c in MATCHED.split(", ")])
