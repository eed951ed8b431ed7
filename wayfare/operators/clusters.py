"""Partitions and axes of vectors by sums that partitions add up, and greedy designs of small candidate sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers**2).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def lloyd(vectors: DataFrame, centers: np.ndarray, rounds: int, column: str = "embedding") -> np.ndarray:
    """Centers after some rounds of k-means; a round returns one sum a center and partition, and an empty center stays."""
    for _ in range(rounds):
        now = centers

        def sums(batches, now=now):
            total, count = np.zeros_like(now), np.zeros(len(now))
            for p in batches:
                if len(p):
                    x = np.array(p[column].tolist(), float)
                    at, _ = _nearest(x, now)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(now))
            yield pd.DataFrame({"k": np.arange(len(now)), "n": count, "total": list(total)})

        got = vectors.select(column).mapInPandas(sums, "k int, n double, total array<double>").collect()  # partitions x centers rows
        total, count = np.zeros_like(now), np.zeros(len(now))
        for r in sorted(got, key=lambda r: (r["k"], r["n"], r["total"])):
            total[r["k"]] += r["total"]
            count[r["k"]] += r["n"]
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], now)
    return centers


def summary(vectors: DataFrame, centers: np.ndarray, column: str = "embedding") -> DataFrame:
    """(cluster, n, inertia) of the vectors by their nearest center."""

    def parts(batches):
        for p in batches:
            if len(p):
                at, d = _nearest(np.array(p[column].tolist(), float), centers)
                yield pd.DataFrame({"cluster": at.astype(np.int32), "d": d})

    return vectors.select(column).mapInPandas(parts, "cluster int, d double").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("inertia"))


def principal(vectors: DataFrame, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Variances along the principal axes, largest first, and the axes as rows; the driver gets sums of squares of the dimensions only."""

    def sums(batches):
        n, s, q = 0, None, None
        for p in batches:
            if len(p):
                x = np.array(p[column].tolist(), float)
                n, s, q = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    rows = vectors.select(column).mapInPandas(sums, "n long, s array<double>, q array<double>").collect()
    n = sum(r["n"] for r in rows)
    mean = sum(np.array(r["s"]) for r in rows) / n
    cov = sum(np.array(r["q"]).reshape(len(mean), -1) for r in rows) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    return np.maximum(values[::-1], 0), axes[:, ::-1].T


def greedy_logdet(x: np.ndarray, k: int) -> list[tuple[int, float]]:
    """Rows chosen one by one for the largest gain in log det(I + sum of x x'), with the gains; the smaller row on ties."""
    inverse, left, out = np.eye(x.shape[1]), list(range(len(x))), []
    while left and len(out) < k:
        gain = np.log1p(np.einsum("ij,jk,ik->i", x[left], inverse, x[left]))
        best = int(np.round(gain, 12).argmax())
        row = left.pop(best)
        v = inverse @ x[row]
        inverse = inverse - np.outer(v, v) / (1 + x[row] @ v)
        out.append((row, float(gain[best])))
    return out
