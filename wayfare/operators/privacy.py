"""Measuring a corpus under pure differential privacy.

Each trip gives unit mass to the atoms of a block; masses become whole numbers of a lattice, exactly, and are
summed as integers, so no sum depends on order. Noise is drawn on the driver only, once, after the sum:
a task that is run again must not draw anew. Budgets are fractions.
"""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of a budget by stage: ends of trips, their matrix, geometry of requests, numbers of points and
# lengths together, moves between regions, portals.
SHARES = {"endpoint": Fraction(8, 35), "od": Fraction(33, 140), "geometry": Fraction(4, 35), "point_length": Fraction(19, 140), "flow": Fraction(1, 7), "portal": Fraction(1, 7)}


def allocate(total: Fraction | str | int) -> dict[str, Fraction]:
    """The stages' parts of a budget; they add up to it exactly."""
    total = Fraction(total)
    if total <= 0:
        raise ValueError("a budget is positive")
    return {k: v * total for k, v in SHARES.items()}


def _odd_run(gamma: Fraction, rng: random.Random) -> bool:
    """True with probability exp(-gamma), gamma in [0, 1]: whether the first k at which a coin of gamma / k fails is odd (Canonne, Kamath and Steinke, The Discrete Gaussian for Differential Privacy, 2020, algorithm 1)."""
    k = 1
    while rng.randrange(gamma.denominator * k) < gamma.numerator:
        k += 1
    return k % 2 == 1


def bernoulli_exp(gamma: Fraction, rng: random.Random) -> bool:
    """True with probability exp(-gamma), gamma at least 0: exp(-1) as often as gamma is whole, then what is left."""
    whole, rest = divmod(gamma, 1)
    return all(_odd_run(Fraction(1), rng) for _ in range(whole)) and _odd_run(rest, rng)


def discrete_laplace(scale: Fraction, rng: random.Random | None = None) -> int:
    """A whole number z with probability in proportion to exp(-|z| / scale), exactly (algorithm 2 of the same paper)."""
    rng = rng or random.SystemRandom()
    s, t = scale.numerator, scale.denominator
    while True:
        u = rng.randrange(s)
        if not bernoulli_exp(Fraction(u, s), rng):
            continue
        v = 0
        while bernoulli_exp(Fraction(1), rng):
            v += 1
        value, negative = (u + s * v) // t, rng.randrange(2) == 1
        if not (negative and value == 0):
            return -value if negative else value


def release(totals: dict, sensitivity: int, epsilon: Fraction, rng: random.Random | None = None, bound: int = 10**15) -> dict:
    """Integer totals with discrete Laplace noise, clamped to +-bound. For the driver, on an aggregate of a public, bounded domain."""
    scale = Fraction(sensitivity) / Fraction(epsilon)
    return {k: max(-bound, min(bound, int(v) + discrete_laplace(scale, rng))) for k, v in totals.items()}


def quantised(counts: DataFrame, group: list[str], atom: list[str], budget: int) -> DataFrame:
    """Largest remainder: `n` of each atom becomes `units`, which sum to the budget in each group; ties to the smaller atom."""
    w = Window.partitionBy(*group)
    c = counts.withColumn("_t", F.sum("n").over(w))
    c = c.withColumns({"_q": F.expr(f"{budget}L * n div _t"), "_r": F.expr(f"({budget}L * n) % _t")})
    c = c.withColumns({"_left": F.lit(budget) - F.sum("_q").over(w), "_i": F.row_number().over(w.orderBy(F.desc("_r"), *atom))})
    return c.withColumn("units", F.col("_q") + F.when(F.col("_i") <= F.col("_left"), 1).otherwise(0)).drop("_t", "_q", "_r", "_left", "_i")


def simplex(df: DataFrame, value: str, total: float | Column, key: list[str], name: str = "projected") -> DataFrame:
    """Euclidean projection of a vector of a bounded domain onto the non-negative vectors of sum `total`."""
    w = Window.orderBy(F.desc(value), *key)
    t = F.lit(total) if not isinstance(total, Column) else total
    c = df.withColumns({"_n": F.row_number().over(w), "_c": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("_t", (F.col("_c") - t) / F.col("_n"))
    cut = c.where(F.col(value) > F.col("_t")).agg(F.max_by("_t", "_n").alias("_cut"))
    return c.crossJoin(F.broadcast(cut)).withColumn(name, F.greatest(F.col(value) - F.col("_cut"), F.lit(0.0))).drop("_n", "_c", "_t", "_cut")


def simplex_vector(x: np.ndarray, total: float) -> np.ndarray:
    """The same for an array on the driver."""
    order = np.sort(x)[::-1]
    cut = (np.cumsum(order) - total) / np.arange(1, len(x) + 1)
    return np.maximum(x - cut[order > cut][-1], 0)


def sinkhorn(matrix: np.ndarray, rows: np.ndarray, columns: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Alternating scaling of a non-negative matrix to both margins."""
    m = np.maximum(matrix, 1e-15).astype(float)
    for _ in range(rounds):
        m *= (rows / np.maximum(m.sum(axis=1), 1e-300))[:, None]
        m *= columns / np.maximum(m.sum(axis=0), 1e-300)
    return m


def expected_noise(scale: float) -> float:
    """Mean absolute value of the discrete Laplace law."""
    q = math.exp(-1 / scale)
    return 2 * q / (1 - q * q)
