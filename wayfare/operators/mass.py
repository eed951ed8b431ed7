"""Comparing two corpora by the masses of shared keys.

Side 0 is the real corpus, side 1 the synthetic one. `pairs` brings both masses of a key together with one
partially aggregated shuffle; everything after it works on the table of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(df: DataFrame, keys: list[str], mass: str | Column | None = None) -> DataFrame:
    """keys, r (real mass), s (synthetic mass); a missing side is 0."""
    m = F.lit(1.0) if mass is None else (F.col(mass) if isinstance(mass, str) else mass)
    return df.groupBy(*keys).agg(F.sum(F.when(F.col("side") == 0, m).otherwise(0.0)).alias("r"), F.sum(F.when(F.col("side") == 1, m).otherwise(0.0)).alias("s"))


def with_totals(p: DataFrame) -> DataFrame:
    """Adds the totals tr and ts of all keys and the number of keys n_keys: one row, joined to each."""
    t = p.agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("tr"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("ts"), F.count(F.lit(1)).alias("n_keys"))
    return p.crossJoin(F.broadcast(t))  # one row


def pairs_by(df: DataFrame, keys: list[str], method: str = "method", real: str = "real") -> DataFrame:
    """method, keys, r, s: the real corpus against every other one of `method`, in one job. The methods are few, the keys are not."""
    n = df.groupBy(method, *keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    methods = df.where(F.col(method) != real).select(method).distinct()
    r = n.where(F.col(method) == real).drop(method).crossJoin(F.broadcast(methods)).select(method, *keys, F.col("n").alias("r"), F.lit(0.0).alias("s"))
    s = n.where(F.col(method) != real).select(method, *keys, F.lit(0.0).alias("r"), F.col("n").alias("s"))
    return r.union(s).groupBy(method, *keys).agg(F.sum("r").alias("r"), F.sum("s").alias("s"))


def scores_by(p: DataFrame, prefix: str, method: str = "method") -> DataFrame:
    """Overlap, divergence in bits, total variation and F1 of the support, a row a method."""
    t = p.groupBy(method).agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    q = p.join(F.broadcast(t), method)  # a row a method
    a, b = _div(F.col("r"), F.col("tr")), _div(F.col("s"), F.col("ts"))
    both, nr, ns = F.count_if((F.col("r") > 0) & (F.col("s") > 0)), F.count_if(F.col("r") > 0), F.count_if(F.col("s") > 0)
    return q.groupBy(method).agg(F.sum(F.least(a, b)).alias(f"{prefix}_cpc"), (F.sum(_plogm(a, b)) / F.ln(F.lit(2.0))).alias(f"{prefix}_jsd"), (F.sum(F.abs(a - b)) / 2).alias(f"{prefix}_tv"), (2 * both / F.greatest(nr + ns, F.lit(1))).alias(f"{prefix}_f1"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def below(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows of smaller `order`, which is unique, without a task that sees all rows.

    Rows are dealt into ranges of about equal counts; a range's own sums come from a window inside it, those before it
    from the totals of the ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)] or [0.5], 1000)).first()[0] or []))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    df = df.withColumn("_range", at)
    totals = df.groupBy("_range").agg(F.sum(value).alias("_sum"))
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(F.broadcast(totals), "_range").withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_range", "_before")


def cpc(p: DataFrame, name: str = "cpc") -> DataFrame:
    """Common part: sum of the smaller share; 0 if a side is empty."""
    q = with_totals(p)
    return q.agg(F.coalesce(F.sum(F.least(_div(F.col("r"), F.col("tr")), _div(F.col("s"), F.col("ts")))), F.lit(0.0)).alias(name))


def total_variation(p: DataFrame, name: str = "tv") -> DataFrame:
    q = with_totals(p)
    return q.agg((F.sum(F.abs(_div(F.col("r"), F.col("tr")) - _div(F.col("s"), F.col("ts")))) / 2).alias(name))


def _plogm(a: Column, b: Column) -> Column:
    """a ln(a / m) + b ln(b / m) with m the mean, halves taken later; 0 ln 0 is 0."""
    m = (a + b) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return (term(a) + term(b)) / 2


def jsd(p: DataFrame, kind: str, domain: int | None = None, name: str = "jsd") -> DataFrame:
    """The Jensen-Shannon variants; they share a name and differ in logarithm, root, smoothing and empty sides.

    A  log2 divergence, 1e-12 added to every cell of a domain of `domain` cells
    B  natural distance (root); an empty side gives 1
    C  natural divergence; an empty side gives null
    D  log2 divergence; an empty side gives 1, two empty ones 0
    E  natural distance, totals at least 1
    F  log2 divergence, negative masses cut to 0, an empty side is uniform
    G  log2 divergence, totals at least 1e-15
    H  log2 divergence; an empty side gives null
    """
    ln2 = F.ln(F.lit(2.0))
    if kind == "F":
        p = p.withColumns({c: F.greatest(F.col(c), F.lit(0.0)) for c in ("r", "s")})
    q = with_totals(p)
    r, s, tr, ts, k = (F.col(c) for c in ("r", "s", "tr", "ts", "n_keys"))
    if kind == "A":
        eps = 1e-12
        a, b = tr + domain * eps, ts + domain * eps
        total = F.sum(_plogm((r + eps) / a, (s + eps) / b)) + F.max((domain - k) * _plogm(eps / a, eps / b))
        return q.agg((total / ln2).alias(name))
    if kind == "E":
        tr, ts = F.greatest(tr, F.lit(1.0)), F.greatest(ts, F.lit(1.0))
    if kind == "G":
        tr, ts = F.greatest(tr, F.lit(1e-15)), F.greatest(ts, F.lit(1e-15))
    share = (lambda x, t: F.when(t > 0, x / t).otherwise(1 / k)) if kind == "F" else _div
    value = F.sum(_plogm(share(r, tr), share(s, ts)))
    if kind in "DFGH":
        value = value / ln2
    if kind in "BE":
        value = F.sqrt(F.greatest(value, F.lit(0.0)))
    empty = (F.max("tr") <= 0) | (F.max("ts") <= 0)
    if kind == "B":
        value = F.when(empty, 1.0).otherwise(value)
    if kind == "D":
        value = F.when(F.count(F.lit(1)) == 0, 0.0).when(empty, 1.0).otherwise(value)
    if kind in "CH":
        value = F.when(empty, F.lit(None)).otherwise(value)
    return q.agg(value.alias(name))


def support(p: DataFrame) -> DataFrame:
    """recall, precision and F1 of the keys with mass; an empty real side has recall 1."""
    c = p.agg(F.count_if((F.col("r") > 0) & (F.col("s") > 0)).alias("both"), F.count_if(F.col("r") > 0).alias("nr"), F.count_if(F.col("s") > 0).alias("ns"))
    c = c.select(F.when(F.col("nr") > 0, F.col("both") / F.col("nr")).otherwise(1.0).alias("recall"), F.when(F.col("ns") > 0, F.col("both") / F.col("ns")).otherwise(0.0).alias("precision"))
    return c.select("recall", "precision", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0).alias("f1"))


def wape(p: DataFrame, calibrate: bool = False, name: str = "wape") -> DataFrame:
    """Sum of absolute differences over the real mass; calibrate scales the synthetic volume to the real one first."""
    q = with_totals(p)
    scale = F.col("tr") / F.col("ts") if calibrate else F.lit(1.0)
    return q.agg((F.sum(F.abs(F.col("s") * scale - F.col("r"))) / F.max("tr")).alias(name))


def iou(value: Column) -> Column:
    return value / (2 - value)


def smape(p: DataFrame, floor: float = 1.0) -> DataFrame:
    """Mean |s - r| / max(s + r, floor), and mean |s - r| / r over keys with r at least 5."""
    d = F.abs(F.col("s") - F.col("r"))
    return p.agg(F.avg(d / F.greatest(F.col("s") + F.col("r"), F.lit(floor))).alias("smape"), F.avg(F.when(F.col("r") >= 5, d / F.col("r"))).alias("are"))


def entropy(p: DataFrame) -> DataFrame:
    """Entropy of both sides, and the cross entropy of the synthetic side under the real one, smoothed by 1e-12."""
    q = with_totals(p)
    a, b = _div(F.col("r"), F.col("tr")), _div(F.col("s"), F.col("ts"))
    h = lambda x: F.sum(F.when(x > 0, -x * F.ln(x)).otherwise(0.0))
    return q.agg(h(a).alias("entropy_real"), h(b).alias("entropy_syn"), F.sum(-a * F.ln(b + 1e-12)).alias("cross_entropy"), F.sum((a - b) ** 2).alias("brier"))


def top_mass(p: DataFrame, keys: list[str], share: float = 0.8) -> DataFrame:
    """Recall of the synthetic support on the real keys that come first by mass until `share` of it is reached."""
    # the table of keys is bounded by the grid, so one ordered window is
    w = Window.orderBy(F.desc("r"), *keys).rowsBetween(Window.unboundedPreceding, -1)
    hot = with_totals(p).withColumn("before", F.coalesce(F.sum("r").over(w), F.lit(0.0))).where((F.col("r") > 0) & (F.col("before") < share * F.col("tr")))
    return hot.agg(F.count(F.lit(1)).alias("hot"), F.avg(F.when(F.col("s") > 0, 1.0).otherwise(0.0)).alias("recall"))


def ranked(p: DataFrame, keys: list[str], column: str, k: int, name: str) -> DataFrame:
    """The k keys of largest mass with their rank, smaller keys first on ties."""
    return p.orderBy(F.desc(column), *keys).limit(k).withColumn(name, F.row_number().over(Window.orderBy(F.desc(column), *keys)))


def ndcg(p: DataFrame, keys: list[str], k: int = 20, name: str = "ndcg") -> DataFrame:
    """Linear-gain NDCG at k of the synthetic order on the real masses, ties by key."""
    got = ranked(p, keys, "s", k, "n").agg(F.sum(F.col("r") / F.log2(F.col("n") + 1.0)).alias("dcg"))
    best = ranked(p, keys, "r", k, "n").agg(F.sum(F.col("r") / F.log2(F.col("n") + 1.0)).alias("ideal"))
    return got.crossJoin(F.broadcast(best)).select(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias(name))


def spearman(p: DataFrame, domain: int, name: str = "spearman") -> DataFrame:
    """Rank correlation with mean ranks over a dense domain: the cells that no key names share the lowest rank.

    The ranks come from counts of equal masses, so that the dense cells need no rows.
    """
    def ranks(column: str) -> DataFrame:
        by = p.where(F.col(column) > 0).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        present = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("present"))
        zero = domain - F.col("present")
        by = below(by, "value", "n", "less").crossJoin(F.broadcast(present)).select("value", (zero + F.col("less") + (F.col("n") + 1) / 2).alias("rank"))
        return by, present.select(((domain - F.col("present") + 1) / 2).alias("rank0"))

    a, a0 = ranks("r")
    b, b0 = ranks("s")
    q = p.crossJoin(F.broadcast(a0.withColumnRenamed("rank0", "a0"))).crossJoin(F.broadcast(b0.withColumnRenamed("rank0", "b0")))
    q = q.join(a.withColumnsRenamed({"value": "r", "rank": "ra"}), "r", "left").join(b.withColumnsRenamed({"value": "s", "rank": "rb"}), "s", "left")
    x, y, mean = F.coalesce("ra", "a0"), F.coalesce("rb", "b0"), (domain + 1) / 2
    rest = domain - F.count(F.lit(1))
    da, db = F.max("a0") - mean, F.max("b0") - mean
    sxy, sxx, syy = (F.sum((u - mean) * (v - mean)) + rest * du * dv for u, v, du, dv in ((x, y, da, db), (x, x, da, da), (y, y, db, db)))
    return q.agg(F.coalesce(sxy / F.sqrt(sxx * syy), F.lit(0.0)).alias(name))
