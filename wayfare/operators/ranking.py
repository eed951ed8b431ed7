"""Back-off prediction, top-k lists and their scores. Ties go to the smaller key everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mass import below


def triples(runs: DataFrame, value: str = "cell") -> DataFrame:
    """(trip, seq, a, b, c, ...) of neighbouring values."""
    w = Window.partitionBy("trip").orderBy("seq")
    t = runs.withColumns({"a": F.col(value), "b": F.lead(value, 1).over(w), "c": F.lead(value, 2).over(w)})
    return t.where("c IS NOT NULL")


def top_list(counts: DataFrame, context: list[str], item: str, k: int) -> DataFrame:
    """Adds the rank of each item within its context by count, the context's total, and keeps all items."""
    w = Window.partitionBy(*context).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*context)))


def backoff(train: DataFrame, cases: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """cases (a, b, c) with the rank, count and total of c in the list of (a, b), or of b where (a, b) is unseen.

    Cases are counted first, so a frequent case is joined once. Columns: a, b, c, cases, covered, rank, n, total.
    by: columns of both that keep several corpora apart; they come first.
    """
    by = list(by)
    two = top_list(train.groupBy(*by, "a", "b", "c").agg(F.count(F.lit(1)).alias("n")), [*by, "a", "b"], "c", k)
    one = top_list(train.groupBy(*by, "b", "c").agg(F.count(F.lit(1)).alias("n")), [*by, "b"], "c", k)
    q = cases.groupBy(*by, "a", "b", "c").agg(F.count(F.lit(1)).alias("cases"))
    seen2 = two.groupBy(*by, "a", "b").agg(F.max("total").alias("total2"))
    seen1 = one.groupBy(*by, "b").agg(F.max("total").alias("total1"))
    q = q.join(seen2, [*by, "a", "b"], "left").join(seen1, [*by, "b"], "left")
    q = q.join(two.select(*by, "a", "b", "c", F.col("rank").alias("rank2"), F.col("n").alias("n2")), [*by, "a", "b", "c"], "left")
    q = q.join(one.select(*by, "b", "c", F.col("rank").alias("rank1"), F.col("n").alias("n1")), [*by, "b", "c"], "left")
    use2 = F.col("total2").isNotNull()
    return q.select(*by, "a", "b", "c", "cases", (use2 | F.col("total1").isNotNull()).alias("covered"), F.when(use2, F.col("rank2")).otherwise(F.col("rank1")).alias("rank"), F.coalesce(F.when(use2, F.col("n2")).otherwise(F.col("n1")), F.lit(0)).alias("n"), F.when(use2, F.col("total2")).otherwise(F.col("total1")).alias("total"))


def hit_scores(q: DataFrame, prefix: str, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage, hit at 1 and k, reciprocal rank (of covered cases), their number, and the negative log likelihood."""
    w, on = F.col("cases"), F.col("covered")
    per = F.greatest(F.sum(F.when(on, w).otherwise(0)), F.lit(1))
    s = lambda x: F.sum(F.when(on, w * x).otherwise(0.0)) / per
    good = F.col("rank") <= k
    return q.groupBy(*by).agg(
        (F.sum(F.when(on, w).otherwise(0)) / F.greatest(F.sum(w), F.lit(1))).alias(f"{prefix}_coverage"),
        s(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias(f"{prefix}_hit_at_1"),
        s(F.when(good, 1.0).otherwise(0.0)).alias(f"{prefix}_hit_at_{k}"),
        s(F.when(good, 1.0 / F.col("rank")).otherwise(0.0)).alias(f"{prefix}_mrr"),
        s(-F.ln((F.col("n") + 1e-12) / F.col("total"))).alias(f"{prefix}_nll"),
        F.sum(w).alias(f"{prefix}_query_count"),
    )


def corridors(runs: DataFrame, n: int, k: int, value: str = "cell") -> DataFrame:
    """Precision, recall and F1 of the k most frequent n-grams of the synthetic side (1), weighted by real counts."""
    w = Window.partitionBy("trip").orderBy("seq")
    g = runs.select("side", *(F.lead(value, i).over(w).alias(f"g{i}") for i in range(n))).where(f"g{n - 1} IS NOT NULL")
    keys = [f"g{i}" for i in range(n)]
    c = g.groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("s"))
    a = c.where("s > 0").orderBy(F.desc("s"), *keys).limit(k).select(*keys, "r", F.lit(1).alias("in_s"), F.lit(0).alias("in_r"))
    b = c.where("r > 0").orderBy(F.desc("r"), *keys).limit(k).select(*keys, "r", F.lit(0).alias("in_s"), F.lit(1).alias("in_r"))
    m = a.union(b).groupBy(*keys).agg(F.max("r").alias("r"), F.max("in_s").alias("in_s"), F.max("in_r").alias("in_r"))
    t = m.agg(F.sum(F.col("r") * F.col("in_s")).alias("ws"), F.sum(F.col("r") * F.col("in_r")).alias("wr"), F.sum(F.col("r") * F.col("in_s") * F.col("in_r")).alias("both"))
    t = t.select(F.when(F.col("ws") > 0, F.col("both") / F.col("ws")).otherwise(0.0).alias("p"), F.when(F.col("wr") > 0, F.col("both") / F.col("wr")).otherwise(0.0).alias("r"))
    return t.select("p", "r", (2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-12))).alias("f1"))


def expected_dcg(scored: DataFrame, context: list[str], relevance: str, score: str, name: str) -> DataFrame:
    """DCG of each context under a uniform order inside score ties: mean relevance of a tie times its discounts."""
    order = Window.partitionBy(*context).orderBy(F.desc(score))
    tie = Window.partitionBy(*context, score)
    d = scored.withColumn("_at", F.row_number().over(order)).withColumn("_mean", F.avg(relevance).over(tie))
    return d.groupBy(*context).agg(F.sum(F.col("_mean") / F.log2(F.col("_at") + 1.0)).alias(name))


def holm(df: DataFrame, p: str = "p", order: str = "name") -> DataFrame:
    """Step-down adjusted p values of a small table of tests."""
    w = Window.orderBy(p, order)
    r = df.withColumn("_rank", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
    raw = F.least(F.lit(1.0), (F.col("_m") - F.col("_rank") + 1) * F.col(p))
    return r.withColumn("adjusted", F.max(raw).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_rank", "_m")


def competition(df: DataFrame, group: str, value: str, name: str = "place") -> DataFrame:
    """1, 1, 3 places within each group, the largest value first."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(group).orderBy(F.desc(value))))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by counts of equal scores, ties worth one half; the sums below each score need no task that sees all scores."""
    by = df.groupBy(F.col(score).alias("_score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    by = below(by, "_score", "neg", "below")
    return by.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def balanced_at_median(df: DataFrame, score: str, label: str) -> DataFrame:
    """Balanced accuracy of calling positive what scores at least the median."""
    m = df.agg(F.percentile(score, F.lit(0.5)).alias("_median"))
    s, y = F.col(score), F.col(label)
    right = lambda is_one: F.sum(F.when((y == is_one) & ((s >= F.col("_median")) if is_one else (s < F.col("_median"))), 1.0).otherwise(0.0))
    return df.crossJoin(F.broadcast(m)).agg(((right(1) / F.sum(y) + right(0) / F.sum(1 - y)) / 2).alias("balanced"))


def tpr_at(df: DataFrame, score: str, label: str, share: float, name: str) -> DataFrame:
    """Share of positives at or above the score of the negative that stands at `share` of all negatives, from above."""
    w = Window.orderBy(F.desc(score))
    n = df.where(F.col(label) == 0)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    cut = n.select(F.col(score).alias("_s"), F.row_number().over(w).alias("i")).crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("n")))).where(F.col("i") == k).select(F.col("_s").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).agg(F.avg(F.when(F.col(label) == 1, F.when(F.col(score) >= F.col("_cut"), 1.0).otherwise(0.0))).alias(name))


def topk_accuracy(scored: DataFrame, case: list[str], item: str, truth: str, score: str, k: int, name: str) -> DataFrame:
    """Share of cases whose true item is among the k of highest score, smaller items first on ties."""
    w = Window.partitionBy(*case).orderBy(F.desc(score), item)
    hit = scored.withColumn("_i", F.row_number().over(w)).groupBy(*case).agg(F.max(F.when((F.col("_i") <= k) & (F.col(item) == F.col(truth)), 1.0).otherwise(0.0)).alias("_hit"))
    return hit.agg(F.avg("_hit").alias(name))
