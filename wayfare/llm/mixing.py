"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / size copies. Its documents are put in an order, their
expected copies are summed up along it, one offset from [0, 1) is added, and a document is taken once for
each integer that its stretch of the sum crosses. The order goes by size, so that each stretch of it is
like the others and the taken words come near the target: their difference is below the size of a
source's largest document or so. There is one random offset a source, drawn from the seed, so that every
document is taken as often as it shall be, on the mean over seeds.

The sums need no global sort: rows are counted by (source, band of sizes), a band is salted into cells of
bounded size, the counts of the cells give each its start, and only inside a cell are rows numbered.

Null text has 0 words. A null source is a source of its own, last. A source without words has target 0.
Ties go by a hash of id and text, then by one of all columns, so a rerun takes the same rows even where ids
or rows repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hashed, partitions

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken this many times at most.
MOST = 3
#: A band is salted into cells of about 1 / (SPREAD * partitions) of the rows, and LEAST rows at least.
SPREAD, LEAST = 16, 256
#: Cells up to which they are broadcast; above, they are joined by a shuffle, with the same result.
FEW = 100_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words that the mix shall have of each source: all words shared by weight, a share above most * size cut there and the rest shared anew."""
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, free = float(sum(n for _, n in order)), list(size)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * size[s]]
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
            free.remove(s)
    return out


def offset(source: str | None, seed: str) -> float:
    return int.from_bytes(hashlib.sha256(f"{seed}|0|{'-' if source is None else '+' + source}".encode()).digest()[:6], "big") / 2**48


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """All columns of docs with size, source_size, target and copies (0 to ceil(most)) of each row.

    One row of (source, size, target, offset) a source reaches the driver; the number of sources is taken
    to be small. Input columns of the same names give way to the four.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "copies"]
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    text, source, doc = (F.col(names[c]) for c in ("text", "source", "doc_id"))
    plain = [names[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = own.withColumns({"source": source, "size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "tie": hashed(F.lit(seed), doc.cast("string"), text)})
    rows = rows.withColumns({"last": F.xxhash64(*plain), "band": F.floor(F.log2(F.col("size") + 1) * 8).cast("int")})
    slim = cut(rows.select("source", "band", "size", "tie"))
    bands = cut(slim.groupBy("source", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))  # some hundred rows a source
    sums = bands.groupBy("source").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).collect()
    goal = targets([(r["source"], r["words"]) for r in sums], weights, most)
    per = max(LEAST, sum(r["n"] for r in sums) // (SPREAD * partitions(spark)))
    salts = bands.select(F.col("source").alias("s_source"), F.col("band").alias("s_band"), F.ceil(F.col("n") / per).cast("int").alias("salts"))
    few = F.broadcast if bands.count() <= FEW else (lambda df: df)

    def celled(df: DataFrame) -> DataFrame:
        df = df.join(few(salts), df["source"].eqNullSafe(F.col("s_source")) & (df["band"] == F.col("s_band"))).drop("s_source", "s_band")
        return df.withColumn("salt", F.pmod("tie", "salts").cast("int"))

    key = ["source", "band", "salt"]
    before = Window.partitionBy("source").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled(slim).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))  # of a source at most SPREAD * partitions and its bands
    cells = cut(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))).select(*(F.col(c).alias(f"c_{c}") for c in key), "before")
    each = {r["source"]: goal[r["source"]] / r["words"] if r["words"] else 0.0 for r in sums}
    plan = spark.createDataFrame([(r["source"], r["words"], goal[r["source"]], each[r["source"]], offset(r["source"], seed)) for r in sums], "p_source string, source_size long, target double, each double, offset double")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("size", "tie", "last"))
    out = celled(rows).withColumn("inside", number).join(few(cells), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("band") == F.col("c_band")) & (F.col("salt") == F.col("c_salt")))
    out = out.join(few(plan), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("place", F.col("before") + F.col("inside"))
    copies = F.floor(F.col("place") * F.col("each") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("each") + F.col("offset"))
    out = out.withColumn("copies", copies.cast("long"))
    return out.select(*(F.col(names[c]).alias(c) for c in docs.columns if c not in new), *new)
