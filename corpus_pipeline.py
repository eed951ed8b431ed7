"""A corpus pipeline over the documents table: language, near duplicates, private values, mixture, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import crf, jaccard_join, mixing, piece_fst, pseudonyms
from wayfare.llm.common import cut, table
from wayfare.llm.pseudonyms import pseudonym_key

#: Mean marginal below which a text is of no language.
LEAST_SCORE = 0.5
#: Shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
#: Entries of the last stage's tables in a worker, which the other stages' tasks share.
TABLE = 80_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of which no language is certain. The model is fitted on the stage's own input.

    Repeated rows are judged alike. Without a labelled row, and in an empty table, nothing stays.
    """
    own = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    names = [f"_c{i}" for i in range(len(docs.columns))]  # so that no column meets those of the prediction
    bare = own.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    judged = crf.predict(bare, crf.fit(crf.sample(own)), tuple(names))
    kept = judged.where((F.col("lang_pred") != crf.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents, that with the smallest id; documents without words stay.

    Copies are rows, so different texts of one id are judged each by its own, and of repeated rows one stays.
    """
    return jaccard_join.firsts(docs, WORDS, PERCENT)


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to pseudonyms; every row stays, null texts stay null."""
    done = pseudonyms.pseudonymise(docs, pseudonym_key(spark), count="_values")
    return done.withColumn("n_chars", F.when(F.col("_values") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or repeated. Documents without words are not taken."""
    names = [c if c in ("doc_id", "source", "text") else f"_c{i}" for i, c in enumerate(docs.columns)]
    mixed = mixing.mix(docs.toDF(*names)).where("copies > 0")
    copies = mixed.withColumn("_nth", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return copies.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, round_trip, ids) of every row, repeated ones too; null text has no pieces."""
    own = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return piece_fst.encode(own.select("doc_id", "source", "text"), keep=("doc_id", "source"), kept=TABLE, pairs=TABLE)


STAGES = [("language", language), ("near_copies", near_copies), ("private_values", private_values), ("mixture", mixture), ("pieces", pieces)]

#: Neither the model nor the pieces can be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
