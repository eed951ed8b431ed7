"""Queries of the corpus operators over the documents and pages tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi_mjpeg, crf, html_main, jaccard_join, mixing, piece_fst, prefix_hash, pseudonyms, sharding, suffix_dedup
from .common import table
from .oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edited_likeness(table(spark, sf_dir, "documents"))


@query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_mjpeg.digest(table(spark, sf_dir, "documents"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = crf.predict(docs.select("doc_id", "text"), crf.fit(crf.sample(docs)))
    return out.select("doc_id", crf.held_out().alias("held_out"), "lang_pred", "score")


@query
def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonyms.pseudonym_key(spark))
    return out.select("doc_id", "text", "n_values")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return piece_fst.encode(docs).select("doc_id", "n_pieces", "round_trip", "ids")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents")).drop("kept")
