"""The registered queries opN_<name>: thin digests of the operators over whole tables."""

from __future__ import annotations

__all__ = ["ORACLES", "QUERIES"]

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, katz, licences, mixture, nn_descent, pii, substring_dedup, toxicity, warc
from .blocks import stored
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null: of the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 13, digest=True)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal target weights for all sources, as many rows as there are documents."""
    mixed = mixture.mix(table(spark, sf_dir, "documents"), seed=7)
    return mixed.select("doc_id", "lang", "source", "n_chars", "text", "copies", "copy", "order_key")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = katz.katz_scores(table(spark, sf_dir, "documents"), remainder(7) != 2, order=3)
    return scores.withColumn("score_per_token", F.col("score") / F.col("n_tokens"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents")).select("doc_id", "pii_base", "pii_weak")
    found = stored(found, "pii")  # the patterns run once, for training and result
    return pii.digest(found, pii.train(pii.patterns(found)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    return decontaminate.digest(decontaminate.find(index, table(spark, sf_dir, "benchmark"), n=10))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mixture": op3_mixture,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_katz": op5_katz,
    "op6_toxicity": op6_toxicity,
    "op7_licences": op7_licences,
    "op8_nn_descent": op8_nn_descent,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
}
