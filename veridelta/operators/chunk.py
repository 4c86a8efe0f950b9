"""Blocks to chunks at section, paragraph or sentence granularity.

Blocks: doc_id, block_ord, page, text, is_heading.  Chunks: doc_id, granularity, index (0-based
and dense), text, page, section, weight.  A document is the unit of order, so every window
partitions by doc_id alone and all of them share one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions import text as X

GRANULARITIES = ("section", "paragraph", "sentence")


def _headed(blocks: DataFrame) -> DataFrame:
    """The last heading at or before each block, else ""."""
    w = Window.partitionBy("doc_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    running = F.coalesce(F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w), F.lit(""))
    return blocks.withColumn("heading", running)


def _numbered(chunks: DataFrame, granularity: str, *order: str) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return chunks.select("doc_id", F.lit(granularity).alias("granularity"), index.cast("int").alias("index"), "text", "page", "section", X.word_weight("text").alias("weight"))


def paragraphs(blocks: DataFrame) -> DataFrame:
    return _numbered(_headed(blocks).withColumn("section", X.section_label("text", F.col("heading"))), "paragraph", "block_ord")


def sentences(blocks: DataFrame, respect_abbreviations: bool = False) -> DataFrame:
    labelled = _headed(blocks).withColumn("section", X.section_label("text", F.col("heading")))
    parts = labelled.select("doc_id", "block_ord", "page", "section", F.posexplode(X.sentences("text", respect_abbreviations)).alias("pos", "text"))
    return _numbered(parts, "sentence", "block_ord", "pos")


def sections(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, 0)
    grouped = blocks.withColumn("group", F.sum(F.col("is_heading").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("block_ord", "text", "page", "is_heading")))
    joined = grouped.groupBy("doc_id", "group").agg(parts.alias("parts"))
    first = F.element_at("parts", 1)
    label = F.when(first["is_heading"], first["text"]).otherwise(X.section_label(first["text"], F.lit("")))
    rows = joined.select("doc_id", "group", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"), first["page"].alias("page"), label.alias("section"))
    return _numbered(rows, "section", "group")


def chunk(blocks: DataFrame, granularity: str, max_chunks: int | None = None, respect_abbreviations: bool = False) -> DataFrame:
    """Chunks of every document; max_chunks keeps the first so many of each."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity: {granularity!r}")
    if max_chunks is not None and max_chunks < 1:
        raise ValueError("max_chunks must be at least 1")
    rows = {"section": sections, "paragraph": paragraphs}[granularity](blocks) if granularity != "sentence" else sentences(blocks, respect_abbreviations)
    return rows if max_chunks is None else rows.where(F.col("index") < max_chunks)


def chunk_all(blocks: DataFrame, granularities: tuple[str, ...] = GRANULARITIES, max_chunks: int | None = None) -> DataFrame:
    """K7: each granularity from the same blocks."""
    out = None
    for g in granularities:
        one = chunk(blocks, g, max_chunks)
        out = one if out is None else out.unionByName(one)
    return out
