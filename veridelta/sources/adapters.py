"""Blocks (doc_id, block_ord, page, text, is_heading) and pairs from tables of text, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_blocks(documents: DataFrame) -> DataFrame:
    """Each line with a character other than a space is a block on page 1."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_ord", "text"))
    return lines.where(F.trim("text") != "").select("doc_id", "block_ord", F.lit(1).alias("page"), "text", F.lit(False).alias("is_heading"))


#: elements that are blocks of a page
_BLOCK_TAGS = "h[1-6]|p|li|pre|blockquote|td|th"


def page_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items, quotations and cells of all articles, tags and entities of the five basic characters resolved."""
    article = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<article[^>]*>(.*?)</article>"), F.lit(1)), "\n")
    found = F.regexp_extract_all(article, F.lit(rf"(?s)<(?:{_BLOCK_TAGS})(?:\s[^>]*)?>.*?</(?:{_BLOCK_TAGS})>"), F.lit(0))
    parts = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("block_ord", "element"))
    text = F.regexp_replace("element", "<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return parts.select("doc_id", "block_ord", F.lit(1).alias("page"), text.alias("text"), F.col("element").rlike("^<h[1-6]").alias("is_heading"))


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """Each turn is a block."""
    return conversations.where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_ord"), F.lit(1).alias("page"), "text", F.lit(False).alias("is_heading"))


def first_line_pairs(documents: DataFrame) -> DataFrame:
    """Documents with an equal first line: the smallest id is A, each other is B; pair_id is B's id."""
    first = documents.select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("line"))
    least = first.groupBy("line").agg(F.min("doc_id").alias("doc_a"))
    return first.join(least, "line").where("doc_id <> doc_a").select(F.col("doc_id").alias("pair_id"), "doc_a", F.col("doc_id").alias("doc_b"))


def neighbour_pairs(ids: DataFrame, key: str) -> DataFrame:
    """Every id with the next number, where that exists; pair_id is the smaller."""
    own = ids.select(F.col(key).alias("doc_a")).distinct()
    return own.join(own.select((F.col("doc_a") - 1).alias("doc_a"), F.col("doc_a").alias("doc_b")), "doc_a").select(F.col("doc_a").alias("pair_id"), "doc_a", "doc_b")
