"""K1-K7: judge band, classification and the length-weighted difference of each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.operators.judge import Judge
from veridelta.operators.match import GROUP, sides, unmatched

BAND = (0.5, 0.99)
THRESHOLD = 0.95
SIDE = ("index", "text", "page", "section", "weight")


def attach(pairs: DataFrame, chunks: DataFrame, matched: DataFrame) -> DataFrame:
    """Matched pairs with their chunks as structs a and b, and a_text, b_text for judges."""
    own = []
    for df, s, key in zip(sides(pairs, chunks), "ab", "ij", strict=True):
        own.append(df.select(*GROUP, F.col("index").alias(key), F.struct(*SIDE).alias(s)))
    return matched.join(own[0], [*GROUP, "i"]).join(own[1], [*GROUP, "j"]).withColumns({"a_text": F.col("a.text"), "b_text": F.col("b.text")})


def in_band(s: str, band: tuple[float, float]) -> F.Column:
    """K2: both ends count."""
    return F.col(s).between(*band)


def rescored(rows: DataFrame, judge: Judge | None, band: tuple[float, float] = BAND) -> DataFrame:
    """K2, K3: similarity, explanation and judged (sent to the judge) of matched rows.

    A verdict that failed (null or NaN) leaves the embedding's similarity and keeps its explanation.
    """
    plain = lambda df: df.withColumns({"similarity": F.col("s"), "explanation": F.lit(""), "judged": F.lit(False)})
    if judge is None:
        return plain(rows)
    asked = judge(rows.where(in_band("s", band)))
    failed = F.col("j_sim").isNull() | F.isnan("j_sim")
    asked = asked.withColumns({"similarity": F.when(failed, F.col("s")).otherwise(F.col("j_sim")), "explanation": F.coalesce("j_explanation", F.lit("")), "judged": F.lit(True)}).drop("j_sim", "j_explanation")
    return plain(rows.where(~in_band("s", band))).unionByName(asked)


def changes(pairs: DataFrame, chunks: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """K4: one row for each matched pair (same, changed) and each chunk without partner (deleted, added).

    input_ord orders rows as they come: pairs by A's position, then deleted, then added.
    """
    kind = F.when(F.col("similarity") >= threshold, "same").otherwise("changed")
    weight = (F.col("a.weight") + F.col("b.weight")) / 2
    both = scored.select(*GROUP, kind.alias("kind"), "similarity", weight.alias("weight"), "a", "b", "explanation", "judged", F.struct(F.lit(0).alias("k"), F.col("a.index").alias("n")).alias("input_ord"))
    deleted, added = unmatched(pairs, chunks, scored.select(*GROUP, "i", "j"))
    none = F.lit(None).cast(both.schema["a"].dataType)
    out = both
    for df, name, k in ((deleted, "deleted", 1), (added, "added", 2)):
        own = F.struct(*SIDE)
        a, b = (own, none) if k == 1 else (none, own)
        out = out.unionByName(df.select(*GROUP, F.lit(name).alias("kind"), F.lit(0.0).alias("similarity"), "weight", a.alias("a"), b.alias("b"), F.lit("").alias("explanation"), F.lit(False).alias("judged"), F.struct(F.lit(k).alias("k"), F.col("index").alias("n")).alias("input_ord")))
    return out


def summary(pairs: DataFrame, rows: DataFrame, granularities: tuple[str, ...]) -> DataFrame:
    """K5-K7: similarity_pct, difference_pct, n_a, n_b, judged_pairs of every (pair, granularity); documents without chunks are equal."""
    counted = rows.groupBy(*GROUP).agg(
        F.sum((1 - F.col("similarity")) * F.col("weight")).alias("num"),
        F.sum("weight").alias("den"),
        F.count("a").alias("n_a"),
        F.count("b").alias("n_b"),
        F.count_if("judged").alias("judged_pairs"),
    )
    every = pairs.select("pair_id", F.explode(F.array(*map(F.lit, granularities))).alias("granularity"))
    difference = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0)
    pct = 100.0 * (1.0 - difference)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.join(counted, [*GROUP], "left").select(*GROUP, pct.alias("similarity_pct"), (100.0 - pct).alias("difference_pct"), zero("n_a"), zero("n_b"), zero("judged_pairs"))
