"""M1-M6: similarity join of the chunks of document pairs, greedy 1:1 matching, anti joins.

Pairs: pair_id, doc_a, doc_b.  The sparse join meets only chunks that share a bucket, on
(pair_id, granularity, bucket); it never forms the cross product of a pair's chunks unless
the floor admits a similarity of 0.  Greedy order is (s, i, j) descending: of equal
similarities the later A position wins, then the later B position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.staging import stored

FLOOR = 0.45
GROUP = ("pair_id", "granularity")


def sides(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of each pair's A and B documents, with pair_id."""
    return tuple(pairs.select("pair_id", F.col(f"doc_{s}").alias("doc_id")).join(rows, "doc_id").drop("doc_id") for s in "ab")


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumnsRenamed(names)


def sparse_cosine(pairs: DataFrame, features: DataFrame, floor: float = FLOOR, chunks: DataFrame | None = None) -> DataFrame:
    """M1, M2: (pair_id, granularity, i, j, s) with s >= floor, from integer bucket counts; chunks: needed where floor <= 0."""
    norms = features.groupBy("doc_id", "granularity", "index").agg(F.sum(F.col("v") * F.col("v")).alias("n2"))
    a, b = sides(pairs, features)
    a, b = _renamed(a, index="i", v="va"), _renamed(b, index="j", v="vb")
    dots = a.join(b, [*GROUP, "bucket"]).groupBy(*GROUP, "i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    na, nb = sides(pairs, norms)
    na, nb = _renamed(na, index="i", n2="na"), _renamed(nb, index="j", n2="nb")
    if floor > 0:
        joined = dots.where("dot > 0").join(na, [*GROUP, "i"]).join(nb, [*GROUP, "j"])
    else:
        ca, cb = sides(pairs, chunks.select("doc_id", "granularity", "index"))
        every = _renamed(ca, index="i").join(_renamed(cb, index="j"), [*GROUP])
        joined = every.join(dots, [*GROUP, "i", "j"], "left").join(na, [*GROUP, "i"], "left").join(nb, [*GROUP, "j"], "left")
    product = (F.col("na") * F.col("nb")).cast("double")
    s = F.when(product > 0, F.coalesce(F.col("dot"), F.lit(0)) / F.sqrt(product)).otherwise(0.0)
    return joined.select(*GROUP, "i", "j", s.alias("s")).where(F.col("s") >= floor)


def dense_cosine(pairs: DataFrame, vectors: DataFrame, floor: float = FLOOR) -> DataFrame:
    """The same from an embedding column; null embeddings meet nothing, zero ones have similarity 0."""
    own = vectors.where("embedding is not null").select("doc_id", "granularity", "index", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    own = own.withColumn("norm", F.sqrt(add(F.transform("e", lambda x: x * x))))
    a, b = sides(pairs, own)
    a, b = _renamed(a, index="i", e="ea", norm="na"), _renamed(b, index="j", e="eb", norm="nb")
    dot = add(F.zip_with("ea", "eb", lambda x, y: x * y))
    s = F.when(F.col("na") * F.col("nb") > 0, dot / (F.col("na") * F.col("nb"))).otherwise(0.0)
    return a.join(b, [*GROUP]).select(*GROUP, "i", "j", s.alias("s")).where(F.col("s") >= floor)


def greedy_grouped(candidates: DataFrame) -> DataFrame:
    """M3, strategy B: one pass over sorted candidates; a worker holds the positions that its current group has taken."""
    names = candidates.columns

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, a, b = None, set(), set()
        for batch in batches:
            keep = []
            for key, i, j in zip(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
                if key != group:
                    group, a, b = key, set(), set()
                free = i not in a and j not in b
                keep.append(free)
                if free:
                    a.add(i)
                    b.add(j)
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordered = candidates.select(*names).repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("s"), F.desc("i"), F.desc("j"))
    return ordered.mapInArrow(claim, candidates.schema)


def greedy_fold(candidates: DataFrame) -> DataFrame:
    """M3, strategy A: a fold over the sorted candidates, all in the JVM; for small groups."""
    kind = "array<struct<s:double,i:int,j:int>>"
    entry = F.struct(F.col("s").cast("double").alias("s"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))

    def step(kept, x):
        taken = F.exists(kept, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(x)))

    sorted_ = F.reverse(F.array_sort(F.collect_list(entry)))
    folded = candidates.groupBy(*GROUP).agg(sorted_.alias("c")).withColumn("m", F.aggregate("c", F.array().cast(kind), step))
    return folded.select(*GROUP, F.explode("m").alias("m")).select(*GROUP, "m.i", "m.j", "m.s")


def greedy_rounds(candidates: DataFrame) -> DataFrame:
    """M3, strategy C: rounds of edges that are the best of both ends, for groups beyond one worker's memory.

    Taking such edges until none is left gives the sequential greedy result (Preis 1999).
    """
    best = lambda side: Window.partitionBy(*GROUP, side).orderBy(F.desc("s"), F.desc("i"), F.desc("j"))
    left, matched = stored(candidates, "candidates"), None
    while not left.isEmpty():
        top = stored(left.withColumn("ra", F.row_number().over(best("i"))).withColumn("rb", F.row_number().over(best("j"))).where("ra = 1 and rb = 1").drop("ra", "rb"), "matched")
        matched = top if matched is None else matched.unionByName(top)
        left = stored(left.join(top.select(*GROUP, "i"), [*GROUP, "i"], "left_anti").join(top.select(*GROUP, "j"), [*GROUP, "j"], "left_anti").select(candidates.columns), "candidates")
    return candidates if matched is None else matched.select(candidates.columns)


STRATEGIES = {"grouped": greedy_grouped, "fold": greedy_fold, "rounds": greedy_rounds}


def unmatched(pairs: DataFrame, chunks: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4, M6: the chunks of A (deleted) and of B (added) that have no partner."""
    a, b = sides(pairs, chunks)
    out = []
    for side, key in ((a, "i"), (b, "j")):
        taken = matched.select(*GROUP, F.col(key).alias("index"))
        out.append(side.join(taken, [*GROUP, "index"], "left_anti"))
    return out[0], out[1]
