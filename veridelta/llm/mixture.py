"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target share w of `total` output rows and c documents has the mean repetition
rate w * total / c.  Each document draws its number of copies from Poisson(rate) by
inverting the distribution at a uniform number hashed from seed and doc_id: the number of
values of the cumulative distribution that are <= u.  Rates above STEP are the sum of equal
parts, each with its own hash, as sums of Poisson variables are Poisson.  Documents are
exploded by their count and put in an order hashed from seed, doc_id and copy: one hash
exchange and a sort inside partitions give a uniformly random order of the whole output.

The sources' rates are a small table that Spark broadcasts only while it is under its size
threshold; beyond, the join shuffles and adaptive execution splits a hot source.

Defined cases: a null source is a source; sources without a target have weight 0 and leave;
a null doc_id draws like the text "null"; repeated ids draw equal counts; an empty table
stays empty; other columns pass through, save that `copy`, `copies` and `order_key` are
replaced by this operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

STEP = 32.0
#: bytes of (compressed) files whose rows one partition of the output takes
PART_BYTES = 64 << 20


def uniform(seed: int, *parts: Column | str) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: DataFrame | None, total: int | None, source: str) -> DataFrame:
    """source, rate, parts and the cumulative distribution of a part, for each source of the documents."""
    n = docs.groupBy(F.col(source).alias("source_")).agg(F.count("*").alias("n_"))
    if targets is None:
        n = n.withColumn("weight_", F.lit(1.0))
    else:
        t = targets.select(F.col("source").alias("target_"), F.col("weight").cast("double").alias("weight_"))
        n = n.join(t, n["source_"].eqNullSafe(t["target_"]), "left").withColumn("weight_", F.greatest(F.lit(0.0), F.coalesce("weight_", F.lit(0.0)))).drop("target_")
    sums = n.agg(F.sum("n_").alias("all_"), F.sum("weight_").alias("weights_"))
    out = F.lit(float(total)) if total is not None else F.col("all_")
    rate = F.when(F.col("weights_") > 0, F.col("weight_") / F.col("weights_") * out / F.col("n_")).otherwise(0.0)
    n = n.join(F.broadcast(sums)).withColumn("rate_", rate)  # sums is one row
    n = n.withColumn("parts_", F.greatest(F.lit(1), F.ceil(F.col("rate_") / STEP)).cast("int"))
    part = F.col("rate_") / F.col("parts_")
    last = (F.lit(24) + F.ceil(part + 12 * F.sqrt(part))).cast("int")
    start = F.struct(F.exp(-part).alias("p"), F.exp(-part).alias("s"), F.array(F.exp(-part)).alias("cdf"))
    grow = lambda a, i: F.struct((a["p"] * part / i).alias("p"), (a["s"] + a["p"] * part / i).alias("s"), F.concat(a["cdf"], F.array(a["s"] + a["p"] * part / i)).alias("cdf"))
    return n.select("source_", "rate_", "parts_", F.aggregate(F.sequence(F.lit(1), last), start, grow, lambda a: a["cdf"]).alias("cdf_"))


def mix(docs: DataFrame, targets: DataFrame | None = None, total: int | None = None, seed: int = 7, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents' rows replicated and shuffled, with copy (from 0), copies and order_key.

    targets: source, weight (default: equal weights); total: mean number of rows (default: as many as come in).
    """
    r = rates(docs, targets, total, source)
    own = docs.drop("copy", "copies", "order_key")
    # the number is bound as the only element of an array, so it is hashed once and not for each entry of the distribution
    draw = lambda j: F.element_at(F.transform(F.array(uniform(seed, key, j)), lambda u: F.size(F.filter("cdf_", lambda c: c <= u))), 1)
    rows = own.join(r, own[source].eqNullSafe(r["source_"])).withColumn("copies", F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts_")), draw), F.lit(0), lambda a, x: a + x))
    rows = rows.where("copies > 0").select(*own.columns, "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    rows = rows.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary")))
    return rows.repartition(_parts(docs, total), "order_key").sortWithinPartitions("order_key")


def _parts(docs: DataFrame, total: int | None) -> int:
    """Partitions of the global shuffle: the session's number, or more where the files are larger than so many times PART_BYTES."""
    least, size = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), B.estimated_bytes(docs)
    grown = 1 if total is None or size is None else max(1, total // max(1, docs.count()))
    return max(least, -(-grown * (size or 0) // PART_BYTES))


#: the same for op3_mixture's parameters: equal weights, as many rows as documents
def oracle_sql(seed: int = 7, relation: str = "documents", columns: str = "d.doc_id, d.lang, d.source, d.n_chars, d.text") -> str:
    u = f"CAST('0x' || substr(md5(concat('{seed}:', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), ':', CAST(j AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0"
    return f"""
WITH src AS (SELECT source, count(*) AS n FROM {relation} GROUP BY source),
rate AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM src) * (SELECT sum(n) FROM src) / n AS r FROM src),
part AS (SELECT source, greatest(1, ceil(r / {STEP}))::INT AS parts, r / greatest(1, ceil(r / {STEP})) AS r FROM rate),
cdf AS (SELECT source, i, sum(exp(-r + i * ln(r) - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i) AS c
        FROM (SELECT source, r, unnest(range(0, (25 + ceil(r + 12 * sqrt(r)))::INT)) AS i FROM part)),
cdfs AS (SELECT source, list(c ORDER BY i) AS cs FROM cdf GROUP BY source),
parted AS (SELECT d.doc_id, d.source, s.cs, unnest(range(1, p.parts + 1)) AS j FROM (SELECT DISTINCT doc_id, source FROM {relation}) d
  JOIN part p ON d.source IS NOT DISTINCT FROM p.source JOIN cdfs s ON d.source IS NOT DISTINCT FROM s.source),
draws AS (SELECT doc_id, source, sum(len(list_filter(cs, lambda c: c <= {u}))) AS copies FROM parted d GROUP BY doc_id, source)
SELECT {columns}, w.copies::INT AS copies, t.copy::INT AS copy,
       md5(concat('{seed}:order:', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), ':', CAST(t.copy AS VARCHAR))) AS order_key
FROM {relation} d JOIN draws w ON d.doc_id IS NOT DISTINCT FROM w.doc_id AND d.source IS NOT DISTINCT FROM w.source,
     LATERAL (SELECT unnest(range(0, w.copies::BIGINT)) AS copy) t"""
