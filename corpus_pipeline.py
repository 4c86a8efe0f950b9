"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return
the columns of documents.

Defined cases: rows that share a doc_id are one document: they share the decisions of near
duplicates and decontamination, and those with different texts all stay or all go; of rows
equal in id and text one stays (the first by their other columns).  A null doc_id is an id of
its own in filters, and its rows are never near duplicates of others.  Null and empty texts
are neither toxic (unless most labelled documents are), near duplicates, contaminated nor
changed, and pass.  Very long texts are read whole by every stage; ties between near
duplicates go to the smallest doc_id.  An empty table stays empty; further columns pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridelta.llm import decontaminate, jaccard_join, mixture, pii, toxicity
from veridelta.llm.blocks import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, trained on the labels of these documents: rows that score 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    return toxicity.scored(docs, model).where("toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, five words and a similarity of 0.8: of each group the smallest doc_id stays."""
    groups = jaccard_join.near_duplicates(docs, k=5, percent=80)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    # the smallest id itself may stand in several rows: equal texts stay once
    own = Window.partitionBy("doc_id", "text_").orderBy(F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    rows = docs.join(kept, "doc_id").withColumn("text_", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    once = rows.withColumn("number_", F.row_number().over(own)).where("number_ = 1").select(*docs.columns)
    return once.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, windows of ten words: documents with a benchmark passage go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(decontaminate.build_index(docs), items, n=10)
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: spans become their kind in brackets; n_chars is counted again."""
    annotated = pii.annotate(docs)
    spans = stored(annotated.select("pii_base", "pii_weak").where("size(pii_base) + size(pii_weak) > 0"), "pii")
    weights = pii.train(pii.patterns(spans))
    new = annotated.withColumn("text", pii.redacted(pii.accepted(weights), F.col("text")))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: equal weights of all sources, on average as many rows as come in."""
    return mixture.mix(docs, seed=7)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal-data", redact_personal_data),
    ("mixture", mix_sources),
]

#: a trained classifier decides in the first stage, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
