"""Comparison of document versions as they arrive: an extension, not an operator of the inventory.

A stream of (pair_id, doc_a, doc_b) is compared batch by batch against a table of blocks; the
summaries are appended under the batch's number, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veridelta.plans.compare import CompareConfig, compare


def compare_arrivals(pairs: DataFrame, blocks: DataFrame, out: str, checkpoint: str, config: CompareConfig | None = None) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        summary = compare(df, blocks, config).summary.withColumn("batch", F.lit(number))
        summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
