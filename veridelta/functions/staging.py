"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage, so what several results need is computed once and survives lost
executors; its size is known to the plans that read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark drops the shuffle files of a query when it ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or SparkContext's own setting.

    Only a session in one JVM (local mode), as in tests, gets a folder of its own where neither is set.
    """
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if not (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veridelta-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting is value for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage and shuffle files end there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridelta/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite").option("compression", "zstd")
    with setting(spark, CLEANUP, "true"):
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
