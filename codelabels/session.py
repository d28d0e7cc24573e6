"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and merges small ones at run time. Scoring is
# heavy per byte, so partitions may stay small where cores are still free.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "codelabels", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Names of commits are digits that only a codec with an entropy coder shortens.
CODEC = "zstd"

_INNER: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or else one in the warehouse, which is shared as well."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def fresh_path(spark: SparkSession, purpose: str) -> str:
    return f"{_INNER.get() or shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[str]:
    """Keeps what is settled inside in a folder that is deleted at the end.

    For jobs that write their results before they end, such as stream batches.
    """
    folder = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    token = _INNER.set(folder)
    try:
        yield folder
    finally:
        _INNER.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write a narrow frame to the shared folder and go on from the written table.

    Used where keys decide which wide rows are needed. The optimizer then knows
    the keys' true size: few are broadcast and the wide table is filtered where
    it lies; many are shuffled as a plain table, whose hot keys AQE can split
    (it cannot below an aggregate). The table also outlives lost executors.
    """
    spark = df.sparkSession
    path = fresh_path(spark, purpose)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
