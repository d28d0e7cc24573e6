"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words and frames lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Batches sent to Python are bounded by bytes, so very long texts travel in small groups.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as the queries read it: Arrow batches bounded, this package importable by workers."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (paths := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (paths, root)))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash with those of df, whatever their case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def below(hashed: Column, share: Column | float) -> Column:
    """True for that share of all 64-bit hashes, the smallest ones."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return hashed.cast("double") < share * 2.0**64 - 2.0**63


def drawn(keys: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of distinct keys with the smallest hash; of many keys only about 2 n are ever sorted."""
    total, draw = keys.count(), F.xxhash64(key)
    if total > 4 * n + 1000:
        keys = keys.filter(below(draw, (2 * n + 1000) / total))
    return keys.orderBy(draw, key).limit(n)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def plain(texts: pa.Array) -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [t or "" for t in texts.to_pylist()]


def structs(**columns: tuple[Iterable, pa.DataType]) -> pa.Array:
    """A struct array from named (values, type) pairs."""
    return pa.StructArray.from_arrays([pa.array(v, kind) for v, kind in columns.values()], list(columns))
