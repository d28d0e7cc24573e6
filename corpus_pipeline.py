"""The corpus pipeline: each stage works on all that the one before has kept.

Toxic documents go, repeated lines go, of near copies one document stays, sources are
mixed to their target weights (a document may then occur several times), and what is
left is encoded. Texts that change keep the count of their characters right.

Every stage takes rows with null or repeated keys, null, empty and very long texts,
other columns of any name and no rows at all. All stages but the last keep all columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelabels.llm import bpe, line_dedup, mixing, simhash, toxicity
from codelabels.llm.common import read, unused
from codelabels.llm.queries import MAX_EPOCHS, SEED, TARGETS, domain, toxicity_model
from codelabels.session import fresh_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; the model is learnt from labelled ones among docs.

    Null and empty texts score as texts without a hit and stay. Rows without key are
    judged like others and never learnt from. Without labels all documents stay.
    """
    model = toxicity_model(spark, sf_dir, docs)
    return docs.filter(toxicity.score(F.col("text"), model) < 0.5)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay only in the smallest document that holds them.

    Null texts stay null, empty ones empty. Rows with one key are one document, and so are
    those without key, which comes last.
    """
    n_lines, n_dropped = unused(docs, "n_lines", "n_dropped")
    found = line_dedup.dedup(docs, n_lines=n_lines, n_dropped=n_dropped)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest key, then the smallest text.

    Texts without words are one group. Rows without key come last. Unrelated texts
    that share a key all stay.
    """
    return simhash.representatives(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture holds them; its size is that of the corpus.

    Missing languages and sources are leaves by the empty name; texts without words
    take no budget. Equal rows in a leaf's last epoch are taken together.
    """
    return mixing.mixed(docs, TARGETS, domain(), max_epochs=MAX_EPOCHS, seed=SEED)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row's ids and decoded bytes; a null text counts as empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", without_near_copies),
    ("mixing", to_target_weights),
    ("byte-level BPE", encoded),
]
# A learnt model, components and token ids are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
