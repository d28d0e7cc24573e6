"""Overlapping windows over a file's significant lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, normalise_lines, significant_lines
from ..schemas import WINDOW_GROW, WINDOW_MAX, WINDOW_MIN, WINDOW_MOVE

# Windows built per row; bounds the memory one very long file can ask for.
BLOCK = 256


def file_lines(df: DataFrame, content: str = "file_content", normalised: bool = True) -> DataFrame:
    """Replace the text by its cleaned significant lines, ready for windows."""
    lines = significant_lines(clean(F.col(content)))
    return df.withColumn("lines", normalise_lines(lines) if normalised else lines).drop(content)


def line_windows(
    df: DataFrame,
    min_size: int = WINDOW_MIN,
    max_size: int = WINDOW_MAX,
    grow: int = WINDOW_GROW,
    move: int = WINDOW_MOVE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per window with ``size``, ``start`` and ``code``; ``lines`` goes.

    Sizes shrink to the file's length. A file without lines gives one empty
    window; one without any window keeps a row of nulls so that it is not lost.
    Lines are first cut into blocks and then into windows, so no row ever holds
    more than ``block`` windows and long files cost linear time.
    """
    rest = [c for c in df.columns if c != "lines"]
    lines = F.col("lines")
    n = F.size(lines)
    low, high = F.least(F.lit(min_size), n), F.least(F.lit(max_size), n)
    sizes = F.when(low <= high, F.sequence(low, high, F.lit(grow)))

    def blocks_of(size: Column) -> Column:
        firsts = F.sequence(F.lit(0), n - size, F.lit(move * block))
        return F.transform(
            firsts,
            lambda first: F.struct(
                size.alias("size"),
                first.alias("first"),
                F.slice(lines, first + 1, size + move * (block - 1)).alias("part"),
            ),
        )

    blocks = df.select(*rest, F.explode_outer(F.flatten(F.transform(sizes, blocks_of))).alias("_block"))
    size, first, part = (F.col(f"_block.{f}") for f in ("size", "first", "part"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size(part) - size, F.lit(move)),
        lambda at: F.struct(
            size.alias("size"),
            (first + at).alias("start"),
            F.array_join(F.slice(part, at + 1, size), "\n").alias("code"),
        ),
    )
    return blocks.select(*rest, F.explode_outer(windows).alias("_window")).select(*rest, "_window.*")
