"""Positions within a group that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

SPAN = 1 << 16
# Bits of the numbers a row of the table of places stands for, and such rows that may be sent to all tasks.
BLOCK_BITS, MOST_BLOCKS = 12, 1 << 16
# Above this number Spark no longer cuts ranks off before the shuffle.
EARLY_CUT = "spark.sql.optimizer.windowGroupLimitThreshold"


def number_within(
    df: DataFrame, group: str, order: str, position: str = "position", total: str | None = None, span: int = SPAN
) -> DataFrame:
    """Number each group's rows by a column that is unique in it; rows without a group drop out.

    A plain window would sort a whole group in one task. Where there are more than
    ``span`` rows they are range-partitioned by group and order instead, into parts
    of about half that number, however the values are spread and whatever a group's
    size. A row's position is its place in its part plus the group's rows in the
    parts before, which a table of one row per part and group tells. The rows are
    written twice, so pass narrow ones; the second time with their part, so that
    both passes see the same cut.
    """
    rows = settle(df.where(F.col(group).isNotNull()), "unnumbered")
    count = rows.count()
    if count <= span:
        place = F.row_number().over(Window.partitionBy(group).orderBy(order))
        return _numbered(rows, group, place, F.count(F.lit(1)).over(Window.partitionBy(group)), position, total)
    parts = -(-2 * count // span)
    ranged = settle(rows.repartitionByRange(parts, group, order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = settle(ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows")), "part-counts")
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        group,
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("_all"),
    )
    inside = Window.partitionBy(group, "_part").orderBy(order)
    joined = ranged.join(offsets, [group, "_part"])
    return _numbered(joined, group, F.col("_before") + F.row_number().over(inside), F.col("_all"), position, total).drop("_part", "_before", "_all")


def _numbered(rows: DataFrame, group: str, place: Column, of: Column, position: str, total: str | None) -> DataFrame:
    out = rows.withColumn(position, place.cast("bigint"))
    return out.withColumn(total, of.cast("bigint")) if total else out


def with_position(rows: DataFrame, places: DataFrame, group: str, order: str, position: str = "position") -> DataFrame:
    """Wide rows with the positions :func:`number_within` gave them; they stay where they lie.

    Positions follow the order, so 64 numbers need the first position and a bit for
    each that is there. A row of the table made of them stands for ``BLOCK`` numbers
    of a group. Up to ``MOST_BLOCKS`` of them, a kilobyte each, are sent to all
    tasks; more are joined as any table. ``order`` is an integer, ``places`` hold all rows.
    """
    number = F.col(order).cast("bigint")
    block, word = F.shiftright(number, BLOCK_BITS), F.shiftright(F.pmod(number, F.lit(1 << BLOCK_BITS)), 6).cast("int")
    shifted = lambda ones: F.call_function("shiftleft", F.lit(ones).cast("bigint"), F.pmod(number, F.lit(64)).cast("int"))
    words = places.groupBy(group, block.alias("_block"), word.alias("_word")).agg(F.bit_or(shifted(1)).alias("bits"), F.min(position).alias("first"))
    held = words.groupBy(group, "_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", F.struct("bits", "first")))).alias("_held"))
    every = F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS - 6) - 1))
    column = lambda name: F.transform(every, lambda w: F.try_element_at("_held", w)[name]).alias(f"_{name}")
    blocks = settle(held.select(group, "_block", column("bits"), column("first")), "blocks")
    if blocks.count() <= MOST_BLOCKS:
        blocks = blocks.hint("broadcast")
    before = F.bit_count(F.get("_bits", word).bitwiseAND(F.bitwise_not(shifted(-1))))
    joined = rows.withColumn("_block", block).join(blocks, [group, "_block"])
    return joined.withColumn(position, F.get("_first", word) + before).drop("_block", "_bits", "_first")


def first_within(df: DataFrame, group: str, order: str, count: int | None, skip: int = 0) -> DataFrame:
    """Rows ``skip+1 .. skip+count`` of each group; all after ``skip`` if None."""
    if count is None and not skip:
        return df
    last = None if count is None else skip + count
    if last is not None and last <= int(df.sparkSession.conf.get(EARLY_CUT, "1000")):
        # Catalyst plans WindowGroupLimit: every map task keeps at most `last`
        # rows per group, so a hot group never travels whole.
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    else:
        ranked = number_within(df, group, order, "_rank")
    kept = ranked.where(F.col("_rank") > skip)
    if last is not None:
        kept = kept.where(F.col("_rank") <= last)
    return kept.drop("_rank")
