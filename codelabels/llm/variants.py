"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two different words are one edit (a code point inserted, deleted or replaced) apart if
the lengths of their common prefix and common suffix together reach the longer word's
length less one. Words are compared in tiles: two blocks of words as padded matrices of
code points, all pairs of the tile at once, prefix and suffix lengths from the first
mismatch seen from either side.

Which blocks can hold a pair follows from the same lengths. If the shorter word has l
code points, the edit lies behind the first k = l // 2 of them, so these agree, or else the
last l - k agree. So a word joins the groups (l, first k) and (l, last l - k) for l its own
length and one less; a pair that agrees in both counts in the first only. Groups of more
than `BLOCK` words are cut into blocks by hash and all their block pairs are tiles of
their own, so no task holds a hot group and no pair is left out. Tiles report sums per
word, not pairs.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

BLOCK, BUNDLE_ROWS = 1024, 1 << 13
_CELLS = 1 << 22  # comparisons made at a time
_TYPE, _X = 60, 30  # where a tile's number holds its kind and first block


def vocabulary(words: DataFrame, min_chars: int = 1, min_count: int = 1, word: str = "word") -> DataFrame:
    """Distinct words of at least `min_chars` code points with n, their number of rows, if it is `min_count` or more.

    Null words are passed over. Rows are counted before they are shuffled, so a very common word costs no more.
    """
    kept = words.select(F.col(word).alias("word")).filter(F.length("word") >= max(1, min_chars))
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _members(words: DataFrame) -> DataFrame:
    """Rows (word, n, l, suffix, right, g): the groups a word joins; g is the group's hash.

    Words of l code points stand left, those of l + 1 right.
    """
    size = F.length("word")

    def member(right: bool, suffix: bool) -> Column:
        l = size - int(right)
        k = F.shiftright(l, 1)
        anchor = F.col("word").substr(size - (l - k) + 1, l - k) if suffix else F.col("word").substr(F.lit(1), k)
        row = F.struct(l.alias("l"), F.lit(suffix).alias("suffix"), F.lit(right).alias("right"), F.xxhash64(l, F.lit(suffix), anchor).alias("g"))
        return F.when(l > 0, row)

    every = F.array_compact(F.array(*(member(r, s) for r in (False, True) for s in (False, True))))
    return words.select("word", "n", F.inline(every))


def _tiles(members: DataFrame, block: int) -> DataFrame:
    """Each member once for every tile it is compared in; t is -1 in groups that are one tile."""
    left, right = F.sum((~F.col("right")).cast("long")), F.sum(F.col("right").cast("long"))
    sizes = members.groupBy("g").agg(left.alias("left"), right.alias("rest")).filter(F.col("left") + F.col("rest") > block)
    hot = settle(sizes.select("g", F.ceil(F.col("left") / block).cast("long").alias("xs"), F.ceil(F.col("rest") / block).cast("long").alias("ys")), "variant-groups")

    def tile(kind: int, x: Column, y: Column, role: Column) -> Column:
        number = F.shiftleft(F.lit(kind).cast("long"), _TYPE) + F.shiftleft(x, _X) + y
        return F.struct(number.alias("t"), role.alias("right"))

    def upto(n: str) -> Column:
        return F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))

    mine = F.pmod(F.xxhash64("word", F.lit(1)), F.when(F.col("right"), F.col("ys")).otherwise(F.col("xs")))
    same = F.transform(upto("xs"), lambda x: tile(0, F.least(x, F.col("b")), F.greatest(x, F.col("b")), x < F.col("b")))
    across = F.transform(upto("ys"), lambda y: tile(1, F.col("b"), y, F.lit(False)))
    below = F.transform(upto("xs"), lambda x: tile(1, x, F.col("b"), F.lit(True)))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("t"), F.col("right")))
    places = F.when(F.col("xs").isNull(), alone).when(F.col("right"), below).otherwise(F.concat(same, across))
    placed = members.join(hot, "g", "left").withColumn("b", mine).withColumn("places", places)
    return placed.select("word", "n", "l", "suffix", "g", F.inline("places"))


def _codes(words: list[str], width: int):
    import numpy as np

    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def near_pairs(left: list[str], right: list[str] | None, suffix: bool):
    """Numbers (a, b) of the words one edit apart; right None: among the left ones, each pair once.

    The left words have one length, the right ones too: the same or one more. suffix
    passes over pairs that agree in the first half as well.
    """
    import numpy as np

    size = len(left[0])
    wide = size if right is None else len(right[0])
    first = _codes(left, size)
    second = first if right is None else _codes(right, wide)
    behind, ahead = second[:, :size], second[:, wide - size :]
    found, rows = [], max(1, _CELLS // max(1, len(second) * size))
    for low in range(0, len(first), rows):
        some = first[low : low + rows, None, :]
        same = some == behind
        prefix = np.where(same.all(2), size, same.argmin(2))
        same = (some == ahead)[:, :, ::-1]
        hit = prefix + np.where(same.all(2), size, same.argmin(2)) >= wide - 1
        if suffix:
            hit &= prefix < size // 2
        a, b = np.nonzero(hit)
        a += low
        if right is None:
            a, b = a[a < b], b[a < b]
        found.append((a, b))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compared(rows: pa.Table) -> pa.Table:
    """Per word of the tiles with a near one: their number, the largest n among them and the first word with it."""
    import numpy as np

    words, counts = rows["word"].to_pylist(), rows["n"].to_numpy()
    tiles: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for i, (w, l, suffix, t, role) in enumerate(zip(words, *(rows[c].to_pylist() for c in ("l", "suffix", "t", "right")), strict=True)):
        tiles[l, suffix, t, w[len(w) - (l - l // 2) :] if suffix else w[: l // 2]][role].append(i)
    ones, others = [], []
    for (_, suffix, t, _), (left, right) in tiles.items():
        held = np.array(left)
        # Tiles of one block, or of a block with itself, also compare the left words with each other.
        if len(left) > 1 and (t < 0 or not t >> _TYPE and (t >> _X & (1 << _X) - 1) == t & (1 << _X) - 1):
            a, b = near_pairs([words[i] for i in left], None, suffix)
            ones.append(held[a])
            others.append(held[b])
        if left and right:
            a, b = near_pairs([words[i] for i in left], [words[i] for i in right], suffix)
            ones.append(held[a])
            others.append(np.array(right)[b])
    one, other = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ones + others, others + ones))
    names = sorted({words[i] for i in one.tolist()})
    place = {w: k for k, w in enumerate(names)}
    rank = np.array([place.get(w, -1) for w in words], np.int64)
    order = np.lexsort((rank[other], -counts[other], rank[one]))
    one, other = one[order], other[order]
    starts = np.flatnonzero(np.r_[True, rank[one][1:] != rank[one][:-1]]) if len(one) else one
    return pa.table(
        {
            "word": pa.array(names, pa.string()),
            "near": pa.array(np.diff(np.r_[starts, len(one)]), pa.int64()),
            "best_n": pa.array(counts[other[starts]], pa.int64()),
            "best": pa.array([words[i] for i in other[starts].tolist()], pa.string()),
        }
    )


def near(words: DataFrame, block: int = BLOCK, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """Every word with n, n_near (near words), best and best_n (the near word of largest n, the first of several).

    words: word and n, each word once. Words without a near one have 0 and nulls.
    """
    # Tiles are small; as many as fill a group's worth of rows go to Python together.
    bundles = max(1, 4 * words.count() // bundle_rows)
    tiles = _tiles(_members(words), block).withColumn("bundle", F.pmod(F.xxhash64("g", "t"), F.lit(bundles)))
    found = tiles.select("bundle", "word", "n", "l", "suffix", "t", "right").groupBy("bundle").applyInArrow(_compared, "word string, near long, best_n long, best string")
    summed = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    known = words.join(settle(summed, "variant-near"), "word", "left")
    return known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def _ends(links: DataFrame) -> DataFrame:
    """Each word's last form. A form is much more frequent than its word, so chains are short and end."""
    while True:
        onward = links.select(F.col("word").alias("form"), F.col("form").alias("next"))
        ahead = settle(links.join(onward, "form"), "variant-ahead")
        if ahead.isEmpty():
            return links
        moved = links.join(ahead.select("word", "next"), "word", "left")
        links = settle(moved.select("word", F.coalesce("next", "form").alias("form")), "variant-links")


def group(words: DataFrame, ratio: int = 10, block: int = BLOCK, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """Every word with n, n_near, form, form_n and root.

    words: word and n, each word once (see `vocabulary`); empty gives no rows. form is
    the near word of largest n, ties to the first in code-point order, if that is at
    least `ratio` (2 or more) times the word's own, else null. root is where the forms lead, or the word itself.
    """
    found = near(words, block, bundle_rows)
    taken = F.col("best_n") >= ratio * F.col("n")
    found = found.select("word", "n", "n_near", F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    found = settle(found, "variant-forms")
    ends = _ends(found.filter("form is not null").select("word", "form")).withColumnRenamed("form", "root")
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
