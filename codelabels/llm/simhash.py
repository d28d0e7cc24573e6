"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has a bit set if more than half of the hashes of its word
shingles have it set. Two documents are linked if their fingerprints differ in two bits
at most. The 64 bits are cut into two segments, of which one then differs by one bit at
most. Indexed are both whole segments and the 32 variants of the first one with one bit
replaced by a wildcard (a pair with one bit in each segment meets there; the remaining
pairs agree in a whole segment). Variants that several fingerprints share are found by
equality.

The pairs of a variant that few fingerprints share are joined and verified. Where more
than 64 share one, as in a large group of near copies, not all pairs are compared: the
other segment is treated alike, under a wildcard variant by its own one-wildcard
variants; under an equal segment, where two bits may differ, by the values one bit
away. All fingerprints with the same pair of keys are within two bits of each other, at
most 33 of them exist, and linking each to the smallest loses no connection. So either
way a fingerprint meets at most about 33 rows per variant, and no link is lost.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import plain, unused
from .components import components

SEED, DISTANCE, WORDS = 42, 2, 3
FEW = 64  # so many fingerprints have as many pairs as second-level keys
_BLOCK = 255 * 64  # rows of bits summed at a time


def _fingerprint(text: str, words: int) -> int:
    import numpy as np
    import xxhash

    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for low in range(0, len(starts), _BLOCK):
        some = [digest(joined[s:e], SEED) for s, e in zip(starts[low : low + _BLOCK], ends[low : low + _BLOCK], strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """64-bit fingerprint as a long; zero for null texts and those without words."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = (_fingerprint(t, words) for t in plain(texts))
        return pa.array([f - (1 << 64) if f >> 63 else f for f in found], pa.int64())

    return run(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _index(prints: DataFrame) -> DataFrame:
    """Rows (fp, key, bit) per whole segment and per one-wildcard variant of the first."""
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)

    def variant(i: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        return F.struct((F.call_function("shiftleft", i.cast("long"), F.lit(32))).bitwiseOR(first.bitwiseAND(F.bitwise_not(mask))).alias("key"), (first.bitwiseAND(mask) != 0).cast("int").alias("bit"))

    tag = lambda i: F.lit(i << 32).cast("long")
    whole = F.array(*(F.struct(tag(n).bitwiseOR(part).alias("key"), F.lit(0).alias("bit")) for n, part in ((32, first), (33, second))))
    wild = F.transform(F.sequence(F.lit(0), F.lit(31)), variant)
    return prints.select("fp", F.inline(F.concat(whole, wild)))


def _refined(candidates: DataFrame) -> DataFrame:
    """Rows (fp, key, mid): the second level on the segment that the key leaves open."""
    place = F.shiftright("key", 32)
    rest = F.when(place == 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    bits = F.sequence(F.lit(0), F.lit(31))
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    near = F.concat(F.array(F.col("rest")), F.transform(bits, lambda i: F.col("rest").bitwiseXOR(one(i))))
    wild = F.transform(bits, lambda i: F.call_function("shiftleft", i.cast("long"), F.lit(32)).bitwiseOR(F.col("rest").bitwiseAND(F.bitwise_not(one(i)))))
    return candidates.select("fp", "key", place.alias("place"), rest.alias("rest")).select("fp", "key", F.explode(F.when(F.col("place") >= 32, near).otherwise(wild)).alias("mid"))


def links(prints: DataFrame, few: int = FEW) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within two bits."""
    spark = prints.sparkSession
    dealt = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = _index(dealt)
    # One number per variant: fingerprints, and in the upper half those with the wildcard bit set.
    sums = index.groupBy("key").agg(F.sum(F.lit(1).cast("long") + F.shiftleft(F.col("bit").cast("long"), 32)).alias("n"))
    count, ones = F.col("n").bitwiseAND(0xFFFFFFFF), F.shiftright("n", 32)
    shared = sums.filter((count > 1) & ((F.shiftright("key", 32) >= 32) | ((ones > 0) & (ones < count))))
    shared = settle(shared.select("key", count.alias("n")), "simhash-variants")
    candidates = settle(index.join(shared, "key").select("fp", "key", "n"), "simhash-candidates")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    cold = candidates.filter(F.col("n") <= few)
    pairs = cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key").filter((F.col("a") < F.col("b")) & near)
    group = Window.partitionBy("key", "mid")
    stars = _refined(candidates.filter(F.col("n") > few)).select(F.min("fp").over(group).alias("a"), F.col("fp").alias("b")).filter((F.col("a") < F.col("b")) & near)
    return pairs.select("a", "b").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: the key, fp, component (the smallest key linked through any chain) and root.

    root is the smallest fingerprint of the component. Exact copies have one
    fingerprint and are linked as one, as are all texts without words. Null keys
    never name a component unless it has no other; repeated rows are kept.
    """
    marked = settle(docs.select(F.col(key).alias("id"), fingerprint(F.col(text), words).alias("fp")), "simhash-marked")
    prints = settle(marked.groupBy("fp").agg(F.min("id").alias("first")), "simhash-prints")
    roots = components(settle(links(prints), "simhash-links"), "a", "b")
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted, "simhash-roots")
    names = settle(rooted.groupBy("root").agg(F.min("first").alias("component")), "simhash-names")
    named = settle(rooted.join(names, "root").select("fp", "root", "component"), "simhash-named")
    return marked.join(named, "fp").select(F.col("id").alias(key), "fp", "component", "root")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row of docs per component: that with the smallest key, then the smallest text.

    Rows without key come last. Rows that repeat a key stand for themselves, so unrelated texts
    with one key all stay. Only rows with a repeated or missing key have their texts compared;
    the others are picked out by key where they lie.
    """
    found = near_duplicates(docs, key, text, words)
    found = settle(found.select(F.col(key).alias("id"), "fp", "root"), "simhash-found")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("m")
    often = settle(found.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "simhash-often")
    firsts = settle(found.groupBy("root").agg(first).select("root", "m.id"), "simhash-firsts")
    name, fp, root, one = unused(docs, "name", "fp", "root", "one")
    single = settle(firsts.filter("id is not null").join(often, "id", "left_anti").select(F.col("id").alias(name)), "simhash-single")
    known = docs.join(single, F.col(key) == F.col(name), "left_semi")
    # Which fingerprints with a repeated or missing key belong to the component that this key stands for.
    several = firsts.join(often, "id", "left_semi").unionByName(firsts.filter("id is null"))
    held = found.join(several.select("root", F.col("id").alias("first")), "root").filter(F.col("id").eqNullSafe(F.col("first")))
    held = settle(held.select(F.col("id").alias(name), F.col("fp").alias(fp), F.col("root").alias(root)).distinct(), "simhash-several")
    rows = docs.join(held.select(name).distinct(), F.col(key).eqNullSafe(F.col(name)), "left_semi").withColumn(fp, fingerprint(F.col(text), words))
    rows = rows.join(held, F.col(key).eqNullSafe(held[name]) & (rows[fp] == held[fp])).drop(held[fp], held[name])
    rows = rows.withColumn(one, F.row_number().over(Window.partitionBy(root).orderBy(text))).filter(F.col(one) == 1)
    return known.select(docs.columns).unionByName(rows.select(docs.columns))
