"""Reversible line deduplication.

The state of a corpus is three tables:

* `references`: one row per document and line key it holds;
* `counts`: per line key the number of documents that hold it and the smallest of them;
* `filters`: per shard a cuckoo filter of the keys that two or more documents hold.

Inserting or deleting documents changes the exact tables and puts keys into the filters
or takes them out, so deleting what was inserted gives back the earlier state. To judge
lines, a document's keys are first looked up in the filter of their shard. Only those
found there, few on most corpora, meet the exact counts, which have the last word.

Tables grow by folders of what a change adds: new references, the ids of deleted
documents, counts of touched keys, filters of touched shards. Each row bears the number of
its change and the highest one holds. After `PARTS` folders a table is written as one.
When the keys outgrow the shards, their number doubles and the filters are built anew,
so a shard never has much more than `shard_keys` keys, whatever a state began with.

A line's key is the line without blanks at both ends, A-Z lower-cased, as the first 16
bytes of its SHA-256. Keys of fewer than `min_chars` characters are never dropped. Of a
key that several documents hold, all lines go but those of the smallest document.

Null or empty texts have one empty line. Rows with the same key are one document. Rows
without key are one document that comes after all others (so does the id 2**63 - 1).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, settle
from .common import BLANKS, ascii_lower, unused

LAST = (1 << 63) - 1
MIN_CHARS = 10
SHARD_KEYS, GROUP_ROWS, PARTS = 1 << 18, 1 << 20, 8
REFERENCES, COUNTS = "doc long, line_key binary, version long", "line_key binary, docs long, holder long, version long"


def line_key(line: Column, min_chars: int = MIN_CHARS) -> Column:
    """The key of a line, null for lines that are too short to be dropped."""
    bare = ascii_lower(F.btrim(line, F.lit(BLANKS)))
    return F.when(F.length(bare) >= min_chars, F.substring(F.unhex(F.sha2(bare, 256)), 1, 16))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doc(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST))


@dataclass(frozen=True)
class State:
    """Folders of the three tables and of deleted ids; the tables are read by the properties."""

    spark: SparkSession
    held: tuple[str, ...]
    gone: tuple[str, ...]
    counted: tuple[str, ...]
    filtered: tuple[str, ...]
    shards: int
    keys: int  # line keys that some document holds
    version: int
    min_chars: int
    shard_keys: int

    @property
    def references(self) -> DataFrame:
        """doc, line_key"""
        rows = self.spark.read.schema(REFERENCES).parquet(*self.held)
        if self.gone:
            until = self.spark.read.schema("doc long, version long").parquet(*self.gone).groupBy("doc").agg(F.max("version").alias("until"))
            rows = rows.join(until, "doc", "left").filter("until is null or version > until")
        return rows.select("doc", "line_key")

    def counts_of(self, keys: DataFrame | None = None) -> DataFrame:
        """line_key, docs, holder: the newest row of each key, of those in `keys` if given."""
        rows = self.spark.read.schema(COUNTS).parquet(*self.counted)
        if keys is not None:
            rows = rows.join(keys, "line_key", "left_semi")
        if len(self.counted) > 1:
            rows = rows.groupBy("line_key").agg(F.max_by(F.struct("docs", "holder"), "version").alias("c")).select("line_key", "c.*")
        return rows.filter("docs > 0").select("line_key", "docs", "holder")

    @property
    def counts(self) -> DataFrame:
        return self.counts_of()

    def filters_of(self, shards: DataFrame | None = None) -> DataFrame:
        """shard, data: the newest filter of each shard."""
        rows = self.spark.read.schema("shard long, data binary, version long").parquet(*self.filtered)
        if shards is not None:
            rows = rows.join(shards, "shard", "left_semi")
        if len(self.filtered) > 1:
            rows = rows.groupBy("shard").agg(F.max_by("data", "version").alias("data"))
        return rows.select("shard", "data")

    @property
    def filters(self) -> DataFrame:
        return self.filters_of()


def _put(df: DataFrame, purpose: str, version: int) -> str:
    """Writes what a change adds and returns its folder."""
    path = fresh_path(df.sparkSession, purpose)
    df.withColumn("version", F.lit(version).cast("long")).write.parquet(path)
    return path


def _references(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    held = docs.select(_doc(key).alias("doc"), F.explode(F.transform(lines(F.col(text)), lambda x: line_key(x, min_chars))).alias("line_key"))
    return held.filter("line_key is not null").distinct()


def _counts(references: DataFrame) -> DataFrame:
    return references.groupBy("line_key").agg(F.count("*").alias("docs"), F.min("doc").alias("holder"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("line_key"), F.lit(shards))


def _hashed(keys: DataFrame, shards: int, *more: str) -> DataFrame:
    return keys.select(_shard(shards).alias("shard"), F.xxhash64("line_key", F.lit(1)).alias("h"), *more)


def _built(counts: DataFrame, shards: int) -> DataFrame:
    """A filter per shard that has shared keys. A key is in one shard; shards hold about SHARD_KEYS."""

    def build(group: pa.Table) -> pa.Table:
        from .cuckoo import Cuckoo

        data = Cuckoo.holding(group["h"].to_numpy()).dump()
        return pa.table({"shard": group["shard"][:1], "data": pa.array([data], pa.binary())})

    return _hashed(counts.filter("docs > 1"), shards).groupBy("shard").applyInArrow(build, "shard long, data binary")


def start(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> State:
    """The state of a corpus. The number of shards follows from its number of lines."""
    spark = docs.sparkSession
    held = _put(_references(docs, key, text, min_chars), "line-references", 0)
    counted = _put(_counts(spark.read.schema(REFERENCES).parquet(held)), "line-counts", 0)
    state = State(spark, (held,), (), (counted,), (), 1, 0, 0, min_chars, shard_keys)
    keys = state.counts.count()
    shards = max(1, -(-keys // shard_keys))
    return replace(state, keys=keys, shards=shards, filtered=(_put(_built(state.counts, shards), "line-filters", 0),))


def _changed(state: State, delta: DataFrame) -> State:
    """The new state; filters change by the keys that became shared or ceased to be.

    delta: line_key, docs, holder and `was`, the number of documents before; zeros for none.
    """
    delta, version = settle(delta, "line-delta"), state.version
    counted = _put(delta.select("line_key", "docs", "holder"), "line-counts", version)
    more = delta.agg(F.sum((F.col("was") == 0).cast("long") - (F.col("docs") == 0).cast("long"))).first()[0] or 0
    keys, shards = state.keys + more, state.shards
    while keys > shards * state.shard_keys:
        shards *= 2
    after = replace(state, counted=(*state.counted, counted), keys=keys, shards=shards)
    if shards != state.shards:
        return _merged(replace(after, filtered=(_put(_built(after.counts, shards), "line-filters", version),)))
    moved = delta.select("line_key", (F.col("docs") > 1).alias("is"), (F.col("was") > 1).alias("before")).filter(F.col("is") != F.col("before"))
    moved = settle(_hashed(moved, shards, "is"), "line-moved")

    def update(old: pa.Table, change: pa.Table) -> pa.Table:
        from .cuckoo import Cuckoo

        h, inserted = change["h"].to_numpy(), change["is"].to_numpy()
        kept = Cuckoo.load(old["data"][0].as_py()) if old.num_rows else Cuckoo(max(4, len(h)))
        kept.delete(h[~inserted])
        data = kept.dump() if kept.insert(h[inserted]) else None
        return pa.table({"shard": change["shard"][:1], "data": pa.array([data], pa.binary())})

    touched = state.filters_of(moved.select("shard").distinct())
    filters = settle(touched.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(update, "shard long, data binary"), "line-filters")
    overfull = filters.filter("data is null").select("shard")
    anew = _built(after.counts.join(overfull, _shard(shards) == F.col("shard"), "left_semi"), shards)
    filtered = _put(filters.filter("data is not null").unionByName(anew), "line-filters", version)
    return _merged(replace(after, filtered=(*state.filtered, filtered)))


def _merged(state: State, parts: int | None = None) -> State:
    """The same state with every table of more than `parts` folders written as one."""
    parts = PARTS if parts is None else parts
    if len(state.held) + len(state.gone) > parts:
        state = replace(state, held=(_put(state.references, "line-references", state.version),), gone=())
    if len(state.counted) > parts:
        state = replace(state, counted=(_put(state.counts, "line-counts", state.version),))
    if len(state.filtered) > parts:
        state = replace(state, filtered=(_put(state.filters, "line-filters", state.version),))
    return state


def insert(state: State, docs: DataFrame, key: str = "doc_id", text: str = "text") -> State:
    """The state with more documents; references that a document holds already count once."""
    version = state.version + 1
    found = settle(_references(docs, key, text, state.min_chars), "line-found")
    held = state.references.join(found.select("doc").distinct(), "doc", "left_semi")
    new = _put(found.join(held, ["doc", "line_key"], "left_anti"), "line-references", version)
    gained = settle(_counts(state.spark.read.schema(REFERENCES).parquet(new)), "line-gained")
    old = state.counts_of(gained.select("line_key")).withColumnsRenamed({"docs": "was", "holder": "first"})
    delta = gained.join(old, "line_key", "left").select("line_key", (F.col("docs") + F.coalesce("was", F.lit(0))).alias("docs"), F.least("holder", "first").alias("holder"), F.coalesce("was", F.lit(0)).alias("was"))
    return _changed(replace(state, held=(*state.held, new), version=version), delta)


def delete(state: State, docs: DataFrame, key: str = "doc_id") -> State:
    """The state without the named documents; keys no document holds any more are gone."""
    ids = settle(docs.select(_doc(key).alias("doc")).distinct(), "line-deletions")
    touched = settle(state.references.join(ids, "doc", "left_semi").select("line_key").distinct(), "line-touched")
    version = state.version + 1
    after = replace(state, gone=(*state.gone, _put(ids, "line-gone", version)), version=version)
    left = settle(_counts(after.references.join(touched, "line_key", "left_semi")), "line-left")
    old = state.counts_of(touched).select("line_key", F.col("docs").alias("was"), F.col("holder").alias("first"))
    delta = old.join(left, "line_key", "left").select("line_key", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("holder", "first").alias("holder"), "was")
    return _changed(after, delta)


def _suspects(state: State, group_rows: int) -> DataFrame:
    """References whose key the filter of its shard knows: all shared ones and few others.

    Shards with many references, such as that of a line in every third document, are
    dealt out by document, so no group has more than about `group_rows`.
    """
    keyed = _hashed(state.references, state.shards, "doc", "line_key")
    sizes = keyed.groupBy("shard").agg(F.ceil(F.count("*") / group_rows).cast("long").alias("parts"))
    sized = settle(state.filters.join(sizes, "shard"), "line-shards")
    known = sized.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "data")
    dealt = keyed.join(sized.select("shard", "parts"), "shard").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))

    def look(refs: pa.Table, filters: pa.Table) -> pa.Table:
        from .cuckoo import Cuckoo

        refs = refs.select(["h", "doc", "line_key"])
        if not refs.num_rows or not filters.num_rows:
            return refs.select(["doc", "line_key"]).slice(0, 0)
        found = Cuckoo.load(filters["data"][0].as_py()).contains(refs["h"].to_numpy())
        return refs.select(["doc", "line_key"]).filter(pa.array(found))

    return dealt.groupBy("shard", "part").cogroup(known.groupBy("shard", "part")).applyInArrow(look, "doc long, line_key binary")


def doomed(state: State, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per document that loses lines: doc and the keys of those lines."""
    shared = state.counts.filter("docs > 1").select("line_key", "holder")
    lost = _suspects(state, group_rows).join(shared, "line_key").filter("doc > holder")
    return lost.groupBy("doc").agg(F.collect_set("line_key").alias("keys"))


def dedup(docs: DataFrame, state: State | None = None, key: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every row of docs with its text less the lines that other documents hold before it.

    Without a state, that of docs itself is used. n_lines and n_dropped name added
    columns; columns of docs by these names are replaced.
    """
    state = state or start(docs, key, text)
    doc, keys, held = unused(docs, "doc", "keys", "held")
    lost = settle(doomed(state, group_rows), "line-doomed").select(F.col("doc").alias(doc), F.col("keys").alias(keys))
    found = docs.withColumn(doc, _doc(key)).join(lost, doc, "left")
    all_lines = lines(F.col(text))
    kept = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(F.col(keys), line_key(x, state.min_chars)), F.lit(False)))
    found = found.withColumn(held, F.when(F.col(keys).isNotNull(), kept))
    return found.withColumns(
        {
            n_lines: F.size(all_lines).cast("long"),
            n_dropped: F.coalesce(F.size(all_lines) - F.size(held), F.lit(0)).cast("long"),
            text: F.when(F.col(held).isNull(), F.col(text)).otherwise(F.array_join(held, "\n")),
        }
    ).drop(doc, keys, held)
