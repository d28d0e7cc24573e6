"""Mixing sources to target weights under a token budget.

Weights stand at three levels: domain, language, source. The budget is handed down:
each node shares its own among its children in proportion to their weights. A child can
take no more than its tokens times the largest number of epochs; what it leaves goes to
its siblings, again by weight, until all are full, and only what a whole branch cannot
take was never given to it: branches know their capacity, so their shortage has already
gone to their own siblings. Shares are whole tokens, rounded down.

A leaf (domain, language, source) spends its budget on passes over its documents. Each
epoch has an order of its own, from a hash of seed, epoch and key. Whole epochs take
every document; the last one takes documents in order while their tokens fit.

The order's prefix is found without sorting a leaf: tokens are summed per leaf and hash
bucket; the one bucket in which the budget ends is cut into 4,096 again, and only the
one of these in which it ends is looked at row by row. Equal rows are one there.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import unused

LEVELS = ("domain", "language", "source")
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Targets:
    """Whole weights by name and level; `rest` is that of names which are not listed (zero leaves them out)."""

    domain: Mapping[str, int]
    language: Mapping[str, int]
    source: Mapping[str, int]
    rest: int = 1

    def of(self, level: str) -> Column:
        given: Mapping[str, int] = getattr(self, level)
        if not given:
            return F.lit(self.rest).cast("long")
        table = F.create_map(*(F.lit(x) for pair in given.items() for x in pair))
        return F.coalesce(table[F.col(level)], F.lit(self.rest)).cast("long")


def n_words(text: Column) -> Column:
    """Words as a measure of tokens; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _share(nodes: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Adds `budget`: the node's part of `given`, the budget of its parent.

    Children are taken in order of capacity per weight. A child is full if its
    share of what the earlier ones left would exceed its capacity.
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(19,0)")
    sums = nodes.withColumns(
        {
            "total": F.sum("weight").over(group),
            "w": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "c": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "given": F.least(F.col("given"), F.sum("capacity").over(group)),
        }
    )
    full = wide(F.col("capacity")) * wide(F.col("total") - F.col("w")) <= wide(F.col("weight")) * wide(F.greatest(F.col("given") - F.col("c"), F.lit(0)))
    sums = sums.withColumn("full", full)
    sums = sums.withColumns({"fc": F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)), "fw": F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(group), F.lit(0))})
    part = F.expr("(cast(weight as decimal(19,0)) * cast(given - fc as decimal(19,0))) div cast(nullif(total - fw, 0) as decimal(19,0))")
    return sums.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.least(part, F.col("capacity")))).drop("total", "w", "c", "full", "fc", "fw", "given")


def budgets(leaves: DataFrame, targets: Targets, budget: int, max_epochs: int) -> DataFrame:
    """Per leaf with a positive weight: domain, language, source, tokens, budget.

    leaves: domain, language, source, tokens; one row per leaf, so this table is as
    large as the tree, not as the corpus.
    """
    weighed = leaves.withColumns({f"{level}_weight": targets.of(level) for level in LEVELS}).filter(" and ".join(f"{level}_weight > 0" for level in LEVELS))
    weighed = weighed.withColumn("capacity", F.col("tokens") * max_epochs)
    level = weighed.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.first("domain_weight").alias("weight"))
    top = _share(level.withColumns({"top": F.lit(0), "given": F.lit(budget).cast("long")}), ("top",), "domain").select("domain", F.col("budget").alias("given"))
    level = weighed.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"), F.first("language_weight").alias("weight"))
    middle = _share(level.join(top, "domain"), ("domain",), "language").select("domain", "language", F.col("budget").alias("given"))
    level = weighed.withColumn("weight", F.col("source_weight")).join(middle, ["domain", "language"])
    return _share(level, ("domain", "language"), "source").select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _place(key: Column, seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def _bucket(place: Column, level: int = 0) -> Column:
    return F.substring(place, 1 + 3 * level, 3)


def _end(sums: DataFrame, room: str) -> DataFrame:
    """Per leaf the bucket in which its tokens go beyond `room`, and what is left of it there.

    sums: leaf, room, bucket and n, at most 4,096 rows a leaf.
    """
    running = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    ends = sums.withColumn("upto", running).filter(F.col("upto") > F.col(room))
    ends = ends.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col(room) - (F.col("upto") - F.col("n"))).alias("room"))).alias("e"))
    return ends.select(*LEVELS, F.col("e.bucket").alias("cut"), F.col("e.room").alias("room"))


def plan(docs: DataFrame, targets: Targets, domain: Column, language: str = "lang", source: str = "source", key: str = "doc_id", text: str = "text", budget: int | None = None, max_epochs: int = 4, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(marked, leaves). marked: key, leaf and tokens of every row. leaves: per leaf its
    budget, `whole` epochs, and where the prefix of the next one ends (cut, place, last).

    budget: tokens in all; that of the corpus by default. A null domain, language or
    source counts as the empty name.
    """
    marked = docs.select(F.col(key).alias("id"), _named(domain).alias("domain"), _named(F.col(language)).alias("language"), _named(F.col(source)).alias("source"), n_words(F.col(text)).alias("n_tokens"))
    marked = settle(marked, "mix-marked")
    totals = settle(marked.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-totals")
    if budget is None:
        budget = totals.agg(F.sum("tokens")).first()[0] or 0
    shared = budgets(totals, targets, budget, max_epochs)
    whole = F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0))
    shared = settle(shared.withColumn("whole", whole).withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-leaves")
    placed = marked.join(shared.select(*LEVELS, "whole", "left"), list(LEVELS)).withColumn("place", _place(F.col("id"), seed, F.col("whole") + 1)).withColumn("bucket", _bucket(F.col("place")))
    sums = placed.groupBy(*LEVELS, "left", "bucket").agg(F.sum("n_tokens").alias("n"))
    ends = settle(_end(sums, "left"), "mix-cuts")
    near = placed.join(ends, [*LEVELS]).filter("bucket = cut").groupBy(*LEVELS, "room", "place", "id", "n_tokens").agg(F.count("*").alias("rows"))
    near = settle(near.withColumn("bucket", _bucket(F.col("place"), 1)), "mix-near")
    fine = settle(_end(near.groupBy(*LEVELS, "room", "bucket").agg(F.sum(F.col("n_tokens") * F.col("rows")).alias("n")), "room"), "mix-ends")
    near = near.drop("room").join(fine, [*LEVELS])
    order = Window.partitionBy(*LEVELS).orderBy("place", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    # Equal rows are taken if the first of them fits.
    before = F.coalesce(F.sum(F.col("n_tokens") * F.col("rows")).over(order), F.lit(0))
    inner = near.filter("bucket = cut").withColumn("before", before).filter("before + n_tokens <= room")
    last = near.filter("bucket < cut").select(*LEVELS, "place", "id", "n_tokens").unionByName(inner.select(*LEVELS, "place", "id", "n_tokens"))
    last = last.groupBy(*LEVELS).agg(F.max(F.struct("place", "id", "n_tokens")).alias("last"))
    leaves = shared.join(ends, list(LEVELS), "left").join(last, list(LEVELS), "left")
    return marked, settle(leaves.select(*LEVELS, "tokens", "budget", "whole", "cut", "last"), "mix-plan")


def _copies(leaf: Column, key: Column, tokens: Column, seed: int) -> Column:
    place = _place(key, seed, leaf["whole"] + 1)
    within = F.struct(place.alias("place"), key.alias("id"), tokens.alias("n_tokens")) <= leaf["last"]
    # A leaf without an end is one without tokens: all of it fits.
    more = F.when(leaf["cut"].isNull(), F.lit(True)).otherwise((_bucket(place) < leaf["cut"]) | ((_bucket(place) == leaf["cut"]) & F.coalesce(within, F.lit(False))))
    return F.coalesce(leaf["whole"] + more.cast("long"), F.lit(0).cast("long"))


def copies(marked: DataFrame, leaves: DataFrame, seed: int = 7) -> DataFrame:
    """Per row: id, leaf, n_tokens and copies, the number of times the mixture holds it."""
    leaf = F.struct(*(F.col(f"l.{c}") for c in ("whole", "cut", "last")))
    same = [F.col(f"m.{c}") == F.col(f"l.{c}") for c in LEVELS]
    found = marked.alias("m").join(leaves.alias("l"), same, "left")
    return found.select("m.id", *(f"m.{c}" for c in LEVELS), "m.n_tokens", _copies(leaf, F.col("m.id"), F.col("m.n_tokens"), seed).alias("copies"))


def mixed(docs: DataFrame, targets: Targets, domain: Column, language: str = "lang", source: str = "source", key: str = "doc_id", text: str = "text", budget: int | None = None, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mixture holds it; texts are not shuffled."""
    _, leaves = plan(docs, targets, domain, language, source, key, text, budget, max_epochs, seed)
    *names, leaf, turn = unused(docs, *LEVELS, "leaf", "turn")
    packed = leaves.select(*(F.col(a).alias(b) for a, b in zip(LEVELS, names, strict=True)), F.struct("whole", "cut", "last").alias(leaf))
    here = docs.withColumns(dict(zip(names, (_named(domain), _named(F.col(language)), _named(F.col(source))), strict=True)))
    found = here.join(packed, names)
    times = _copies(F.col(leaf), F.col(key), n_words(F.col(text)), seed)
    # An empty sequence drops the row.
    turns = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))
    return found.select(*(F.col(c) for c in docs.columns), F.explode(turns).alias(turn)).drop(turn)
