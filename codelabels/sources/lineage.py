"""A lasting index of branching histories: a page of older commits without walking them.

First parents form a forest. It is cut into chains: of a commit's children the one
with the longest line of descendants continues its chain, each other child begins
one of its own. A commit's place is (chain, depth), its depth being the number of
first parents below it. From a place all smaller depths of its chain are reached.
What else is reached is said by links, kept at merges and at the lower ends of
chains, so the index grows with the history and not with pairs of chains.

A page then needs no commits to be followed: per chain, the greatest depth reached
is raised along links until nothing rises. Each link is looked at once, and there
are as many rounds as branches nest.

Commits that come later stand on top of earlier ones, so places never change:
a new commit continues a chain at its upper end or begins one. Only where a parent
arrives after its child is a repository placed anew. Versions are manifests.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import fresh_path, scratch, settle
from . import manifest
from .manifest import Version

COMMIT = ["repo_name", "sha"]
PLACE = ["chain", "depth"]
LINK = StructType([StructField("rank", LongType()), StructField("chain", StringType()), StructField("depth", LongType())])
INDEX = StructType(
    [
        StructField("repo_name", StringType()),
        StructField("sha", StringType()),
        StructField("chain", StringType()),
        StructField("depth", LongType()),
        StructField("links", ArrayType(LINK)),
        StructField("parent_shas", ArrayType(StringType())),
        StructField("missing", ArrayType(StringType())),
    ]
)


def extend(spark: SparkSession, table: str, log: DataFrame) -> Version:
    """Places the commits of ``log`` that the index lacks.

    Rows without repository or sha are left out; of rows with the same key the smallest
    list of parents holds. Parents that are nowhere are as good as none until they
    arrive. Parents that lead in a circle are an error and leave the index as it was.
    """

    def build(now: Version | None) -> Version | None:
        with scratch(spark, "lineage"):
            return _extended(spark, table, now, log)

    return manifest.commit(spark, table, build)


def _extended(spark: SparkSession, table: str, now: Version | None, log: DataFrame) -> Version | None:
    parents = F.coalesce("parent_shas", F.array().cast("array<string>"))
    rows = log.where(F.col("repo_name").isNotNull() & F.col("sha").isNotNull()).select(*COMMIT, parents.alias("parent_shas"))

    def single(some: DataFrame) -> DataFrame:
        return some.groupBy(*COMMIT).agg(F.min("parent_shas").alias("parent_shas"))

    late = None
    if now is None:
        now = Version(0, INDEX.json(), "repo_name")
        known, fresh = spark.createDataFrame([], INDEX), settle(single(rows), "commits")
    else:
        stored = _of(manifest.read(spark, table, now.number), rows)
        # What is stored drops out first, so that only new commits are grouped and written.
        fresh = settle(single(rows.join(stored.select(*COMMIT), COMMIT, "left_anti")), "new")
        awaited = stored.select("repo_name", F.explode("missing").alias("sha"))
        late = settle(awaited.join(fresh.select(*COMMIT), COMMIT, "left_semi").select("repo_name").distinct(), "late")
        known = stored.join(late, "repo_name", "left_anti")
        again = stored.join(late, "repo_name", "left_semi").select(*COMMIT, "parent_shas")
        fresh = settle(fresh.unionByName(again), "fresh")
    if fresh.isEmpty():
        return now if now.number else replace(now, number=1)
    part = manifest.write_part(table, _placed(known, fresh).select(*INDEX.names), partition="repo_name")
    gone = ()
    if late is not None and not late.isEmpty():
        gone = (manifest.write_part(table, late, "gone"),)
    return replace(now, parts=(*now.parts, *gone, part))


def _of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted repositories; few names become literals, which prune partitions."""
    names = wanted.select("repo_name").distinct()
    few = names.limit(manifest.FEW + 1).collect()
    if len(few) <= manifest.FEW:
        return rows.where(F.col("repo_name").isin([r[0] for r in few]))
    return rows.join(names, "repo_name", "left_semi")


def _placed(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index rows of the commits in ``fresh``, none of which is in ``known``."""
    nodes = known.select("repo_name", F.col("sha").alias("parent"), *PLACE, F.lit(False).alias("is_new")).unionByName(
        fresh.select("repo_name", F.col("sha").alias("parent"), F.lit(None).cast("string").alias("chain"),
                     F.lit(None).cast("long").alias("depth"), F.lit(True).alias("is_new"))
    )
    edges = fresh.select(*COMMIT, F.posexplode("parent_shas").alias("rank", "parent")).where(F.col("parent").isNotNull())
    edges = settle(edges.join(nodes, ["repo_name", "parent"], "left"), "edges")

    forest = _measured(fresh, edges)
    places = settle(forest.join(_chains(known, forest, edges), ["repo_name", "tip"]).select(*COMMIT, *PLACE), "places")

    above = edges.join(places.select(*COMMIT, F.col("chain").alias("_own")), COMMIT)
    of_new = places.select("repo_name", F.col("sha").alias("parent"), F.col("chain").alias("_chain"), F.col("depth").alias("_depth"))
    ends = above.join(of_new, ["repo_name", "parent"], "left").select(
        *COMMIT, "rank", "parent", "_own", F.coalesce("chain", "_chain").alias("chain"), F.coalesce("depth", "_depth").alias("depth")
    )
    crosses = F.col("chain").isNotNull() & ((F.col("rank") > 0) | (F.col("chain") != F.col("_own")))
    link = F.struct(F.col("rank").cast("long").alias("rank"), *PLACE)
    # A row's parents come back together: no list is longer than the commit's own.
    gathered = ends.groupBy(*COMMIT).agg(
        F.sort_array(F.collect_list(F.when(crosses, link))).alias("links"),
        F.collect_list(F.when(F.col("chain").isNull(), F.col("parent"))).alias("missing"),
    )
    placed = places.join(gathered, COMMIT, "left").join(fresh, COMMIT)
    for name in ("links", "missing"):
        placed = placed.withColumn(name, F.coalesce(name, F.array().cast(INDEX[name].dataType)))
    return placed


def _measured(fresh: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth of each new commit and the ``tip`` (a number) of the longest line of new commits above it.

    By doubling: after k rounds a row knows the commit 2^k first parents below and
    the highest line within fewer than 2^k steps above.
    """
    # Names move once; the rounds work on numbers.
    named = settle(fresh.select(*COMMIT).withColumn("id", F.monotonically_increasing_id()), "numbered")
    first = edges.where("rank = 0").select(*COMMIT, "parent", "is_new", F.col("depth").alias("_depth"))
    below = named.select("repo_name", F.col("sha").alias("parent"), F.col("id").alias("below"))
    first = first.join(below, ["repo_name", "parent"], "left").select(*COMMIT, "is_new", "_depth", "below")
    state = named.join(first, COMMIT, "left").select(
        "id",
        F.when(F.col("is_new"), F.col("below")).alias("below"),
        F.when(F.col("is_new"), F.lit(1)).otherwise(F.coalesce(F.col("_depth") + 1, F.lit(0))).cast("long").alias("depth"),
        F.struct(F.lit(0).cast("long").alias("height"), F.col("id").alias("tip")).alias("high"),
    )
    state = settle(state, "forest")
    most = fresh.count().bit_length()
    for turn in range(most + 1):
        open_rows = state.where(F.col("below").isNotNull())
        if open_rows.isEmpty():
            return named.join(state, "id").select(*COMMIT, "depth", F.col("high.height").alias("height"), F.col("high.tip").alias("tip"))
        higher = F.struct((F.col("high.height") + (1 << turn)).alias("height"), F.col("high.tip").alias("tip"))
        lines = open_rows.groupBy(F.col("below").alias("id")).agg(F.max(higher).alias("_high"))
        under = state.select(F.col("id").alias("below"), F.col("below").alias("_below"), F.col("depth").alias("_depth"))
        state = settle(
            state.join(under, "below", "left").join(lines, "id", "left").select(
                "id",
                F.col("_below").alias("below"),
                (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                F.greatest("high", F.coalesce("_high", "high")).alias("high"),
            ),
            "forest",
        )
    raise ValueError("the parents of a commit lead back to it")


def _chains(known: DataFrame, forest: DataFrame, edges: DataFrame) -> DataFrame:
    """The chain of each line of new commits: a known one that it continues, or one named after its lowest commit."""
    lines = forest.groupBy("repo_name", "tip").agg(F.min_by("sha", "depth").alias("sha"), F.max("height").alias("height"))
    lines = settle(lines, "lines")
    tops = known.groupBy("repo_name", "chain").agg(F.max("depth").alias("depth"))
    onto = edges.where("rank = 0 and not is_new").select(*COMMIT, *PLACE)
    heirs = lines.join(onto, COMMIT).join(tops, ["repo_name", *PLACE])
    heir = F.max_by("tip", F.struct("height", "tip")).alias("tip")
    continued = heirs.groupBy("repo_name", "chain").agg(heir)
    named = lines.join(continued, ["repo_name", "tip"], "left")
    return settle(named.select("repo_name", "tip", F.coalesce("chain", "sha").alias("chain")), "chains")


def older(spark: SparkSession, table: str, log: DataFrame, cursors: DataFrame) -> DataFrame:
    """The rows of ``log`` reachable from the first parent of each cursor, by the index.

    ``cursors`` has (repo_name, sha); unknown ones reach nothing. Commits that the
    index lacks are not found: :func:`extend` it first. Repeated rows stay repeated.
    """
    cursors = settle(cursors.select(*COMMIT).distinct(), "cursors")
    index = _of(manifest.read(spark, table), cursors)
    links = index.where(F.size("links") > 0).select("repo_name", *PLACE, F.explode("links").alias("link"))
    links = settle(links, "links")

    to_first = F.get(F.filter("links", lambda x: x["rank"] == 0), F.lit(0))
    below = F.struct(F.col("chain"), (F.col("depth") - 1).alias("depth"))
    start = F.when(to_first.isNotNull(), F.struct(to_first["chain"].alias("chain"), to_first["depth"].alias("depth"))).when(F.col("depth") > 0, below)
    starts = index.join(cursors, COMMIT, "left_semi").select("repo_name", start.alias("at")).where(F.col("at").isNotNull())
    risen = starts.groupBy("repo_name", F.col("at.chain").alias("chain")).agg(F.max("at.depth").alias("depth"))
    frontier = settle(risen.withColumn("before", F.lit(-1).cast("long")), "frontier")

    visited = fresh_path(spark, "visited")
    while True:
        frontier.select("repo_name", *PLACE).write.mode("append").parquet(visited)
        reached = spark.read.schema(frontier.select("repo_name", *PLACE).schema).parquet(visited)
        reached = reached.groupBy("repo_name", "chain").agg(F.max("depth").alias("reached"))
        if frontier.isEmpty():
            break
        upto = frontier.select("repo_name", "chain", F.col("depth").alias("upto"), "before")
        used = links.join(upto, ["repo_name", "chain"]).where("depth <= upto and depth > before")
        risen = used.groupBy("repo_name", F.col("link.chain").alias("chain")).agg(F.max("link.depth").alias("depth"))
        risen = risen.join(reached, ["repo_name", "chain"], "left").where("reached is null or depth > reached")
        frontier = settle(risen.select("repo_name", *PLACE, F.coalesce("reached", F.lit(-1)).cast("long").alias("before")), "frontier")

    reached = settle(reached, "reached")
    found = index.select(*COMMIT, *PLACE).join(reached, ["repo_name", "chain"]).where("depth <= reached")
    return _of(log, cursors).join(found.select(*COMMIT), COMMIT, "left_semi")
