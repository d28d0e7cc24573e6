"""Choosing commits: limits, pages, known shas, file types, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import has_type, relevant_path
from ..schemas import ACTIVE_DAYS, FILE_TYPE, HISTORY_PAGE
from ..session import fresh_path, settle
from .ranking import first_within

COMMIT = ["repo_name", "sha"]


def newest_commits(log: DataFrame, limit: int | None = None, skip: int = 0) -> DataFrame:
    """Each repository's latest commits; the limit counts merges and known ones too."""
    return first_within(log, "repo_name", "ordinal", limit, skip)


def without_stored(log: DataFrame, stored: DataFrame) -> DataFrame:
    """Commits no stored contribution of the same repository belongs to."""
    return log.join(stored.select(*COMMIT).distinct(), COMMIT, "left_anti")


def without_merges(log: DataFrame) -> DataFrame:
    """Ordinary and root commits, the latter flagged; merges are dropped."""
    parents = F.coalesce(F.size("parent_shas"), F.lit(0))
    return log.where(parents <= 1).withColumn("is_root", parents == 0)


def touching(log: DataFrame, patches: DataFrame, file_type: str = FILE_TYPE) -> DataFrame:
    """Commits, merges included, that changed a file of the type."""
    path = relevant_path(F.col("a_path"), F.col("b_path"))
    # Distinct first: map tasks reduce a commit of very many files to one row.
    changed = patches.where(has_type(path, file_type)).select(*COMMIT).distinct()
    return log.join(changed, COMMIT, "left_semi")


def recent_history(log: DataFrame, patches: DataFrame, page: int = HISTORY_PAGE) -> DataFrame:
    """The newest page, then only commits touching the file type.

    The page is settled: patches are filtered by its few commits where they lie.
    """
    chosen = settle(newest_commits(log, page), "page")
    return touching_few(chosen, patches)


def touching_few(chosen: DataFrame, patches: DataFrame) -> DataFrame:
    """:func:`touching` for settled commits: patches are filtered by them where they lie if they are few."""
    return touching(chosen, patches.join(chosen.select(*COMMIT), COMMIT, "left_semi"))


def older_than(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Next page of linear histories: everything after each cursor commit.

    ``cursors`` has one (repo_name, sha) per repository.
    """
    marks = log.join(cursors.select(*COMMIT), COMMIT, "left_semi").select(
        "repo_name", F.col("ordinal").alias("_mark")
    )
    return log.join(marks, "repo_name").where(F.col("ordinal") > F.col("_mark")).drop("_mark")


def first_active_days(log: DataFrame, days: int = ACTIVE_DAYS) -> DataFrame:
    """Commits of the first days of each calendar month that have any."""
    day = F.to_date("committed_at")
    # One row per active day, so the window below never sees commits.
    active = log.select("repo_name", day.alias("_day")).distinct()
    month = Window.partitionBy("repo_name", F.trunc("_day", "month")).orderBy("_day")
    chosen = active.withColumn("_rank", F.row_number().over(month)).where(F.col("_rank") <= days)
    dated = log.withColumn("_day", day)
    return dated.join(chosen.select("repo_name", "_day"), ["repo_name", "_day"], "left_semi").drop("_day")


def ancestors(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Commits reachable from the first parent of each cursor, for branching histories.

    Walking parent by parent would take a job per generation. First parents
    form chains, so tables of 1, 2, 4, ... steps are built by joining each with
    itself; applying them in turn follows a chain of any length in a logarithmic
    number of joins. Other parents of commits found so start the next round, and
    there are as many rounds as merges nest. Only the cursors' repositories take
    part, and one growing table holds what has been reached. Parents that lead in
    a circle are an error.
    """
    spark = log.sparkSession
    repos = settle(cursors.select("repo_name").distinct(), "cursor-repositories")
    ours = log.join(repos, "repo_name", "left_semi").where(F.col("repo_name").isNotNull() & F.col("sha").isNotNull())
    # Names move once: commits are numbered, and all rounds below work on pairs of numbers.
    named = settle(ours.select(*COMMIT).distinct().withColumn("id", F.monotonically_increasing_id()), "numbered")
    lists = ours.select(*COMMIT, "parent_shas").join(named, COMMIT)
    parents = lists.select("repo_name", "id", F.posexplode("parent_shas").alias("rank", "sha"))
    # A parent that the log lacks leads nowhere and is not in the log either.
    edges = settle(parents.join(named.withColumnRenamed("id", "parent"), COMMIT).select("id", "rank", "parent"), "edges")
    first = edges.where("rank = 0").select("id", "parent").distinct()
    others = edges.where("rank > 0").select("id", "parent")

    jumps, most = [first], named.count().bit_length()
    while True:
        if len(jumps) > most + 1:
            raise ValueError("the parents of a commit lead back to it")
        step = jumps[-1]
        onward = step.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        longer = settle(step.join(onward, "parent").select("id", F.col("_next").alias("parent")).distinct(), "steps")
        if longer.isEmpty():
            break
        jumps.append(longer)

    def follow(found: DataFrame, edge: DataFrame) -> DataFrame:
        return found.join(edge, "id").select(F.col("parent").alias("id"))

    def stay_or_step(found: DataFrame, edge: DataFrame) -> DataFrame:
        both = F.explode(F.array_compact(F.array("id", "parent")))
        return found.join(edge, "id", "left").select(both.alias("id")).distinct()

    frontier = follow(named.join(cursors.select(*COMMIT), COMMIT, "left_semi").select("id"), first)
    visited = fresh_path(spark, "visited")
    reached = settle(frontier.where("false"), "reached")
    while True:
        for table in jumps:
            frontier = stay_or_step(frontier, table)
        frontier = settle(frontier.join(reached, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            found = settle(named.join(reached, "id", "left_semi").select(*COMMIT), "found")
            return log.join(found, COMMIT, "left_semi")
        frontier.write.mode("append").parquet(visited)
        reached = spark.read.schema(frontier.schema).parquet(visited)
        frontier = follow(frontier, others).distinct().join(reached, "id", "left_anti")
