"""The course of an analysis run: order, progress, failure, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stem
from ..functions.values import iso, progress
from ..schemas import DONE_MESSAGE, NO_COMMITS, STATUS_DONE, STATUS_ERROR, STATUS_RUNNING
from ..session import settle
from .ranking import number_within
from .results import last_per_stem, without_analysed


def unnumbered_files(
    contributions: DataFrame,
    results: DataFrame,
    by: str = "sha",
    content_complete: bool = False,
    requested: DataFrame | None = None,
    scored: DataFrame | None = None,
) -> DataFrame:
    """Files a run will score: seq, and the place their name first took.

    Works on narrow columns throughout. Contributions without text cannot
    become files and do not replace an earlier one of the same name; pass
    ``content_complete=True`` when the table has none (the extraction never
    writes any), which spares reading the text column here. ``requested`` keeps
    the repositories it names (``repo_name``), ``scored`` names contributions
    (``seq``) to leave out whatever their commit.
    """
    rows = contributions.where(F.col("temp_filepath").isNotNull())
    if not content_complete:
        rows = rows.where(F.col("file_content").isNotNull())
    narrow = rows.select("seq", "repo_name", "sha", "temp_filepath")
    if requested is not None:
        narrow = narrow.join(requested.select("repo_name"), "repo_name", "left_semi")
    if scored is not None:
        narrow = narrow.join(scored.select("seq"), "seq", "left_anti")
    named = without_analysed(narrow, results, by).select(
        "seq", "repo_name", stem(F.col("temp_filepath")).alias("filename")
    )
    return last_per_stem(named)


def pending_files(
    contributions: DataFrame,
    results: DataFrame,
    by: str = "sha",
    content_complete: bool = False,
    requested: DataFrame | None = None,
    scored: DataFrame | None = None,
) -> DataFrame:
    """The files of :func:`unnumbered_files` with their place in the run (``done``) and its length."""
    files = unnumbered_files(contributions, results, by, content_complete, requested, scored)
    return number_within(files, "repo_name", "run_order", "done", "total")


def with_text(pending: DataFrame, contributions: DataFrame) -> DataFrame:
    """Fetch each pending file's text and spread it by its unique number.

    If few files are pending Spark may broadcast them, and only their texts are
    shuffled; otherwise the join shuffles by the same key and Spark drops the
    repartitioning as redundant. Either way a text moves once, a hot repository
    is spread, and folding the file's windows needs no further exchange.
    """
    texts = contributions.select("seq", "author", "timestamp", "sha", "file_content")
    return texts.join(pending, "seq").repartition("seq")


def before_failure(scored: DataFrame) -> DataFrame:
    """Files of each repository's run that precede its first failing one.

    The failures are settled, so that AQE can split a large run in the join;
    a scorer that cannot fail leaves nothing to scan for them.
    """
    failed = (
        scored.where(F.col("error").isNotNull())
        .groupBy("repo_name")
        .agg(F.min("run_order").alias("_failed_at"))
    )
    joined = scored.join(settle(failed, "failed"), "repo_name", "left")
    kept = F.col("_failed_at").isNull() | (F.col("run_order") < F.col("_failed_at"))
    return joined.where(kept).drop("_failed_at", "error")


def with_progress(scored: DataFrame) -> DataFrame:
    return scored.withColumn("progress", progress(F.col("done"), F.col("total")))


def file_events(saved: DataFrame, url: Column) -> DataFrame:
    """One event per saved file; ``event_order`` is its place in the run."""
    data = F.struct(
        "filename",
        "author",
        iso(F.col("timestamp")).alias("timestamp"),
        "sha",
        F.col("detected").alias("detected_kus"),
        "elapsed_time",
        url.alias("repoUrl"),
    )
    body = F.struct(progress(F.col("done"), F.col("total")).alias("progress"), data.alias("file_data"), url.alias("repoUrl"))
    return saved.select("repo_name", F.col("done").alias("event_order"), F.to_json(body, {"ignoreNullFields": "false"}).alias("event"))


def closing_events(runs: DataFrame, url: Column) -> DataFrame:
    """The last event of each run, from one row per repository.

    ``runs`` has repo_name, total, and error with failed_at for stopped runs.
    """
    done = F.to_json(F.struct(F.lit(100).alias("progress"), F.lit(DONE_MESSAGE).alias("message"), url.alias("repoUrl")))
    failed = F.to_json(F.struct(F.col("error"), url.alias("repoUrl")))
    return runs.select(
        "repo_name",
        F.coalesce("failed_at", F.col("total") + 1).cast("bigint").alias("event_order"),
        F.when(F.col("error").isNull(), done).otherwise(failed).alias("event"),
    )


def run_summary(scored: DataFrame) -> DataFrame:
    """Per repository: files in the run, and the first failure with its place."""
    failed = F.col("error").isNotNull()
    return scored.groupBy("repo_name").agg(
        F.max("total").alias("total"),
        F.min(F.when(failed, F.col("done"))).alias("failed_at"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("done"))).alias("error"),
    )


def requested_runs(requested: DataFrame, contributions: DataFrame) -> DataFrame:
    """Per requested repository: has it any contributions?"""
    known = contributions.select("repo_name").distinct().withColumn("has_commits", F.lit(True))
    asked = requested.select("repo_name").where(F.col("repo_name").isNotNull()).distinct()
    return asked.join(known, "repo_name", "left").select("repo_name", F.coalesce("has_commits", F.lit(False)).alias("has_commits"))


def every_run(asked: DataFrame, summary: DataFrame) -> DataFrame:
    """The summary of each requested run, also of those with nothing to do.

    A repository without contributions has an error and no run.
    """
    joined = asked.join(summary, "repo_name", "left")
    missing = F.when(~F.col("has_commits"), F.lit(NO_COMMITS))
    return joined.select(
        "repo_name",
        "has_commits",
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        "failed_at",
        F.coalesce("error", missing).alias("error"),
    )


def _status(seq: Column, status: Column, started: Column, ended: Column | None = None, percent: Column | None = None, error: Column | None = None) -> list[Column]:
    return [
        seq.cast("bigint").alias("seq"),
        F.col("repo_name"),
        status.alias("status"),
        started.cast("timestamp_ntz").alias("start_time"),
        (F.lit(None) if ended is None else ended).cast("timestamp_ntz").alias("end_time"),
        (F.lit(None) if percent is None else percent).cast("int").alias("progress"),
        (F.lit(None) if error is None else error).cast("string").alias("error_message"),
    ]


def opening_status(runs: DataFrame, started: Column, first_seq: Column) -> DataFrame:
    """Status-log entries written before a run's files are scored."""
    return runs.select(*_status(first_seq, F.lit(STATUS_RUNNING), started, percent=F.lit(0)))


def rising_status(saved: DataFrame, started: Column, first_seq: Column) -> DataFrame:
    """One entry per saved file with the share that is done."""
    share = progress(F.col("done"), F.col("total"))
    return saved.select(*_status(first_seq + F.col("done"), F.lit(STATUS_RUNNING), started, percent=share))


def closing_status(runs: DataFrame, started: Column, ended: Column, last_seq: Column) -> DataFrame:
    failed = F.col("error").isNotNull()
    status = F.when(failed, STATUS_ERROR).otherwise(STATUS_DONE)
    return runs.select(*_status(last_seq, status, started, ended, F.when(~failed, 100), F.col("error")))


def status_rows(runs: DataFrame, started: Column, ended: Column, first_seq: Column) -> DataFrame:
    """Status-log entries that open and close each run."""
    return opening_status(runs, started, first_seq).unionByName(closing_status(runs, started, ended, first_seq + 1))
