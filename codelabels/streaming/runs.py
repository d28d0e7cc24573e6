"""An analysis run that spans many micro-batches.

Files of a run are scored batch by batch, as they arrive. What the run shows to
its readers is kept per repository by a stateful operator: which place comes
next, how many files there are, and whether the run has ended. A run opens with
its request, its progress rises file by file in the order of their places, and it
closes once: when its last file is done, or at its first failing one, after which
nothing more of it counts, in whatever batch it arrives.

Rows that arrive before their turn wait in the state as (place, file, error), no
texts. Rows that arrive again are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import runs
from ..plans import jobs
from ..schemas import STATUS_DONE, STATUS_ERROR, STATUS_RUNNING
from ..session import scratch, settle

STEP = "repo_name string, done long, total long, file long, error string"
ENTRY = "repo_name string, seq long, status string, progress int, error_message string, file long"
STATE = "next long, total long, ended boolean, early string"


def plan_run(contributions: DataFrame, stored_results: DataFrame, requested: DataFrame, by: str = "sha") -> tuple[DataFrame, DataFrame]:
    """(requests, files) of a run: repositories with their number of files, and the files' places.

    Both are narrow and settled, so all batches see one numbering.
    """
    asked = settle(runs.requested_runs(requested, contributions), "requested").where("has_commits").select("repo_name")
    files = settle(runs.pending_files(contributions, stored_results, by, requested=asked), "places")
    totals = files.groupBy("repo_name").agg(F.count(F.lit(1)).alias("total"))
    requests = asked.join(totals, "repo_name", "left").select("repo_name", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
    return settle(requests, "requests"), files


def stream_scores(contributions: DataFrame, files: DataFrame, location: str, state: str, scorer: Callable, windows: jobs.Windows = jobs.WINDOWS, wait: bool = True) -> StreamingQuery:
    """Scores the planned files among arriving contributions; failures stay in the rows.

    A batch that is done again overwrites its own folder.
    """

    def work(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession, f"scores-{number}"):
            scored = jobs.score_files(runs.with_text(files, batch), jobs.RUN_KEYS, scorer, windows)
            if "error" not in scored.columns:
                scored = scored.withColumn("error", F.lit(None).cast("string"))
            scored.write.mode("overwrite").parquet(f"{location.rstrip('/')}/batch_id={number}")

    query = contributions.writeStream.foreachBatch(work).option("checkpointLocation", state).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def stepper() -> Callable:
    """Takes a run on by the steps whose turn it is; place 0 is the request.

    Made here, so that workers get it as it is and need not import this package.
    """
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        repo = key[0]
        place, total, ended, early = state.get if state.exists else (0, 0, False, "[]")
        waiting = {step[0]: step for step in json.loads(early)}
        for rows in batches:
            for done, count, file, error in zip(rows["done"].tolist(), rows["total"].tolist(), rows["file"], rows["error"], strict=True):
                if not ended and done >= place:
                    waiting[done] = [done, count, None if pd.isna(file) else int(file), None if pd.isna(error) else error]
        out = []
        while not ended and place in waiting:
            done, count, file, error = waiting.pop(place)
            total, place = count, place + 1
            if error is not None:
                ended = True
                out.append((repo, total + 1, STATUS_ERROR, None, error, file))
                continue
            out.append((repo, done, STATUS_RUNNING, int(done / total * 100) if done else 0, None, file))
            if done == total:
                ended = True
                out.append((repo, total + 1, STATUS_DONE, 100, None, None))
        state.update((place, total, ended, json.dumps([] if ended else list(waiting.values()))))
        yield pd.DataFrame(out, columns=names, dtype=object)

    return advance


def follow_runs(steps: DataFrame) -> DataFrame:
    """Status entries of all runs, from a stream of steps (repo_name, done, total, file, error).

    A step with ``done`` 0 is a run's request, any other a scored file at that place.
    Entries are numbered within their run as a batch run numbers them: 0 opens,
    total + 1 closes. ``file`` names the file that an entry stands for.
    """
    return steps.groupBy("repo_name").applyInPandasWithState(stepper(), ENTRY, STATE, "append", GroupStateTimeout.NoTimeout)


def steps_of(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """The two streams as one: requests first in every run, then its files."""
    opening = requests.select("repo_name", F.lit(0).cast("bigint").alias("done"), "total", F.lit(None).cast("bigint").alias("file"), F.lit(None).cast("string").alias("error"))
    return opening.unionByName(scored.select("repo_name", "done", "total", F.col("seq").alias("file"), "error"))


def stream_runs(steps: DataFrame, location: str, state: str, wait: bool = True) -> StreamingQuery:
    """Writes the entries of :func:`follow_runs`, each once."""
    query = follow_runs(steps).writeStream.format("parquet").option("path", location).option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").start()
    if wait:
        query.awaitTermination()
    return query


def accepted(spark: SparkSession, scores: str, entries: DataFrame) -> DataFrame:
    """The scored files that count: those an entry of a running state names."""
    named = entries.where((F.col("status") == STATUS_RUNNING) & F.col("file").isNotNull()).select(F.col("file").alias("seq"))
    return spark.read.parquet(scores).dropDuplicates(["seq"]).join(named, "seq", "left_semi")
