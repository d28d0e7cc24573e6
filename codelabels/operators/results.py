"""Folding window verdicts into file labels, and reads over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stem
from ..functions.values import iso, iso_or_none
from ..schemas import URL_PREFIX
from ..session import settle


def any_window(scored: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Per file, 1 for each label some window shows (``verdict``, in label order).

    One aggregate per label keeps one row per file; map tasks already merge a
    file's windows. Files without a verdict get zeros.
    """
    hits = [F.max(F.get("prediction", F.lit(i))).alias(f"_hit{i}") for i in range(len(labels))]
    extra = [
        fold(name).alias(name)
        for name, fold in (("elapsed_time", F.sum), ("error", F.min))
        if name in scored.columns
    ]
    folded = scored.groupBy(*keys).agg(*hits, *extra)
    verdict = F.array(*[F.coalesce(F.col(f"_hit{i}"), F.lit(0)) for i in range(len(labels))])
    return folded.select(*keys, verdict.alias("verdict"), *[c for c in ("elapsed_time", "error") if c in folded.columns])


def any_window_per_model(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per (model, file): did any window predict 1? Missing predictions do not count."""
    found = F.coalesce(F.bool_or(F.col("prediction") == 1), F.lit(False))
    return scored.groupBy("model", *keys).agg(found.alias("detected"))


def label_map(verdict: Column, labels: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), verdict)


def wide_labels(results: DataFrame, labels: list[str], detected: str = "detected") -> DataFrame:
    """One 0/1 column per label; a label missing from a row's map is an error.

    The values are made as one array: a column with a look-up and an error of its own
    per label makes code too long for the JVM to compile.
    """
    wanted, held = F.array(*[F.lit(x) for x in labels]), F.col(detected)
    absent = F.get(F.filter(wanted, lambda x: ~F.coalesce(F.map_contains_key(held, x), F.lit(False))), F.lit(0))
    values = F.transform(wanted, lambda x: F.when(F.try_element_at(held, x) != 0, 1).otherwise(0))
    missing = F.raise_error(F.concat(F.lit("label "), absent, F.lit(" is missing from a result"))).cast("array<int>")
    about = ["filename", "author", "timestamp", "sha"]
    rows = results.select(*about, F.when(absent.isNull(), values).otherwise(missing).alias("_values"))
    return rows.select(*about, *[F.get("_values", F.lit(i)).alias(label) for i, label in enumerate(labels)])


def analysed_keys(results: DataFrame, by: str = "sha") -> DataFrame:
    """What :func:`without_analysed` compares with, each key once, settled."""
    keys = ["sha"] if by == "sha" else ["sha", "filename"]
    return settle(results.select(*keys).distinct(), "analysed")


def without_analysed(contributions: DataFrame, results: DataFrame, by: str = "sha") -> DataFrame:
    """Contributions whose commit has no result in any repository.

    ``by="sha_file"`` also completes commits a failed run left half done.
    ``results`` may be :func:`analysed_keys` of them. A commit may hold a large
    share of the contributions; AQE splits it as long as both sides are shuffled
    as they are, so there is no distinct here.
    """
    if by == "sha":
        # A null sha equals nothing, so such rows stay.
        return contributions.join(results.select("sha"), "sha", "left_anti")
    done = results.select("sha", F.col("filename").alias("_stem"))
    named = contributions.withColumn("_stem", stem(F.col("temp_filepath")))
    return named.join(done, ["sha", "_stem"], "left_anti").drop("_stem")


def last_per_stem(rows: DataFrame) -> DataFrame:
    """Winning ``seq`` per (repo_name, filename), with the place the name first took.

    Input needs ``seq``, ``repo_name``, ``filename`` only: the aggregate moves
    two numbers per file, never its text, and a hot name shrinks map-side.
    """
    return rows.groupBy("repo_name", "filename").agg(
        F.max("seq").alias("seq"), F.min("seq").alias("run_order")
    )


def results_of(results: DataFrame, repo_name: str) -> DataFrame:
    return _result_rows(results.where(F.col("repo_name") == repo_name), iso(F.col("timestamp")))


def results_of_sha(results: DataFrame, sha: str) -> DataFrame:
    return _result_rows(results.where(F.col("sha") == sha), iso(F.col("timestamp")))


def all_results(results: DataFrame, repositories: DataFrame, prefix: str = URL_PREFIX) -> DataFrame:
    """Results of catalogued repositories under the prefix.

    No broadcast is forced: Spark broadcasts the catalogue if its size allows,
    else AQE splits the partitions of a hot repository.
    """
    wanted = repositories.where(F.col("url").startswith(prefix)).select(F.col("name").alias("repo_name"))
    return _result_rows(results.join(wanted, "repo_name"), iso_or_none(F.col("timestamp")))


def label_feed(results: DataFrame) -> DataFrame:
    return results.select(F.col("detected").alias("kus"), "author")


def result_times(results: DataFrame, repo_name: str | None = None) -> DataFrame:
    """Distinct times in ascending order as ISO text; missing ones are left out."""
    rows = results if repo_name is None else results.where(F.col("repo_name") == repo_name)
    keys = ["timestamp"] if repo_name is not None else ["repo_name", "timestamp"]
    times = rows.where(F.col("timestamp").isNotNull()).select(*keys).distinct().orderBy(*keys)
    return times.withColumn("timestamp", iso(F.col("timestamp")))


def _result_rows(rows: DataFrame, timestamp: Column) -> DataFrame:
    return rows.select(
        "filename", "author", timestamp.alias("timestamp"), "sha", F.col("detected").alias("detected_kus"), "elapsed_time"
    )
