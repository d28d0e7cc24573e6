"""Repository catalogue: upsert, cascade delete, status.

Each function returns new rows; the caller adds them as a new version, so no
plan overwrites what it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import iso
from ..schemas import REPOSITORIES, URL_PREFIX

DESCRIPTIVE = ["url", "description", "comments"]
STATUS_FIELDS = {
    "analysis_status": "status",
    "analysis_start_time": "start_time",
    "analysis_end_time": "end_time",
    "analysis_progress": "progress",
    "analysis_error_message": "error_message",
}


def _latest(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Last row per key by ``seq``; partial aggregation thins a hot key first."""
    newest = df.groupBy(key).agg(F.max_by(F.struct(*fields), "seq").alias("_new"))
    return newest.select(key, "_new")


def upsert_repositories(repositories: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Insert or overwrite by name; ``updates`` carries ``seq`` and the last wins.

    A field left out of an update becomes empty text. Creation time and the
    analysis columns of an existing row stay.
    """
    new = _latest(updates, "name", DESCRIPTIVE).withColumnRenamed("_new", "_update")
    joined = repositories.withColumn("_known", F.lit(True)).join(new, "name", "full_outer")
    touched = F.col("_update").isNotNull()
    columns = []
    for field in REPOSITORIES.fieldNames():
        current = F.col(field)
        if field in DESCRIPTIVE:
            given = F.coalesce(F.col(f"_update.{field}"), F.lit(""))
            current = F.when(touched, given).otherwise(current)
        elif field == "created_at":
            current = F.when(F.col("_known"), current).otherwise(now)
        elif field == "updated_at":
            current = F.when(touched, now).otherwise(current)
        columns.append(current.alias(field))
    return joined.select(*columns)


def delete_repositories(
    names: DataFrame, repositories: DataFrame, contributions: DataFrame, results: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the repositories in ``names`` (column ``name``).

    Names may repeat. There is no distinct: below the join it would keep AQE
    from splitting a repository that holds a large share of the texts.
    """
    gone = names.select("name")
    by_repo = gone.withColumnRenamed("name", "repo_name")
    return (
        repositories.join(gone, "name", "left_anti"),
        contributions.join(by_repo, "repo_name", "left_anti"),
        results.join(by_repo, "repo_name", "left_anti"),
    )


def apply_status(repositories: DataFrame, status_log: DataFrame) -> DataFrame:
    """Overwrite all five analysis columns with each repository's last entry.

    What the entry leaves out becomes null; entries of unknown repositories do
    nothing.
    """
    last = _latest(status_log, "repo_name", list(STATUS_FIELDS.values())).withColumnRenamed("repo_name", "name")
    joined = repositories.join(last, "name", "left")
    matched = F.col("_new").isNotNull()
    columns = []
    for field in REPOSITORIES.fieldNames():
        value = F.col(field)
        if field in STATUS_FIELDS:
            value = F.when(matched, F.col(f"_new.{STATUS_FIELDS[field]}")).otherwise(value)
        columns.append(value.alias(field))
    return joined.select(*columns)


def analysis_status(repositories: DataFrame, name: str | None = None) -> DataFrame:
    """Status columns under their short names; of one repository or of all."""
    rows = repositories if name is None else repositories.where(F.col("name") == name)
    return rows.select(
        "name",
        F.col("analysis_status").alias("status"),
        iso(F.col("analysis_start_time")).alias("start_time"),
        iso(F.col("analysis_end_time")).alias("end_time"),
        F.col("analysis_progress").alias("progress"),
        F.col("analysis_error_message").alias("error_message"),
    )


def list_repositories(repositories: DataFrame, prefix: str | None = URL_PREFIX) -> DataFrame:
    rows = repositories if prefix is None else repositories.where(F.col("url").startswith(prefix))
    times = {"created_at", "updated_at", "analysis_start_time", "analysis_end_time"}
    return rows.select(*[iso(F.col(f)).alias(f) if f in times else F.col(f) for f in REPOSITORIES.fieldNames()])
