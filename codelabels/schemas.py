"""Table schemas and the fixed values every default refers to."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

# Results only agree with the system being replaced if these do.
FILE_TYPE = "java"
LABEL_COUNT = 27
WINDOW_MIN = 35
WINDOW_MAX = 35
WINDOW_GROW = 1
WINDOW_MOVE = 25
COMMIT_LIMIT = 50
HISTORY_PAGE = 100
PATH_LIMIT = 250
THRESHOLD = 0.5
ACTIVE_DAYS = 7
URL_PREFIX = "https://github.com/apache/"
STATUS_RUNNING = "in-progress"
STATUS_DONE = "completed"
STATUS_ERROR = "error"
DONE_MESSAGE = "Analysis completed"
NO_COMMITS = "No commits found for the repository"

LABELS = [f"K{i}" for i in range(1, LABEL_COUNT + 1)]
# The per-label classifiers cover K2..K28 except K5 and K26.
CLASSIFIER_LABELS = [f"K{i}" for i in range(2, 29) if i not in (5, 26)]

REPOSITORIES = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("comments", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("analysis_status", T.StringType()),
        T.StructField("analysis_start_time", T.TimestampNTZType()),
        T.StructField("analysis_end_time", T.TimestampNTZType()),
        T.StructField("analysis_progress", T.IntegerType()),
        T.StructField("analysis_error_message", T.StringType()),
    ]
)

CONTRIBUTIONS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("author", T.StringType()),
        T.StructField("file_content", T.StringType()),
        T.StructField("changed_lines", T.ArrayType(T.IntegerType())),
        T.StructField("temp_filepath", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("sha", T.StringType()),
        T.StructField("repo_name", T.StringType()),
    ]
)

ANALYSIS_RESULTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("sha", T.StringType()),
        T.StructField("detected", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("elapsed_time", T.DoubleType()),
        T.StructField("repo_name", T.StringType()),
    ]
)

STATUS_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("repo_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("progress", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# The three inputs that stand for a version-control history.
COMMITS_LOG = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField("sha", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("committed_at", T.TimestampNTZType()),
        T.StructField("parent_shas", T.ArrayType(T.StringType())),
        T.StructField("ordinal", T.LongType()),
    ]
)

COMMIT_FILES = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField("sha", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content", T.BinaryType()),
    ]
)

COMMIT_PATCHES = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField("sha", T.StringType()),
        T.StructField("a_path", T.StringType()),
        T.StructField("b_path", T.StringType()),
        T.StructField("patch", T.StringType()),
    ]
)

TABLES = {
    "repositories": (REPOSITORIES, None),
    "contributions": (CONTRIBUTIONS, "repo_name"),
    "analysis_results": (ANALYSIS_RESULTS, "repo_name"),
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Create each missing catalogue table; return the names that were new.

    Every table is checked on its own, so a half-made set is completed.
    """
    created = []
    for name, (schema, partition) in TABLES.items():
        full_name = f"{database}.{name}"
        if spark.catalog.tableExists(full_name):
            continue
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        layout = f" PARTITIONED BY ({partition})" if partition else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full_name} ({columns}) USING parquet{layout}")
        created.append(name)
    return created
