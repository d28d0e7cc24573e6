"""What each user-level request computes, as lazily planned jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import repository_name
from ..functions.values import plain_time
from ..operators import catalog, history, patches, results, runs
from ..operators.scoring import RuleScorer, classify, fan_out
from ..operators.windows import file_lines, line_windows
from ..schemas import FILE_TYPE, HISTORY_PAGE, PATH_LIMIT, WINDOW_GROW, WINDOW_MAX, WINDOW_MIN, WINDOW_MOVE
from ..session import settle
from ..sources import manifest, tables

# min size, max size, growth, move
Windows = tuple[int, int, int, int]
WINDOWS: Windows = (WINDOW_MIN, WINDOW_MAX, WINDOW_GROW, WINDOW_MOVE)
# Labels whose verdicts share a number.
WORD = 62
RUN_KEYS = ["seq", "repo_name", "filename", "run_order", "done", "total", "author", "timestamp", "sha"]


def choose_files(
    log: DataFrame,
    commit_patches: DataFrame,
    stored: DataFrame | None = None,
    limit: int | None = None,
    skip: int = 0,
    base: str = "temp",
    file_type: str = FILE_TYPE,
    path_limit: int = PATH_LIMIT,
    first_seq: int = 0,
) -> DataFrame:
    """The files to extract of each repository's latest commits, numbered and settled as narrow rows.

    Commits and then files are chosen on narrow rows, and settled, before any
    patch or content is touched.
    """
    commits = history.newest_commits(log, limit, skip)
    if stored is not None:
        commits = history.without_stored(commits, stored)
    chosen = history.without_merges(commits).select(
        "repo_name", "sha", "author", F.col("committed_at").alias("timestamp"), "ordinal", "is_root"
    )
    chosen = settle(chosen.dropDuplicates(history.COMMIT), "commits")
    return patches.number_files(patches.touched_files(chosen, commit_patches, base, file_type, path_limit), first_seq)


def extract_chosen(
    chosen: DataFrame, commit_files: DataFrame, commit_patches: DataFrame, base: str = "temp", file_type: str = FILE_TYPE
) -> DataFrame:
    """The contributions of the chosen files."""
    found = patches.changed_files(chosen, commit_patches, commit_files, base, file_type, patches.text_tasks(chosen))
    return patches.with_changed_lines(found)


def extract_contributions(
    log: DataFrame,
    commit_files: DataFrame,
    commit_patches: DataFrame,
    stored: DataFrame | None = None,
    limit: int | None = None,
    skip: int = 0,
    base: str = "temp",
    file_type: str = FILE_TYPE,
    path_limit: int = PATH_LIMIT,
    first_seq: int = 0,
) -> DataFrame:
    """New contributions of each repository's latest commits, numbered from ``first_seq``."""
    chosen = choose_files(log, commit_patches, stored, limit, skip, base, file_type, path_limit, first_seq)
    return extract_chosen(chosen, commit_files, commit_patches, base, file_type)


def store_contributions(
    log: DataFrame,
    commit_files: DataFrame,
    commit_patches: DataFrame,
    location: str,
    stored: DataFrame | None = None,
    base: str = "temp",
    first_seq: int = 0,
    mode: str = "append",
) -> None:
    """Extracts and appends contributions; texts are not moved again to be written where that leaves few files."""
    chosen = choose_files(log, commit_patches, stored, base=base, first_seq=first_seq)
    few = tables.fill_files(chosen, "repo_name", patches.text_tasks(chosen))
    tables.append_contributions(extract_chosen(chosen, commit_files, commit_patches, base), location, mode, rebalance=not few)


def score_files(files: DataFrame, keys: list[str], scorer: Callable, windows: Windows = WINDOWS) -> DataFrame:
    """Clean, cut, score and fold: one row per file with its 0/1 ``verdict``."""
    cut = line_windows(file_lines(files.select(*keys, "file_content")), *windows)
    return results.any_window(scorer(cut.select(*keys, "code")), keys, scorer.labels)


def analyze(
    contributions: DataFrame,
    stored_results: DataFrame,
    scorer: Callable | None = None,
    windows: Windows = WINDOWS,
    by: str = "sha",
    content_complete: bool = False,
    requested: DataFrame | None = None,
    skip: DataFrame | None = None,
    settled: bool = False,
) -> DataFrame:
    """One analysis run per repository in ``contributions``, or per requested one.

    Gives a row per file in run order with ``detected``, ``done``, ``total``,
    ``elapsed_time`` and ``error`` (null unless its scoring failed). Callers who
    use the rows more than once should settle them first, so that all uses see
    one scoring. Run places are found on narrow rows and settled before the
    texts are fetched by unique number: few pending files are picked out where
    the texts lie, many are spread whatever repository they belong to. The
    windows of a file are folded without another shuffle. ``settled`` says that
    the stored results are a few keys already written down for this call.
    """
    scorer = scorer or RuleScorer()
    known = stored_results if settled else results.analysed_keys(stored_results, by)
    pending = settle(runs.pending_files(contributions, known, by, content_complete, requested, skip), "pending")
    scored = score_files(runs.with_text(pending, contributions), RUN_KEYS, scorer, windows)
    for name, kind in (("elapsed_time", "double"), ("error", "string")):
        if name not in scored.columns:
            scored = scored.withColumn(name, F.lit(0.0 if kind == "double" else None).cast(kind))
    detected = results.label_map(F.col("verdict"), scorer.labels)
    return scored.withColumn("detected", detected).drop("verdict")


def saved_results(scored: DataFrame, can_fail: bool = True) -> DataFrame:
    """Rows a run stores: those before its first failure, with progress."""
    return runs.with_progress(runs.before_failure(scored) if can_fail else scored.drop("error"))


@dataclass(frozen=True)
class Run:
    """What a run leaves: stored results, status-log entries, progress events."""

    results: DataFrame
    opening: DataFrame
    later_statuses: DataFrame
    events: DataFrame

    @property
    def statuses(self) -> DataFrame:
        return self.opening.unionByName(self.later_statuses)


def run_analysis(
    contributions: DataFrame,
    stored_results: DataFrame,
    requested: DataFrame | None,
    url: Column,
    scorer: Callable | None = None,
    windows: Windows = WINDOWS,
    by: str = "sha",
    content_complete: bool = False,
    first_seq: int = 0,
    opened: Callable[[DataFrame], None] | None = None,
    clock: Callable[[], Column] = lambda: F.lit(datetime.now()),
    skip: DataFrame | None = None,
    settled: bool = False,
) -> Run:
    """The analysis of the requested repositories (``repo_name``), or of all there are, scored once.

    ``opened`` receives the opening status entries before any file is scored, so
    that readers see a run that works. A repository with nothing left to score
    is completed at once; one without contributions gets an error event and no
    status. Status numbers start at ``first_seq``: pass the first free number of
    the log (:func:`..sources.tables.next_seq`), and no run is ever overtaken by
    an older one.
    """
    first, scorer = F.lit(first_seq).cast("bigint"), scorer or RuleScorer()
    if requested is None:
        everyone = contributions.select("repo_name").where(F.col("repo_name").isNotNull()).distinct()
        asked, working = everyone.withColumn("has_commits", F.lit(True)), None
    else:
        asked = settle(runs.requested_runs(requested, contributions), "requested")
        working = asked.where("has_commits")
    started = clock()
    opening = runs.opening_status(asked.where("has_commits"), started, first)
    if opened:
        opened(opening)
    scored = settle(analyze(contributions, stored_results, scorer, windows, by, content_complete, working, skip, settled), "scored")
    saved = saved_results(scored, getattr(scorer, "can_fail", True))
    finished = runs.every_run(asked, runs.run_summary(scored))
    ran = finished.where("has_commits")
    closing = runs.closing_status(ran, started, clock(), first + F.col("total") + 1)
    later = runs.rising_status(saved, started, first).unionByName(closing)
    events = runs.file_events(saved, url).unionByName(runs.closing_events(finished, url))
    return Run(saved, opening, later, events)


def run_events(scored: DataFrame, url: Column) -> DataFrame:
    """All progress events of all runs, numbered within each repository."""
    files = runs.file_events(saved_results(scored), url)
    closing = runs.closing_events(runs.run_summary(scored), url)
    return files.unionByName(closing)


def edit_repositories(spark: SparkSession, table: str, updates: DataFrame, now: Column) -> None:
    """Applies creations and edits to the catalogue; only rows that change are written.

    If another writer is faster the edits are applied to what it left.
    """
    names = updates.select("name").distinct()
    manifest.change(spark, table, lambda rows: catalog.upsert_repositories(rows.join(names, "name", "left_semi"), updates, now))


def record_status(spark: SparkSession, table: str, status_log: DataFrame) -> None:
    """Puts each repository's last status into the catalogue; only rows that change are written."""
    names = status_log.select(F.col("repo_name").alias("name")).distinct()
    manifest.change(spark, table, lambda rows: catalog.apply_status(rows.join(names, "name", "left_semi"), status_log))


def remove_repositories(spark: SparkSession, repositories: str, contributions: str, analysis_results: str, names: DataFrame) -> None:
    """Takes the named repositories out of the three tables; no text is read or written.

    The catalogue goes last: until then a repository that is half removed is
    still listed, and the removal can be repeated.
    """
    for table in (analysis_results, contributions, repositories):
        manifest.remove(spark, table, names)


def history_dates(log: DataFrame, commit_patches: DataFrame, page: int = HISTORY_PAGE) -> DataFrame:
    """Commit times of the newest page touching the file type, newest first."""
    recent = history.recent_history(log, commit_patches, page)
    return recent.select("repo_name", "ordinal", plain_time(F.col("committed_at")).alias("commit_date"))


def repository_of(url: str) -> Column:
    return repository_name(F.lit(url))


def score_per_label(
    files: DataFrame,
    models: dict[str, PipelineModel] | dict[str, Callable[[Column], Column]],
    keys: Sequence[str] = ("filename",),
    windows: Windows = WINDOWS,
    prepare: Callable[[Column], Column] = lambda code: code,
) -> DataFrame:
    """Per-label classifiers over files: (model, file, detected).

    ``models`` are trained pipelines, or Column expressions over the prepared
    window.
    """
    cut = line_windows(file_lines(files.select(*keys, "file_content")), *windows).select(*keys, "code")
    trained = any(isinstance(m, PipelineModel) for m in models.values())
    scored = classify(cut, models) if trained else fan_out(cut, models, prepare)
    return results.any_window_per_model(scored, list(keys))


def label_table(per_model: DataFrame, files: DataFrame, labels: Sequence[str], key: str = "filename") -> DataFrame:
    """Model rows gathered to one label map per file, ready for the wide export.

    A file's labels are the bits of a few numbers, not an aggregate each.
    """
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("model")) - 1
    words = range(-(-len(labels) // WORD))
    hit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(WORD)).cast("int"))
    own = lambda w: F.col("detected").cast("int").eqNullSafe(1) & (F.floor(place / WORD) == w)
    folded = per_model.groupBy(key).agg(*[F.bit_or(F.when(own(w), hit).otherwise(F.lit(0).cast("bigint"))).alias(f"_bits{w}") for w in words])
    # Unknown models have no place and set no bit.
    flags = F.array(*[F.getbit(F.col(f"_bits{i // WORD}"), F.lit(i % WORD)).cast("int") for i in range(len(labels))])
    about = files.select(key, "author", "timestamp", "sha")
    return about.join(folded.select(key, results.label_map(flags, list(labels)).alias("detected")), key)
