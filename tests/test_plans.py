"""What the physical plans must look like for the work to scale."""

from __future__ import annotations

import re
from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from codelabels.operators import catalog, history, patches, results, runs
from codelabels.plans import jobs
from codelabels.plans.registry import CHECKS, QUERIES
from codelabels.session import settle
from codelabels.schemas import ANALYSIS_RESULTS, CONTRIBUTIONS, REPOSITORIES

WHEN = datetime(2024, 1, 1)
# These write tables or fit models while they are being built.
EAGER = re.compile(r"^(u1|u3|q12|u2_score_once|l3_older_history_branching|l3_older_history_index|s1|s7|s8|s9|s11|q12|p1_analysis_streaming|p1_run_over_batches|p4_extract_streaming|m._[a-z]+_job|q6|a6|p2_error|q8)")


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    rows = [
        (i, f"d{i}", "int a;\n" * 50, [1], f"/t/f{i}.java", WHEN, f"s{i % 3 and i}", "hot" if i % 3 else f"r{i}")
        for i in range(3000)
    ]
    spark.createDataFrame(rows, CONTRIBUTIONS).repartition(6).write.parquet(str(place / "c"))
    some = [(i, f"f{i}", "d", WHEN, f"s{i}", {"K1": 1}, 0.1, f"r{i}") for i in range(0, 3000, 5)]
    spark.createDataFrame(some, ANALYSIS_RESULTS).write.partitionBy("repo_name").parquet(str(place / "r"))
    return spark.read.parquet(str(place / "c")), spark.read.schema(ANALYSIS_RESULTS).parquet(str(place / "r"))


def test_analysis_moves_each_text_once(spark, stored):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        text = plan(jobs.analyze(*stored))
    # Fold, score, cut and clean happen on the join's own partitions.
    folding = text[: text.index("SortMergeJoin [seq")]
    assert folding.count("HashAggregate") == 2 and "Exchange" not in folding
    assert not re.search("Python|Cartesian|NestedLoop", text)
    assert len(re.findall(r"ReadSchema: struct<[^>]*file_content", text)) == 1


def test_few_pending_files_are_picked_where_the_texts_lie(spark, stored):
    rows = stored[0].withColumn("sha", F.when(F.col("seq") < 5, "new").otherwise("old"))
    known = stored[1].select(F.lit("old").alias("sha"), "filename")
    with settings(spark, spark__sql__adaptive__enabled="false"):
        text = plan(jobs.analyze(rows, known))
    assert "BroadcastHashJoin [seq" in text and "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_complete_tables_spare_the_text_in_run_planning(spark, stored):
    text = plan(runs.unnumbered_files(*stored, content_complete=True))
    assert "file_content" not in text
    assert "file_content" in plan(runs.unnumbered_files(*stored))


def test_reads_are_pruned(spark, stored):
    text = plan(results.results_of(stored[1], "r5"))
    assert re.search(r"PartitionFilters: \[[^]]*repo_name[^]]* = r5", text) and "seq" not in text
    assert "PushedFilters: [IsNotNull(sha), EqualTo(sha,s5)]" in plan(results.results_of_sha(stored[1], "s5"))


def test_cleaning_stays_out_of_the_line_loop(spark):
    from codelabels.operators.patches import with_changed_lines

    frame = spark.createDataFrame([("@@ -1 +1 @@\n+x", "x", False)], "patch string, file_content string, is_root boolean")
    text = plan(with_changed_lines(frame))
    loop = text[text.index("Generate") : text.index("Project", text.index("Generate"))]
    assert "package" not in loop and "_cleaned" in loop


SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "2KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "4KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__shuffle__partitions": "16",
}


def split_joins(df):
    rows = df.collect()
    return rows, "skew=true" in plan(df)


def test_hot_keys_are_split(spark, stored):
    """A commit and a repository with most rows: AQE splits their partitions."""
    contributions, _ = stored
    with settings(spark, **SKEW):
        hot_sha = contributions.withColumn("sha", F.when(F.col("seq") % 3 == 0, F.col("sha")).otherwise(F.lit("hot")))
        known = results.analysed_keys(hot_sha.where("seq = 0"))
        fresh = results.without_analysed(hot_sha.drop("file_content"), known)
        rows, split = split_joins(fresh)
        assert len(rows) == 2000 and split

        hot = contributions.select(
            "seq", F.col("seq").alias("filename"), "author", "timestamp", "sha", F.lit(1).alias("detected"),
            F.lit(0.0).alias("elapsed_time"), "repo_name",
        )
        names = contributions.select("repo_name").distinct()
        repos = names.select(*[
            F.col("repo_name").alias("name") if f == "name" else F.lit("https://github.com/apache/x").alias("url") if f == "url"
            else F.lit(None).alias(f) for f in REPOSITORIES.fieldNames()
        ])
        rows, split = split_joins(results.all_results(hot, settle(repos, "repositories")))
        assert len(rows) == 3000 and split

        log = contributions.select("repo_name", F.col("temp_filepath").alias("sha"), "author", F.col("seq").alias("ordinal"))
        rows, split = split_joins(history.older_than(log, log.where("ordinal in (1, 3)")))
        assert len(rows) == 1999 and split


def test_hot_keys_of_extraction_deletion_and_failure_are_split(spark, stored):
    contributions, _ = stored
    with settings(spark, **SKEW):
        diffs = contributions.select(
            F.lit("r").alias("repo_name"), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("s"), "seq")).otherwise("hot").alias("sha"),
            F.concat(F.lit("p"), "seq", F.lit(".java")).alias("a_path"), F.lit("").alias("b_path"), F.lit("x").alias("patch"),
        )
        commits = diffs.select("repo_name", "sha").distinct().withColumn("ordinal", F.lit(1))
        with planned_joins(spark) as joins:
            wanted = patches.wanted_files(settle(commits, "commits"), diffs)
        assert any("skew=true" in text for text in joins) and wanted.count() == 3000

        repos = contributions.select(F.col("repo_name").alias("name")).distinct()
        names = settle(repos.where("name in ('hot', 'r3')").unionAll(repos.where("name = 'r3'")), "names")
        rows, split = split_joins(catalog.delete_repositories(names, repos, contributions, contributions)[1])
        assert len(rows) == 999 and split

        scored = contributions.select(
            "repo_name", "seq", F.col("seq").alias("run_order"), "author", "file_content",
            F.when(F.col("seq") % 1000 == 998, "bad").alias("error"),
        )
        rows, split = split_joins(runs.before_failure(scored))
        assert split and not [r for r in rows if r["repo_name"] == "hot" and r["seq"] >= 998]


@contextmanager
def planned_joins(spark):
    """Final plans of what is written inside."""
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, path, *args, **options):
        write(self, path, *args, **options)
        frame = self._df
        frame.write.format("noop").mode("overwrite").save()
        frame.collect()
        seen.append(plan(frame))

    DataFrameWriter.parquet = parquet
    try:
        yield seen
    finally:
        DataFrameWriter.parquet = write


@pytest.mark.parametrize("name", [n for n in QUERIES if not EAGER.match(n)])
def test_no_query_pairs_everything(spark, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not re.search("CartesianProduct|NestedLoopJoin|PythonUDF|BatchEvalPython", text)


def test_registry_and_checks_agree():
    assert set(CHECKS) == set(QUERIES)
