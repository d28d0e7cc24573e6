"""What extraction moves and writes: names in few bytes, one exchange per step, texts that stay where they lie."""

from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codelabels.functions import paths
from codelabels.functions.values import packed, unpacked
from codelabels.operators import patches, ranking
from codelabels.plans import jobs
from codelabels.schemas import COMMIT_FILES, COMMIT_PATCHES, COMMITS_LOG
from codelabels.sources import tables

NAMES = ["00ff", "00fF", "0ff", "", "zz", "\x01", "\x00ab", "ab\n", "é" * 3, "a" * 40, None, "c1", "0xab", " ab"]


def test_packed_names_come_back(spark, apply):
    assert apply(lambda c: unpacked(packed(c)), NAMES) == NAMES
    sizes = apply(lambda c: F.length(packed(c)), NAMES)
    assert sizes[0] == 3 and sizes[9] == 21 and sizes[NAMES.index(None)] == 0
    held = [bytes(x) for x in apply(packed, NAMES)]
    assert len(set(held)) == len(NAMES)


def test_short_paths_are_not_made_to_be_measured(apply):
    items = ["a/b.java", "x" * 20 + ".java", ".java", "a.b/c", "d.e.java", "dir.x/" + "y" * 12 + ".java"]
    for limit in range(10, 45):
        short = apply(lambda c: paths.temp_path_fits(c, F.lit("0123456789"), "/t/", limit), items)  # noqa: B023
        whole = apply(lambda c: paths.path_fits(paths.temp_path(c, F.lit("0123456789"), "/t/"), limit), items)  # noqa: B023
        assert short == whole


@pytest.mark.parametrize("most", [0, ranking.MOST_BLOCKS])
def test_positions_without_moving_rows(spark, monkeypatch, most):
    """Numbers with gaps, on both sides of words and blocks, in groups of their own; also far above 32 bits."""
    monkeypatch.setattr(ranking, "MOST_BLOCKS", most)
    draw = random.Random(4)
    numbers = sorted({*draw.sample(range(20_000), 6_000), 0, 63, 64, 4095, 4096, *((7 << 33) + n for n in range(5, 300, 3))})
    rows = [("hot" if draw.random() < 0.7 else draw.choice("abc"), n, f"text {n}") for n in numbers]
    frame = spark.createDataFrame(rows, "repo_name string, seq long, text string")
    places = ranking.number_within(frame.select("repo_name", "seq"), "repo_name", "seq", span=1000)
    found = ranking.with_position(frame, places, "repo_name", "seq")
    assert found.columns == ["repo_name", "seq", "text", "position"]
    wanted, met = set(), {}
    for repo, n, text in rows:
        met[repo] = met.get(repo, 0) + 1
        wanted.add((repo, n, text, met[repo]))
    assert set(map(tuple, found.collect())) == wanted and found.count() == len(rows)
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in joins and "SortMergeJoin" not in joins) or not most


def test_numbering_takes_one_exchange(spark, monkeypatch):
    """Files that are there twice meet by the range partitioning that numbers them."""
    plans, settle = [], patches.settle
    monkeypatch.setattr(patches, "settle", lambda df, purpose: plans.append(df) or settle(df, purpose))
    rows = [("r", i % 7, f"p{i % 50}.java", f"{i % 7:040x}") for i in range(700)]
    touched = spark.createDataFrame(rows, "repo_name string, ordinal long, path string, sha string")
    found = patches.number_files(touched, 5)
    held = [tuple(r) for r in found.orderBy("seq").select("repo_name", "ordinal", "path", "sha").collect()]
    assert held == sorted(set(rows)) and found.agg(F.min("seq")).first()[0] == 5
    assert len(re.findall(r"Exchange \w*partitioning", plans[0]._jdf.queryExecution().executedPlan().toString())) == 1


@pytest.mark.parametrize("file_rows,task_files", [(1 << 12, 200_000), (1, 3)])
def test_stored_contributions_are_the_extracted_ones(spark, tmp_path, monkeypatch, file_rows, task_files):
    """Large and small: the same rows, and texts moved once only if files stay large."""
    monkeypatch.setattr(tables, "FILE_ROWS", file_rows)
    monkeypatch.setattr(patches, "TASK_FILES", task_files)
    when, code = datetime(2024, 1, 1), "class A {\n  int a;\n}\n"
    log = [(f"r{i % 2}", f"{i:040x}", "dev", when, [] if i > 37 else ["x"], i) for i in range(40)]
    log += log[:3]  # a commit that is listed twice has each file once
    names = [(r, s, f"d/p{k}.java") for r, s, *_ in log[:40] for k in range(3)]
    frames = (
        spark.createDataFrame(log, COMMITS_LOG),
        spark.createDataFrame([(*n, code.encode()) for n in names], COMMIT_FILES),
        spark.createDataFrame([(*n, n[2], "@@ -1 +1,2 @@\n class A {\n+  int a;\n") for n in names], COMMIT_PATCHES),
    )
    hints, save = [], tables.save_table
    monkeypatch.setattr(tables, "save_table", lambda *a, **k: hints.append(k["rebalance"]) or save(*a, **k))
    place = str(tmp_path / "stored")
    jobs.store_contributions(*frames, place, base="/t")
    assert hints == [file_rows > 1]
    key = lambda df: sorted((r["seq"], r["repo_name"], r["sha"], r["temp_filepath"], r["changed_lines"]) for r in df.collect())
    stored = key(spark.read.parquet(place))
    assert len(stored) == 120 and [r[1:] for r in stored] == [r[1:] for r in key(jobs.extract_contributions(*frames, base="/t"))]


def test_laid_out_tables_and_stream_batches_move_no_text_to_be_written(spark, tmp_path, monkeypatch):
    """The stream's tables are written where their rows are made, and batches go by the rule of any extraction."""
    from codelabels.plans.registry import QUERIES

    hints, save = [], tables.save_table
    monkeypatch.setattr(tables, "FILE_ROWS", 0)
    monkeypatch.setattr(tables, "save_table", lambda *a, **k: hints.append((k["partition"], k.get("rebalance", True))) or save(*a, **k))
    found = QUERIES["p4_extract_streaming"](spark, "/root/testdata/sf0.001")
    assert hints[:2] == [("sha_part", False)] * 2 and set(hints[2:]) == {("repo_name", False)}
    whole = QUERIES["s7_append_contributions"](spark, "/root/testdata/sf0.001")
    columns = ["repo_name", "sha", "temp_filepath", "file_content", "changed_lines"]
    assert sorted(found.select(columns).collect()) == sorted(whole.select(columns).collect())
