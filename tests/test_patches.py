from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codelabels.operators import patches
from codelabels.plans.jobs import extract_contributions
from codelabels.schemas import COMMIT_FILES, COMMIT_PATCHES, COMMITS_LOG

CODE = "package p;\nclass A {\n  int a = 1; // why\n  ++i;\n  b();\n  /* note */\n}\n"


def numbers(spark, cases):
    frame = spark.createDataFrame([(i, p, c, False) for i, (p, c) in enumerate(cases)], "i int, patch string, file_content string, is_root boolean")
    found = {r["i"]: r["changed_lines"] for r in patches.with_changed_lines(frame).collect()}
    return [found.get(i, []) for i in range(len(cases))]


def test_hand_written_patches(spark):
    cases = [
        ("@@ -1,2 +3,4 @@ x\n ctx\n+  b();\n-old\n+}\n", CODE, [4, 5]),
        ("@@ -1 +2,2 @@\n+  ++i;\n@@ -9,1 +20 @@\n ctx\n+  b();\n", CODE, [2, 21]),
        ("@@ -1 +1,2 @@\n+++i;\n+  b();\n", CODE + "++i;", [2]),
        ("@@ -1,3 +1 @@\n-a\n-b\n", CODE, []),
        ("@@ -1 +1,2 @@\n+// gone\n+  \n+*\n", CODE, []),
        ("@@ -1 +1 @@\n+  int a = 1; // why\n", CODE, []),
        ("@@ -1 +1,9 @@\n\\ No newline at end of file\n+  b();\n", CODE, [2]),
        ("@@ -1 +1 @@\n+package p;\n", CODE, []),
        ("@@ -1 +1,2 @@\r\n+  b();\r\n", CODE, [1]),
        ("+  b();\n", CODE, []),
        ("", CODE, []),
        ("@@ -1 +7,2 @@\n+// b();\n", "  // b();\n s = '// b();';", [7]),
    ]
    assert numbers(spark, [(p, c) for p, c, _ in cases]) == [wanted for _, _, wanted in cases]


def test_random_patches_against_a_running_counter(spark):
    rng = random.Random(5)
    cases, wanted = [], []
    for _ in range(150):
        lines, found = [], []
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(1, 500)
            lines.append(f"@@ -{rng.randrange(9)},3 +{at},5 @@ f()")
            for _ in range(rng.randrange(0, 9)):
                line = rng.choice([" ctx", "-gone", "+  b();", "+// x", "+", "+++i;", "\\ No newline", ""])
                lines.append(line)
                if line == "+  b();":
                    found.append(at)
                at += not line.startswith("-")
        cases.append(("\n".join(lines), CODE))
        wanted.append(found)
    assert numbers(spark, cases) == wanted


@pytest.fixture
def history(spark):
    when = datetime(2024, 1, 1)
    log = [
        ("r", "merge00", "m", when, ["child00", "root000"], 1),
        ("r", "child00", "c", when, ["root000"], 2),
        ("r", "root000", "o", when, [], 3),
        ("q", "child00", "z", when, ["gone"], 1),
    ]
    add = "@@ -1 +1,2 @@\n+  b();\n"
    files = [
        ("r", "merge00", "M.java", CODE.encode()),
        ("r", "child00", "a/A.java", CODE.encode()),
        ("r", "child00", "a/Bad.java", b"  b();\xff\xfe"),
        ("r", "child00", "a/Gone.java", None),
        ("r", "child00", "x.py", CODE.encode()),
        ("r", "root000", "a/A.java", b"one\r\ntwo\n"),
        ("r", "root000", "Empty.java", b""),
        ("q", "child00", "Q.java", CODE.encode()),
    ]
    diffs = [
        (repo, sha, path, "" if path == "a/Gone.java" else path, add) for repo, sha, path, _ in files
    ]
    return (
        spark.createDataFrame(log, COMMITS_LOG),
        spark.createDataFrame(files, COMMIT_FILES),
        spark.createDataFrame(diffs, COMMIT_PATCHES),
    )


def test_extraction(spark, history):
    found = {(r["repo_name"], r["sha"], r["path"]): r for r in extract_contributions(*history, base="/t").collect()}
    assert set(found) == {("r", "child00", "a/A.java"), ("r", "root000", "a/A.java"), ("q", "child00", "Q.java")}
    child = found["r", "child00", "a/A.java"]
    assert child["changed_lines"] == [1] and child["author"] == "c"
    assert child["temp_filepath"] == "/t/a_A_child00.java" and child["file_content"] == CODE
    assert found["r", "root000", "a/A.java"]["changed_lines"] == [1, 2]


@pytest.mark.parametrize("limit,wanted", [(0, set()), (1, {"q"}), (2, {"q", "r"}), (99, {"q", "r"})])
def test_limit_counts_merges(history, limit, wanted):
    assert {r["repo_name"] for r in extract_contributions(*history, limit=limit).collect()} == wanted


def test_stored_commits_of_the_same_repository_are_skipped(spark, history):
    stored = spark.createDataFrame([("r", "child00"), ("r", "child00")], "repo_name string, sha string")
    found = {(r["repo_name"], r["sha"]) for r in extract_contributions(*history, stored=stored).collect()}
    assert found == {("r", "root000"), ("q", "child00")}


def test_path_limit(history):
    kept = extract_contributions(*history, base="/" + "d" * 232, path_limit=250).select("path").collect()
    assert {r["path"] for r in kept} == {"Q.java", "a/A.java"}
    kept = extract_contributions(*history, base="/" + "d" * 233, path_limit=250).select("path").collect()
    assert {r["path"] for r in kept} == {"Q.java"}


def test_line_acceptance_column(spark):
    rows = spark.createDataFrame([("+ b();",), ("+ // b",), ("+",), ("+ *",)], "line string")
    out = rows.select(patches.line_accepted(F.col("line"), F.lit("a\n b();\n *")).alias("ok")).collect()
    assert [r["ok"] for r in out] == [True, False, False, False]


def test_every_break_ends_a_patch_line(spark):
    """CR LF is one break, each other separator is one as well, also before a hunk."""
    for mark in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"):
        patch = mark.join(["head", "@@ -1 +3,2 @@", " a", "-b", "+c", "@@ -9 +20 @@", "+c", "+d", ""])
        row = spark.createDataFrame([(patch, "c")], "patch string, cleaned string")
        found = row.select(patches.changed_lines(F.col("patch"), F.col("cleaned")).alias("n"), patches.hunk_lines(F.col("patch")).alias("l")).first()
        assert found["n"] == [4, 20], repr(mark)
        assert [x for x in found["l"] if x.startswith("+")] == ["+c", "+c", "+d"]


def test_no_row_is_built_for_a_line(spark):
    plan = spark.createDataFrame([("", "")], "patch string, cleaned string").select(patches.changed_lines(F.col("patch"), F.col("cleaned")))
    assert "number" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_acceptance_is_judged_once(spark):
    from codelabels.plans.registry import QUERIES

    text = QUERIES["f9_line_acceptance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Contains(cleaned") == 1


def test_hunks_begin_at_line_starts_only(spark):
    """Patches with and without a head, marks inside lines, hunks in a row and starts that cannot be read."""
    cases = {
        "@@ -1 +5 @@\n+a\n x @@ y\n+a\n@@ -9 +20 @@ f\n-a\n+a": [5, 7, 20],
        "head @@ -1 +5 @@\n+a": [],
        "head\n@@\n@@ -1 +3 @@\n+a\n": [3],
        "@@@@ -1 +4 @@\n+a\n@@ none\n+a": [4, None],
        "": [],
        "+a": [],
    }
    rows = spark.createDataFrame([(p, "a") for p in cases], "patch string, cleaned string")
    found = {r["patch"]: r["n"] for r in rows.select("patch", patches.changed_lines(F.col("patch"), F.col("cleaned")).alias("n")).collect()}
    assert found == cases
    lines = spark.createDataFrame([("x\n@@+a\n+b\n@@ c",)], "patch string").select(patches.hunk_lines(F.col("patch")).alias("l")).first()["l"]
    assert [x for x in lines if x] == ["@@+a", "+b", "@@ c"]


def test_paths_are_made_once(spark, monkeypatch):
    """A temporary path is made once, not again in a filter pushed below."""
    seen = []
    monkeypatch.setattr(patches, "settle", lambda df, purpose: seen.append(df) or df)
    commits = spark.createDataFrame([("r", "s")], "repo_name string, sha string")
    diffs = spark.createDataFrame([("r", "s", "a/B.java", "a/B.java", "")], "repo_name string, sha string, a_path string, b_path string, patch string")
    patches.wanted_files(commits, diffs)
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
