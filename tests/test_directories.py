"""Folders of files, listed and read by tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codelabels.operators import results
from codelabels.plans import jobs
from codelabels.sources import files

PLACES = [
    "a/x.java", "a/_h.java", "a/.h.java", "a/_k=1.java", "a/y.txt", "a/z.java/inner.java", "a/src/q.java", "b c/x.java", "b c/sub/n.java",
    "b c/src/q.java", "top.java", "é%20/x.java", "_u/x.java", ".dot/x.java", "empty/keep/x.txt",
]
PATTERNS = ["", "*", "a", "b c", "?", "*/src", "*/x.java", "a/x.java", "a/_h.java", "empty", "*/", "{a,_u}", "é%20", "*/*"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for place in PLACES:
        (top / place).parent.mkdir(parents=True, exist_ok=True)
        (top / place).write_text(f"text of {place}\r\n")
    return top


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_tasks_find_what_sparks_reader_finds(spark, tree, scheme):
    for pattern in PATTERNS if scheme else PATTERNS[:4]:
        folder = f"{scheme}{tree}/{pattern}"
        own = spark.read.format("binaryFile").option("pathGlobFilter", "*.java").load(folder)
        wanted = sorted(map(tuple, own.select(F.substring_index("path", "/", -2), F.replace(F.col("content").cast("string"), F.lit("\r\n"), F.lit("\n"))).collect()))
        found = files.read_directory(spark, folder, folders=1)
        assert sorted(map(tuple, found.select("filename", "file_content").collect())) == wanted, pattern
        assert "{" in pattern or "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("missing", ["none", "z*", "a/*/none", "none/*"])
def test_what_is_not_there_is_an_error(spark, tree, missing):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_directory(spark, f"{tree}/{missing}").collect()


def test_files_are_dealt_by_number_and_size(spark, tmp_path, monkeypatch):
    """As many tasks as the files need, whether they lie in one folder or each in its own."""
    for i in range(60):
        for place in (tmp_path / "one" / f"f{i}.java", tmp_path / "own" / f"n={i}" / "f.java"):
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_text(f"{i}" * 100)
    for folder, above in (("one", 0), ("own/n=*", 1)):
        for limits, tasks in (((20, 1 << 25, 1 << 23), 4), ((6, 1 << 25, 1), 10), ((2_000, 1_000, 150), 11)):
            for name, value in zip(("TASK_FILES", "TASK_BYTES", "BATCH_BYTES"), limits, strict=True):
                monkeypatch.setattr(files, name, value)
            found = files.read_directory(spark, f"{tmp_path}/{folder}", folders=above)
            assert found.rdd.getNumPartitions() == tasks
            assert sorted(r["file_content"] for r in found.collect()) == sorted(f"{i}" * 100 for i in range(60))


def test_folders_are_spread(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(40)] + [(7, "again")]
    files.write_directory(spark.createDataFrame(rows, "n long, body string"), f"{tmp_path}/made", "n", "body", spread=5)
    above = {p.name for p in (tmp_path / "made").iterdir()}
    assert above == {str(i) for i in range(5)}
    read = files.read_directory(spark, f"{tmp_path}/made/*/n=*", "txt", folders=1).collect()
    assert sorted((r["filename"].split("/")[0], r["file_content"]) for r in read) == sorted((f"n={n}", f"{body}\n") for n, body in rows)


def test_wide_labels_look_once(spark):
    """All values come from one array; a column with an error of its own per label makes code too long to compile."""
    labels = [f"K{i}" for i in range(70)]
    row = ("f", "a", None, "s", {x: i % 3 for i, x in enumerate(labels)})
    frame = spark.createDataFrame([row], "filename string, author string, timestamp timestamp_ntz, sha string, detected map<string,int>")
    wide = results.wide_labels(frame, labels)
    assert [wide.first()[x] for x in labels] == [int(i % 3 != 0) for i in range(70)]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("raise_error") <= 1
    for maps in ({"K1": 1}, None):
        with pytest.raises(Exception, match="label K0 is missing from a result"):
            results.wide_labels(frame.withColumn("detected", F.lit(None).cast("map<string,int>") if maps is None else F.map_filter("detected", lambda k, v: k == "K1")), labels).collect()


def test_label_table_by_hand(spark):
    """More labels than a number has bits, models that are not asked for, missing verdicts."""
    labels = [f"K{i}" for i in range(130)]
    rows = [("f", f"K{i}", i % 5 == 0 if i % 7 else None) for i in range(0, 140, 2)] + [("f", "K4", True), ("g", "other", True), ("g", None, True)]
    per_model = spark.createDataFrame(rows, "filename string, model string, detected boolean")
    source = spark.createDataFrame([("f", "a", None, "s"), ("g", "b", None, "t")], "filename string, author string, timestamp timestamp_ntz, sha string")
    found = {r["filename"]: r["detected"] for r in jobs.label_table(per_model, source, labels).collect()}
    hits = {m for f, m, d in rows if f == "f" and d}
    assert found["f"] == {x: int(x in hits) for x in labels} and found["g"] == dict.fromkeys(labels, 0)
