from __future__ import annotations

import re
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codelabels.plans import jobs
from codelabels.schemas import ANALYSIS_RESULTS, CONTRIBUTIONS, REPOSITORIES, STATUS_LOG
from codelabels.sources import manifest, seen

WHEN = datetime(2024, 1, 1)
NOW = "2024-06-01 12:00:00"


def texts(spark, names=("a", "b", "c"), low=0, n=9):
    rows = [(i, "d", f"text {i}", [1], f"/t/f{i}.java", WHEN, f"s{i}", names[i % len(names)]) for i in range(low, low + n)]
    return spark.createDataFrame(rows, CONTRIBUTIONS)


def catalogue(spark, names):
    return spark.createDataFrame([(n, f"u{n}", "about", None, WHEN, WHEN, None, None, None, None, None) for n in names], REPOSITORIES)


def files(table):
    return {str(p.relative_to(table)): p.stat().st_mtime_ns for p in Path(table).rglob("*.parquet")}


def kept(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_deleting_a_repository_writes_no_text(spark, tmp_path):
    places = [str(tmp_path / x) for x in ("repositories", "contributions", "results")]
    results = spark.createDataFrame([(i, f"f{i}", "d", WHEN, f"s{i}", {"K1": 1}, 0.0, "abc"[i % 3]) for i in range(9)], ANALYSIS_RESULTS)
    manifest.create(spark, places[0], catalogue(spark, "abc"), "name", latest=True)
    manifest.create(spark, places[1], texts(spark), "repo_name")
    manifest.create(spark, places[2], results, "repo_name")
    before = files(places[1])
    jobs.remove_repositories(spark, *places, spark.createDataFrame([("b",), ("b",), ("x",), (None,)], "name string"))
    added = {f: t for f, t in files(places[1]).items() if f not in before}
    assert {f: t for f, t in files(places[1]).items() if f in before} == before
    assert all(spark.read.parquet(f"{places[1]}/{f}").columns == ["repo_name"] for f in added)
    left = manifest.read(spark, places[1])
    assert kept(left, "seq") == [(i,) for i in range(9) if i % 3 != 1] and kept(manifest.read(spark, places[0]), "name") == [("a",), ("c",)]
    assert kept(manifest.read(spark, places[2]), "seq") == kept(left, "seq")
    # What was removed is a partition that no task opens, and older versions stay readable.
    assert re.search(r"PartitionFilters: \[[^]]*NOT repo_name[^]]*(IN \(|= )", left._jdf.queryExecution().executedPlan().toString())
    assert manifest.read(spark, places[1], 1).count() == 9
    # A name may come back: only what stood before its removal is gone.
    manifest.append(spark, places[1], texts(spark, ("b",), 100, 2))
    assert kept(manifest.read(spark, places[1]).where("repo_name = 'b'"), "seq") == [(100,), (101,)]


@pytest.mark.parametrize("few", [1000, 0])
def test_many_removed_names_are_joined(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(manifest, "FEW", few)
    place = str(tmp_path / "t")
    rows = texts(spark, n=40).withColumn("repo_name", F.when(F.col("seq") == 5, None).otherwise(F.concat(F.lit("r"), (F.col("seq") % 10).cast("string"))))
    manifest.create(spark, place, rows, "repo_name")
    manifest.remove(spark, place, spark.createDataFrame([(f"r{i}",) for i in range(7)], "n string"))
    assert kept(manifest.read(spark, place), "seq") == sorted([(i,) for i in range(40) if i % 10 > 6] + [(5,)], key=str)


def test_edits_and_status_write_changed_rows_only(spark, tmp_path):
    place = str(tmp_path / "repositories")
    manifest.create(spark, place, catalogue(spark, [f"n{i:03}" for i in range(200)]), "name", latest=True)
    updates = spark.createDataFrame([(1, "n003", "new", None, "x"), (2, "n003", "newer", "d", None), (3, "fresh", None, "d", "c")], "seq long, name string, url string, description string, comments string")
    jobs.edit_repositories(spark, place, updates, F.lit(NOW).cast("timestamp_ntz"))
    assert [p.rows for p in manifest.newest(spark, place).parts] == [200, 2]
    log = spark.createDataFrame([(1, "n004", "in-progress", WHEN, None, 5, None), (2, "n004", "completed", WHEN, WHEN, 100, None), (3, "nobody", "error", WHEN, WHEN, None, "x")], STATUS_LOG)
    jobs.record_status(spark, place, log)
    assert [p.rows for p in manifest.newest(spark, place).parts] == [200, 2, 1]
    rows = {r["name"]: r for r in manifest.read(spark, place).collect()}
    assert len(rows) == 201 and rows["n003"]["url"] == "newer" and rows["fresh"]["url"] == "" and rows["n004"]["analysis_status"] == "completed"
    assert rows["n004"]["url"] == "un004" and rows["n003"]["created_at"] == WHEN


def test_of_two_writers_both_count(spark, tmp_path):
    place = str(tmp_path / "t")
    manifest.create(spark, place, catalogue(spark, ["a"]), "name", latest=True)
    gate, seen_by = threading.Barrier(2), []

    def add(mark):
        first = [True]

        def work(now):
            # Both look at the first version before either publishes.
            if first.pop() if first else False:
                gate.wait(60)
            seen_by.append(now.select("description").first()[0])
            return now.withColumn("description", F.concat("description", F.lit(mark)))

        manifest.change(spark, place, work)

    threads = [threading.Thread(target=add, args=(m,)) for m in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert manifest.newest(spark, place).number == 3
    assert manifest.read(spark, place).first()["description"] in ("aboutxy", "aboutyx")
    # The one that lost has worked again, on what the other left; its first try is deleted.
    assert len(seen_by) == 3 and len(list((tmp_path / "t" / "data").iterdir())) == 3


def test_compaction_changes_no_rows(spark, tmp_path):
    place = str(tmp_path / "t")
    manifest.create(spark, place, texts(spark, n=30), "repo_name")
    for k in range(4):
        manifest.append(spark, place, texts(spark, ("b", "c", "d"), 100 * (k + 1), 6))
        manifest.remove(spark, place, spark.createDataFrame([("abcd"[k],)], "n string"))
    old = manifest.read(spark, place)
    rows, size = kept(old, "seq", "repo_name"), manifest.newest(spark, place).parts[0].size
    # The first folder is large: it stays, and so does what was removed from it.
    manifest.compact(spark, place, small=size)
    assert [p.kind for p in manifest.newest(spark, place).parts] == ["rows", "gone", "rows"]
    assert kept(manifest.read(spark, place), "seq", "repo_name") == rows == kept(old, "seq", "repo_name")
    manifest.compact(spark, place)
    assert [p.kind for p in manifest.newest(spark, place).parts] == ["rows"]
    assert kept(manifest.read(spark, place), "seq", "repo_name") == rows
    assert manifest.compact(spark, place).number == manifest.newest(spark, place).number


def test_versions_are_forgotten_with_their_folders(spark, tmp_path):
    place = str(tmp_path / "t")
    for k in range(6):
        manifest.commit(spark, place, lambda v: manifest.Version(0, CONTRIBUTIONS.json(), "repo_name", parts=(manifest.write_part(place, texts(spark, n=1)),)), kept=3)
    assert manifest._numbers(spark, place) == [4, 5, 6] and len(list((tmp_path / "t" / "data").iterdir())) == 3
    with pytest.raises(ValueError, match="no version"):
        manifest.read(spark, str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        manifest.create(spark, place, texts(spark), "repo_name")


# --- the index of seen keys ---------------------------------------------------

KEYS = "commit string, place long"


def keyed(spark, numbers):
    return spark.createDataFrame([(f"k{i}", i) for i in numbers], KEYS)


def found(spark, place, numbers):
    frame = keyed(spark, numbers)
    return sorted((r["place"], r["run"], r["batch_id"]) for r in seen.lookup(spark, place, frame, "commit", frame.schema).collect())


def test_index_finds_what_was_remembered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "BUCKET", 8)
    place = str(tmp_path / "index")
    assert found(spark, place, range(5)) == []
    for batch in range(20):
        seen.remember(spark, place, keyed(spark, range(10 * batch, 10 * batch + 10)), "commit", "r", batch, recent=25, next=batch)
    assert found(spark, place, range(-50, 260)) == [(i, "r", i // 10) for i in range(200)]
    assert found(spark, place, [-1, 500]) == [] and manifest.newest(spark, place).about == {"next": 19}
    # A batch that is done again replaces what it added, as long as that is recent.
    seen.remember(spark, place, keyed(spark, [190, 777]), "commit", "r", 19, recent=1000)
    assert found(spark, place, range(185, 800))[-3:] == [(189, "r", 18), (190, "r", 19), (777, "r", 19)]
    # Sealed sets are merged level by level, so they stay few.
    assert sum(p.kind == "sealed" for p in manifest.newest(spark, place).parts) <= 8


def test_a_batch_opens_as_many_files_after_fifty_batches_as_after_one(spark, tmp_path):
    def opened(batches):
        place, frame = str(tmp_path / f"index{batches}"), keyed(spark, range(10**6, 10**6 + 30))
        for batch in range(batches):
            seen.remember(spark, place, keyed(spark, range(30 * batch, 30 * batch + 30)), "commit", "r", batch)
        looked = seen.lookup(spark, place, frame, "commit", frame.schema)
        assert looked.count() == 0
        return len([f for f in looked.inputFiles() if "/index" in f])

    assert opened(1) == opened(50) == 1


def test_filters_keep_buckets_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "BUCKET", 64)
    place = str(tmp_path / "index")
    seen.remember(spark, place, keyed(spark, range(4000)), "commit", "r", 0, recent=100)
    assert [p.kind for p in manifest.newest(spark, place).parts] == ["sealed"]

    real, opened_ = seen._opened, []
    monkeypatch.setattr(seen, "_opened", lambda *args: opened_.extend(args[-1]) or real(*args))

    def opened(numbers):
        frame = keyed(spark, numbers)
        opened_.clear()
        rows = seen.lookup(spark, place, frame, "commit", frame.schema).count()
        return len(opened_), rows

    assert opened([17]) == (1, 1)
    files_, rows = opened(range(10_000, 10_040))
    # Forty unknown keys fall into most of 63 buckets; filters of 16 bits a key open few of them.
    assert rows == 0 and files_ <= 6


def test_two_streams_write_to_one_index(spark, tmp_path):
    place = str(tmp_path / "index")
    work = lambda run: [seen.remember(spark, place, keyed(spark, [b * 10 + ord(run)]), "commit", run, b) for b in range(4)]
    threads = [threading.Thread(target=work, args=(r,)) for r in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    assert len(found(spark, place, range(100, 200))) == 8
