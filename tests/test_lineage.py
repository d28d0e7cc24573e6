from __future__ import annotations

import random

import pytest

from codelabels.operators import history
from codelabels.sources import lineage, manifest

LOG = "repo_name string, sha string, parent_shas array<string>"
KEYS = "repo_name string, sha string"


def reachable(parents, start):
    """What a walk from the first parent of each start meets, as far as the log holds it."""
    todo = [parents[s][0] for s in start if parents.get(s)]
    met = set()
    while todo:
        at = todo.pop()
        if at in parents and at not in met:
            met.add(at)
            todo += [p for p in parents[at] if p is not None]
    return met


def history_of(seed, n):
    """A random history: long lines, forks, merges and several roots; older commits have smaller numbers."""
    rng = random.Random(seed)
    parents = {"c0": []}
    for i in range(1, n):
        older = [f"c{j}" for j in range(max(0, i - rng.choice([1, 1, 1, 9])), i)]
        parents[f"c{i}"] = rng.sample(older, min(len(older), rng.choice([0, 1, 1, 1, 1, 2, 3]) if i > 5 else 1))
    return parents


def frame(spark, parents, shas=None, repo="r"):
    return spark.createDataFrame([(repo, s, parents[s]) for s in (shas if shas is not None else parents)], LOG)


def page(spark, table, log, *cursors):
    keys = spark.createDataFrame(list(cursors), KEYS)
    rows = [(r["repo_name"], r["sha"]) for r in lineage.older(spark, table, log, keys).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def places(spark, table):
    return {r["sha"]: (r["chain"], r["depth"]) for r in manifest.read(spark, table).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_pages_over_growing_histories(spark, tmp_path, seed):
    table, parents = str(tmp_path / "index"), history_of(seed, 90)
    log, before = frame(spark, parents), {}
    for upto in (25, 60, 90):
        lineage.extend(spark, table, frame(spark, parents, [f"c{i}" for i in range(upto)]))
        now = places(spark, table)
        assert len(now) == upto and before.items() <= now.items()  # what is placed stays there
        assert len(set(now.values())) == upto
        before = now
    rng = random.Random(seed)
    for cursor in rng.sample(sorted(parents), 3) + ["c89"]:
        assert page(spark, table, log, ("r", cursor)) == {("r", s) for s in reachable(parents, [cursor])}
    two = page(spark, table, log, ("r", "c40"), ("r", "c80"))
    assert two == {("r", s) for s in reachable(parents, ["c40", "c80"])}
    assert two == {("r", r["sha"]) for r in history.ancestors(log, log.where("sha in ('c40', 'c80')")).collect()}


def test_parents_that_come_late(spark, tmp_path):
    """Children first: the repository is placed anew, others are left as they are."""
    table, parents = str(tmp_path / "index"), history_of(3, 40)
    other = {"x1": ["x0"], "x0": []}
    lineage.extend(spark, table, frame(spark, parents, [f"c{i}" for i in range(15, 40)]).unionByName(frame(spark, other, repo="o")))
    assert page(spark, table, frame(spark, parents, ["c39"]), ("r", "c39")) == set()  # its parents are not in this log
    lineage.extend(spark, table, frame(spark, parents, [f"c{i}" for i in range(15)]))
    log = frame(spark, parents).unionByName(frame(spark, other, repo="o"))
    wanted = {("r", s) for s in reachable(parents, ["c39"])} | {("o", "x0")}
    assert page(spark, table, log, ("r", "c39"), ("o", "x1")) == wanted
    assert len(places(spark, table)) == 42


def test_a_long_line_with_branches_takes_few_rounds(spark, tmp_path, monkeypatch):
    """A main line of 600 commits; every tenth is a merge of a branch of three that left it before."""
    parents = {"m0": []}
    for i in range(1, 600):
        parents[f"m{i}"] = [f"m{i - 1}"]
        if i % 10 == 0:
            parents |= {f"b{i}.0": [f"m{i - 5}"], f"b{i}.1": [f"b{i}.0"], f"b{i}.2": [f"b{i}.1"]}
            parents[f"m{i}"].append(f"b{i}.2")
    table, log = str(tmp_path / "index"), frame(spark, parents)
    lineage.extend(spark, table, log)
    placed = places(spark, table)
    assert {c for c, _ in placed.values()} == {"m0"} | {f"b{i}.0" for i in range(10, 600, 10)}
    links = sum(len(r["links"]) for r in manifest.read(spark, table).collect())
    assert links == 2 * 59  # one into a branch, one out of it
    rounds, real = [], lineage.settle
    monkeypatch.setattr(lineage, "settle", lambda df, name: rounds.append(name) or real(df, name))
    assert page(spark, table, log, ("r", "m500")) == {("r", s) for s in reachable(parents, ["m500"])}
    assert rounds.count("frontier") <= 4


def test_odd_rows(spark, tmp_path):
    """Repeated rows, missing keys and parents, unknown cursors, no commits at all."""
    table = str(tmp_path / "index")
    empty = spark.createDataFrame([], LOG)
    lineage.extend(spark, table, empty)
    assert page(spark, table, empty, ("r", "a")) == set()
    rows = [("r", "a", None), ("r", "b", ["a", "a"]), ("r", "b", ["a", "a"]), ("r", "c", ["gone", "b"]), ("r", "d", [None, "b"]),
            ("r", "e", ["c"]), (None, "a", ["b"]), ("r", None, ["a"]), ("q", "a", ["b"])]
    log = spark.createDataFrame(rows, LOG)
    lineage.extend(spark, table, log)
    version = lineage.extend(spark, table, log)
    assert version.number == 2  # nothing new, no version
    assert page(spark, table, log, ("r", "b")) == {("r", "a")}
    assert page(spark, table, log, ("r", "c"), ("r", "d"), ("r", "zz"), ("q", "a"), (None, "a")) == set()
    found = lineage.older(spark, table, log, spark.createDataFrame([("r", "e")], KEYS)).collect()
    assert sorted(r["sha"] for r in found) == ["a", "b", "b", "c"]  # as often as the log holds them


def test_circles(spark, tmp_path):
    table = str(tmp_path / "index")
    lineage.extend(spark, table, frame(spark, {"a": []}))
    with pytest.raises(ValueError, match="lead back"):
        lineage.extend(spark, table, frame(spark, {f"c{i}": [f"c{(i + 1) % 5}"] for i in range(5)}))
    assert set(places(spark, table)) == {"a"}
    second = {"x": ["y"], "y": ["a", "x"]}  # through a second parent a page still ends
    lineage.extend(spark, table, frame(spark, second))
    assert page(spark, table, frame(spark, {"a": [], **second}), ("r", "x")) == {("r", s) for s in "axy"}


def test_rounds_move_numbers_and_not_names(spark, tmp_path, monkeypatch):
    """Rounds of placing write no text, and a second extension writes only what is new."""
    kept, real = [], lineage.settle
    monkeypatch.setattr(lineage, "settle", lambda df, name: kept.append((name, real(df, name))) or kept[-1][1])
    table, parents = str(tmp_path / "index"), {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(12)}
    lineage.extend(spark, table, frame(spark, parents, [f"c{i}" for i in range(10)]))
    assert all("string" not in f.dataType.simpleString() for name, df in kept if name == "forest" for f in df.schema)
    monkeypatch.setattr(lineage, "settle", lambda df, name: kept.append((name, real(df, name).count())) or real(df, name))
    kept.clear()
    lineage.extend(spark, table, frame(spark, parents))
    assert dict(kept)["new"] == 2 and "commits" not in dict(kept)
    assert {c for c, _ in places(spark, table).values()} == {"c0"}
