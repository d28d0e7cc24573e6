from __future__ import annotations

import random

import numpy as np

from codelabels.llm import line_dedup
from codelabels.llm.cuckoo import Cuckoo

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """(doc_id, text) rows: per row number of lines, dropped lines, kept text."""
    def key(line):
        return line.strip(BLANKS).translate(LOWER)

    order = {i: (i is None, i or 0) for i, _ in rows}
    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), set())) > 1 and order[i] > min(order[j] for j in h))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def sample(n, seed=1):
    rng = random.Random(seed)
    pool = [f"line number {k} of them" for k in range(30)] + ["short", "", "  ", "A LINE of Text\r", "\ta line of text ", "zehn Zeichen ß", "ÄÄÄÄÄÄÄÄÄÄ", "ääääääääää"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for i in range(n)]
    return rows + [(n, None), (n + 1, "the same hot line\n" * 3), *((n + 2 + k, f"the same hot line\nown {k} text of it") for k in range(40)), (None, "the same hot line\nonly here, nowhere else"), (3, rows[3][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, keys string, doc int")


def found(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = sample(60)
    docs = frame(spark, rows)
    wanted = brute(rows)
    assert found(line_dedup.dedup(docs)) == wanted
    # Many shards and split groups give the same rows.
    state = line_dedup.start(docs, shard_keys=3)
    assert state.shards > 5
    result = line_dedup.dedup(docs, state, group_rows=2)
    assert found(result) == wanted and {"keys", "doc"} <= set(result.columns)


def test_insertions_and_deletions_are_reversible(spark):
    rows = sample(40)
    first, second = frame(spark, rows[:30]), frame(spark, rows[30:])
    state = line_dedup.start(first, shard_keys=8)
    grown = line_dedup.insert(state, second)
    assert found(line_dedup.dedup(frame(spark, rows), grown)) == brute(rows)
    gone = second.filter("doc_id > 3 or doc_id is null")
    left = line_dedup.delete(grown, gone)
    kept = [r for r in rows[:30]] + [rows[-1]]
    assert found(line_dedup.dedup(frame(spark, kept), left)) == brute(kept)
    assert sorted(left.counts.collect()) == sorted(line_dedup.start(frame(spark, kept)).counts.collect())


def largest_group(state):
    """Keys in the largest shard, and the size of its filter in slots."""
    by_shard = state.counts.groupBy(line_dedup._shard(state.shards).alias("s")).count().agg({"count": "max"}).first()[0]
    return by_shard or 0


def test_a_state_that_starts_empty_grows(spark):
    """Ten insertions into an empty state: shards double, tables stay a few folders, nothing is lost."""
    rng = random.Random(3)
    rows = [(i, "\n".join(f"line {rng.randrange(400)} of the pool" for _ in range(12))) for i in range(100)]
    empty = frame(spark, rows).limit(0)
    state, shards, folders = line_dedup.start(empty, shard_keys=25), [], []
    for k in range(10):
        state = line_dedup.insert(state, frame(spark, rows[10 * k : 10 * k + 10]))
        shards.append(state.shards)
        folders.append(max(len(state.held) + len(state.gone), len(state.counted), len(state.filtered)))
        assert largest_group(state) <= 2 * state.shard_keys
    assert shards == sorted(shards) and shards[0] > 1 and shards[-1] >= 16
    assert max(folders) <= line_dedup.PARTS and state.keys == state.counts.count()
    # However many insertions there were, a table is one scan.
    assert all(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1 for df in (state.counts, state.filters, state.references))
    assert found(line_dedup.dedup(frame(spark, rows), state)) == brute(rows)
    for low in (50, 0):
        state = line_dedup.delete(state, frame(spark, rows[low : low + 50]).select("doc_id"))
    assert state.references.count() == state.counts.count() == state.keys == 0
    # Deleted documents may come back.
    again = line_dedup.insert(state, frame(spark, rows[:20]))
    assert found(line_dedup.dedup(frame(spark, rows[:20]), again)) == brute(rows[:20])


def test_small_changes_touch_few_shards(spark):
    rows = sample(60)
    state = line_dedup.start(frame(spark, rows), shard_keys=3)
    grown = line_dedup.insert(state, frame(spark, [(900, "own 3 text of it\nand one more line")]))
    assert grown.shards == state.shards and len(grown.counted) == len(grown.filtered) == 2
    assert spark.read.parquet(grown.filtered[-1]).count() == 1 and spark.read.parquet(grown.counted[-1]).count() == 2
    merged = line_dedup._merged(grown, 1)
    assert len(merged.counted) == len(merged.filtered) == len(merged.held) == 1
    back = line_dedup.delete(merged, frame(spark, [(900, "")]))
    assert sorted(back.counts.collect()) == sorted(state.counts.collect())
    assert sorted(back.references.collect()) == sorted(state.references.collect())


def test_empty(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    assert line_dedup.dedup(docs).collect() == []
    assert found(line_dedup.dedup(frame(spark, [(1, None), (2, "")]))) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_filter_never_misses_and_forgets():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(-(2**62), 2**62, 50_000))
    one = Cuckoo.holding(h)
    assert one.contains(h).all() and one.contains(rng.integers(-(2**62), 2**62, 50_000)).mean() < 0.001
    one.delete(h[::2])
    assert one.contains(h[1::2]).all() and one.contains(h[::2]).mean() < 0.001
    assert one.insert(h[::2]) and Cuckoo.load(one.dump()).contains(h).all()
    full = Cuckoo(4)
    assert not full.insert(h[:17])
