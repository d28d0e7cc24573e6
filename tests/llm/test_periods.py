from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelabels.llm import periods, queries


def brute(words):
    """All runs by extending every pair of equal words q apart, smallest period kept."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def expected(i, text):
    words = planted(i, text)
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *tail, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("cover", [13, 57])
def test_extensions_against_brute_force(cover):
    rng = random.Random(cover)
    texts = [[rng.randrange(2) for _ in range(90)], [1] * 70, [0, 1, 2] * 40, [rng.randrange(50) for _ in range(60)], [5]]
    joined, number = [], []
    for k, t in enumerate(texts):
        joined += [*t, 100 + k]
        number += [k] * (len(t) + 1)
    found = periods.Extensions(np.array(joined), np.array(number), cover)
    pairs = [(i, j) for i in range(len(joined)) for j in range(len(joined)) if i != j and number[i] == number[j]]
    got = found(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))

    def common(i, j):
        n = 0
        while joined[i + n] == joined[j + n]:
            n += 1
        return n

    assert got.tolist() == [common(*p) for p in pairs]


@pytest.mark.parametrize("v", sorted(periods.COVERS))
def test_covers_have_every_difference(v):
    members = periods.COVERS[v]
    assert {(a - b) % v for a in members for b in members} == set(range(v))


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(2)
    texts = [[], [1], [1] * 5, [1] * 6, [1] * 400, [1, 2] * 4, [1, 2] * 3 + [1], [0, *[1, 2, 3] * 4, 9], [1, 1, 2] * 30]
    for _ in range(60):
        text = [rng.randrange(rng.choice((2, 3, 30))) for _ in range(rng.randrange(120))]
        at, period = rng.randrange(len(text) + 1), text[: rng.randrange(1, 9)]
        texts.append(text[:at] + period * rng.randrange(3, 12) + text[at:])
    wanted = [brute(t) for t in texts]
    arrays = [np.array(t, np.int64) for t in texts]
    for cover in (13, 57):
        assert [[tuple(r) for r in rows.tolist()] for rows in periods.find(arrays, cover)] == wanted
    monkeypatch.setattr(periods, "_PAIRS", 7)
    assert [[tuple(r) for r in rows.tolist()] for rows in periods.find(arrays)] == wanted
    assert periods.find([]) == []


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["the", "a", "of", "é", "𝒳", "|", "x1", "-", "word word", "A"]
    rows = [(i, rng.choice([" ", "\n", "\t\x0b", " \r\n "]).join(rng.choices(vocabulary, k=rng.randrange(160)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "na " * 7), (404, "a b " * 5000), (405, "a b " * 5000 + "c"), (None, "la " * 30), (None, None), (7, rows[7][1]), (10, " ".join(rng.choices(vocabulary, k=3000)))]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, start int, runs string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((expected(i, t) for i, t in rows), key=str)


def test_groups_of_texts_do_not_matter(spark, monkeypatch):
    rows = [(i, "x y z " * (i % 7)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted(map(str, frame.select("doc_id", periods.runs(F.col("text"))).collect()))
    monkeypatch.setattr(periods, "GROUP_WORDS", 5)
    assert sorted(map(str, frame.select("doc_id", periods.runs(F.col("text"))).collect())) == found


def test_query_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_runs(spark, str(tmp_path)).collect() == []
