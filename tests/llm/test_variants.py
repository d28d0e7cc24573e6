from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from codelabels.llm import queries, variants


def near(a, b):
    """One code point inserted, deleted or replaced, by trying them all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts, ratio=10):
    found = {}
    for w, n in counts.items():
        others = sorted(((-m, v) for v, m in counts.items() if near(v, w)), key=lambda x: (x[0], x[1]))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        found[w] = [form, n, len(others), counts[form] if form else None]
    rows = []
    for w, (form, n, k, m) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def letters(rng, low, high, alphabet="abcé"):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(low, high)))


@pytest.mark.parametrize("block,bundle", [(1024, 8192), (3, 50), (1, 7)])
def test_group_against_brute_force(spark, block, bundle):
    rng = random.Random(4)
    counts = {letters(rng, 1, 9): rng.choice((1, 2, 3, 30, 300, 3000)) for _ in range(250)}
    counts |= {"ção" * 4: 5000, "ção" * 4 + "x": 400, "y" + "ção" * 4 + "x": 40, "y" + "ção" * 3 + "xçã": 4, "z": 1, "é": 1, "𝒳bcdefg": 2, "abcdefg": 20, "a" * 5000: 1, "a" * 4999 + "b": 12, "b" + "a" * 4999: 12, "a" * 5001: 2}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = variants.group(frame, block=block, bundle_rows=bundle)
    assert sorted(map(tuple, found.collect())) == brute(counts)


def test_ties_go_to_the_first_word(spark):
    counts = {"abcdefg": 1, "abcdefz": 50, "abcdefh": 50, "zbcdefg": 50, "abcdef": 49}
    rows = {r["word"]: r for r in variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert rows["abcdefg"]["form"] == "abcdefh" and rows["abcdefg"]["n_near"] == 4


def test_vocabulary_and_empty(spark):
    words = spark.createDataFrame([("ab", 1), ("ab", 2), (None, 3), ("", 4), ("abc", 5)], "word string, n int")
    assert sorted(map(tuple, variants.vocabulary(words).collect())) == [("ab", 2), ("abc", 1)]
    assert variants.vocabulary(words, min_chars=3, min_count=2).collect() == []
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.group(empty).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    stock = [letters(rng, 7, 10, "aeté") for _ in range(60)]
    rows = [(i, " ".join(rng.choices(stock, [1 + 40 * (k % 7 == 0) for k in range(60)], k=80)) + " Éäö-Word2words, ab") for i in range(120)]
    rows += [(None, "without keyword"), (None, "without keyword"), (500, None), (501, ""), (502, "x" * 3000), (503, "x" * 3000), (7, rows[7][1]), (504, "×÷ÀÿŠabcdefgh")]
    frame = spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], "doc_id long, text string, word string, n int, run string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found = queries.op11_variants(spark, str(tmp_path))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == brute(kept) and any(r[1] for r in brute(kept))


def test_query_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_variants(spark, str(tmp_path)).collect() == []
