from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from codelabels.llm import quality, queries

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = text.split("\n")
    dup = sum(bool(re.search(WORD, x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rng = random.Random(2)
    made = [" ".join(rng.choice(["a", "bb", "#", "Ünï", "日本", "x|y", "<a>", "é\u00a0b"]) + rng.choice(["", "", "\n", " \t"]) for _ in range(rng.randrange(90))) for _ in range(60)]
    run = " ".join(f"w{i}" for i in range(12))
    return [*made, None, "", " \n \n", "one", f"{run} {run}", f"{run} x {run} y {run}", "same\nsame\n same\nsame", "w " * 20_000, "tail\x0bof\x0ctext\u2003here", run]


def test_counts_against_brute_force(spark):
    frame = spark.createDataFrame(list(enumerate(texts())), "i int, t string").select("i", quality.counts(F.col("t")).alias("c")).select("i", "c.*")
    found = [tuple(r)[1:6] for r in sorted(frame.collect())]
    short = [t for t in texts() if len(t or "") < 10_000]
    assert [f for f, t in zip(found, texts(), strict=True) if len(t or "") < 10_000] == [brute(t) for t in short]
    assert found[-3] == (20_000, 20_000, 0, 0, 20_000)
    assert quality.counts(F.col("t")) is not None and frame.limit(0).collect() == []


def test_estimates_accuracies(spark):
    rng = random.Random(4)
    rules = tuple((f"r{k}", int(k > 3), "true") for k in range(8))
    right, rows = (0.9, 0.7, 0.6, 0.8, 0.9, 0.7, 0.8, 0.6), []
    for i in range(6000):
        good = rng.random() < 0.8
        bits = sum((rng.random() < (right[k] if good == bool(rules[k][1]) else 0.05 * (1 + k % 2))) << k for k in range(8))
        rows.append((i, bits, int(good)))
    frame = spark.createDataFrame(rows, "i int, votes int, good int")
    model = quality.fit(frame, rules=rules)
    judged = frame.select("good", (model.probability(F.col("votes")) >= 0.5).cast("int").alias("p"))
    assert judged.filter("good = p").count() > 0.97 * 6000
    assert all(a > 0.6 for a in model.accuracy)


def test_without_rows(spark):
    model = quality.fit(spark.createDataFrame([], "votes int"))
    assert spark.range(1).select(model.probability(F.lit(3))).first()[0] == 0.5


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op5_quality(spark, folder)
    assert found.columns[:8] == ["doc_id", *quality.COUNTS[:5], "base_failed", "kept"] and found.count() == 1000
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    judged = found.filter("n_words >= 20").join(labels, "doc_id")
    assert judged.filter("kept and label = 1").count() >= 0.97 * judged.filter("label = 1").count()
    assert judged.filter("not kept and label = 0").count() >= 0.9 * judged.filter("label = 0").count()


def brute_votes(text):
    """The twelve rules on a text, each stated anew."""
    text = text or ""
    words = re.findall(WORD, text)
    n, chars, symbols, dup, repeated = brute(text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    capitals, small, bangs = (len(re.findall(p, text)) for p in ("[A-Z]", "[a-z]", "!"))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        n < 20, symbols * 10 > n, capitals * 10 > 3 * (capitals + small), bangs * 10 > n, dup * 10 > 3 * len(lines), repeated * 10 > 3 * n, same * 5 > n, chars * 2 < 5 * n or chars > 15 * n,
        n >= 50, symbols * 50 <= n and bangs * 50 <= n and capitals * 10 <= capitals + small and n > 0, same * 20 <= n and 3 * n <= chars <= 12 * n and n > 0, dup == 0 and repeated * 10 <= n and n > 0,
    ]


def brute_em(votes, sides, rounds=500):
    """Posterior chance of good per document, one document at a time."""
    k, good = range(len(sides)), []
    for v in votes:
        up, down = (sum(v[i] for i in k if sides[i] == side) for side in (True, False))
        good.append((up + 1) / (up + len(sides) * down + 2))
    for _ in range(rounds):
        n_good, n_bad = sum(good), sum(1 - g for g in good)
        prior = (n_good + 1) / (n_good + n_bad + 2)
        odds = []
        for i in k:
            yes = (sum(g for g, v in zip(good, votes, strict=True) if v[i]) + 1) / (n_good + 2)
            no = (sum(1 - g for g, v in zip(good, votes, strict=True) if v[i]) + 1) / (n_bad + 2)
            if (yes > no) != sides[i]:
                yes = no = (sum(v[i] for v in votes) + 1) / (len(votes) + 2)
            odds.append((math.log((1 - yes) / (1 - no)), math.log(yes / no)))
        after = [1 / (1 + math.exp(-max(-50, min(50, math.log(prior / (1 - prior)) + sum(o[v[i]] for i, o in enumerate(odds)))))) for v in votes]
        if max(abs(a - b) for a, b in zip(after, good, strict=True)) < 1e-9:
            return after
        good = after
    return good


def test_query_against_brute_force(spark, tmp_path):
    """Counts, votes, expectation-maximisation and verdict of the whole query, with repeated rows and clashing columns."""
    rng = random.Random(11)
    plain = [" ".join(rng.choice(["the", "house", "garden", "runs", "over", "small", "trees"]) for _ in range(rng.randrange(5, 120))) for _ in range(70)]
    junk = [" ".join(rng.choice(["###", "$$$", "BUY", "NOW!!!", "x"]) for _ in range(rng.randrange(20, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate([t for t in texts() if len(t or "") < 10_000] + plain + junk)]
    rows += [(3, rows[3][1]), (None, plain[0]), (None, None), (900, "long words here " * 3000)]
    spark.createDataFrame([(i, t, 1, True, 0.5) for i, t in rows], "doc_id long, text string, n_words int, kept boolean, quality double").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, queries.op5_quality(spark, str(tmp_path)).collect()), key=str)
    votes = [brute_votes(t) if len(t or "") < 10_000 else brute_votes("long words here " * 40) for _, t in rows]
    sides = [side == 1 for _, side, _ in quality.RULES]
    chances = brute_em(votes, sides)
    wanted = []
    for (i, t), chance in zip(rows, chances, strict=True):
        n = brute(t) if len(t or "") < 10_000 else (9000, 9000 // 3 * 13, 0, 0, 9000)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        wanted.append((i, *n, failed, not failed and chance >= 0.5, chance))
    wanted = sorted(wanted, key=str)
    assert [f[:8] for f in found] == [w[:8] for w in wanted]
    assert all(math.isclose(f[8], w[8], abs_tol=1e-6) for f, w in zip(found, wanted, strict=True))
    assert 0 < sum(w[7] for w in wanted) < len(wanted)


def test_query_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op5_quality(spark, str(tmp_path)).collect() == []
