from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from codelabels.llm import queries, toxicity


def scores(spark, texts, model):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["s"] for r in sorted(frame.select("i", toxicity.score(F.col("t"), model).alias("s")).collect())]


@pytest.fixture(scope="module")
def small(spark):
    clean = [f"plain words about number{i} and trees" for i in range(57)] + [f"this lock{i} is idiot proof today" for i in range(3)]
    bad = [f"you are an idiot and a clown number{i}" for i in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(clean + bad)]
    # A label given twice, and one that contradicts it: the toxic one holds.
    labels_more = [(60, 1, 1), (61, 0, 1), (0, 0, 1)]
    docs = spark.createDataFrame([*rows, (None, "idiot", "x"), (200, None, "x")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, int(i >= 60), 1) for i, *_ in rows] + [(None, 1, 1), (5, None, 1)] + labels_more, "doc_id long, toxic int, k int")
    return toxicity.fit(docs, labels)


def test_disguises_and_exceptions(spark, small):
    texts = ["an 1d10t speaks", "such an іdіоt", "ÏDIOT!", "the pond is idiot proof", "idiotic words", "trees", "", None, "word " * 50_000 + "idiot"]
    found = scores(spark, texts, small)
    assert min(found[:3]) >= 0.5 > max(found[3:])
    assert found[6] == found[7] and all(0 <= s <= 1 for s in found)


def test_fit_against_brute_force(spark):
    """Words, weights, exceptions and curve of a small labelled table, by hand."""
    texts = {
        0: [f"a good day{i} at the clown show of x" for i in range(3)] + [f"a fine weather{i} here" for i in range(60)] + ["plain alone here"] * 9,
        1: [f"what a Clown you are{i} scum" for i in range(20)] + [f"q{i} is scum  scum" for i in range(4)] + ["w" * 60 + " zz"] * 9 + [f"{'w' * 60} k{i}" for i in range(12)],
    }
    rows = [(t, y) for y in texts for t in texts[y]]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, min_odds=0.0)
    kinds = {t: max(y for u, y in rows if u == t) for t, _ in rows}
    bad, good = sum(kinds.values()), len(kinds) - sum(kinds.values())
    weights, seen = {}, {}
    for w in {w for t in kinds for w in re.findall(r"\w+", t.lower())}:
        seen[w] = tuple(sum(y == side and w in re.findall(r"\w+", t.lower()) for t, y in kinds.items()) for side in (1, 0))
    seen = {w: ab for w, ab in seen.items() if ab[0] >= 3}
    for w, (a, b) in seen.items():
        odds = math.log((a + 0.5) / (bad + 1)) - math.log((b + 0.5) / (good + 1))
        share = bad / (bad + good)
        proof = a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0)
        if odds >= 0 and proof >= math.log(len(seen) / 0.05):
            weights[w] = odds
    assert dict(model.weights) == pytest.approx(weights) and "w" * 60 in weights and "a" not in weights
    phrases = set()
    for t in kinds:
        words = t.lower().split(" ")
        for n in (2, 3):
            phrases |= {" ".join(words[i : i + n]) for i in range(len(words) - n + 1) if set(words[i : i + n]) & set(weights) and "" not in words[i : i + n]}
    count = lambda p, side: sum(y == side and bool(re.search(rf"\b{p}\b", t.lower())) for t, y in kinds.items())
    assert set(model.exceptions) == {p for p in phrases if count(p, 0) >= 3 and not count(p, 1)} and "the clown show" in model.exceptions
    # The curve's slopes vanish where it was fitted.
    points = docs.select("doc_id", toxicity.density(F.col("text"), model.weights, model.exceptions).alias("d"), "text").dropDuplicates(["text"]).collect()
    miss = [(math.log1p(r["d"]), kinds[r["text"]] - model.score(r["d"])) for r in points]
    for ridge, slope in ((model.offset, [e for _, e in miss]), (model.slope, [x * e for x, e in miss])):
        assert sum(slope) / len(miss) == pytest.approx(1e-3 * ridge, abs=1e-6)


def test_density_against_brute_force(spark):
    weights, spared = (("clown", 1.5), ("scum", 2.0)), ("clown fish",)
    texts = ["clown scum", "clown fish scum", "clowns", "a clown-scum  c1own\nfish", "scum" * 3, "clown fish clown"]

    def brute(text):
        folded = toxicity.fold(text)
        kept = re.sub(r"\bclown fish\b", lambda m: "#" * len(m[0]), folded)
        total = sum(w * len(re.findall(rf"\b{t}\b", kept)) for t, w in weights)
        return 100 * total / (20 + folded.count(" ") + folded.count("\n"))

    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", toxicity.density(F.col("t"), weights, spared).alias("d"))
    assert [r["d"] for r in sorted(frame.collect())] == pytest.approx([brute(t) for t in texts])


def test_without_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert scores(spark, ["a", ""], model) == pytest.approx([0.05, 0.05])
    assert toxicity.fit(docs.limit(0), labels) == model


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op4_toxicity(spark, folder)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 1000
    judged = found.filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert judged.filter("predicted = toxic").count() >= 0.95 * judged.count()
