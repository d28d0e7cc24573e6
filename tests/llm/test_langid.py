from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelabels.llm import langid, queries

PARTS = {"en": ["the", "ing", "tion", "wh", "and", "ly"], "de": ["der", "ung", "sch", "keit", "ß", "ein"], "fr": ["que", "eau", "ment", "é", "oi", "les"]}


def text_of(rng, lang, words):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randrange(1, 4))) for _ in range(words))


def rows(n=600):
    rng = random.Random(1)
    return [(i, text_of(rng, lang := rng.choice(list(PARTS)), rng.choice((4, 30, 300))), lang, "x", 0.5) for i in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("languages"))
    odd = [(9000, None, "en"), (9001, "", "en"), (9002, " 12 ²3\n", "de"), (9003, "der keit ung", None), (None, "the and ing", "en"), (9004, "the ing and " * 20_000, "en"), (9005, "Ж", None)]
    data = rows() + [(*r, "x", 0.5) for r in odd] + [rows()[3]]
    spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred string, score double").write.parquet(f"{path}/documents.parquet")
    return path


def test_held_out_accuracy(spark, folder):
    found = queries.op13_langid(spark, folder).collect()
    truth = {r[0]: r[2] for r in rows()}
    assert len(found) == 608
    for r in found:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert pred[9000] == pred[9001] == pred[9002] == ("und", 0.0)
    assert pred[9003][0] == "de" and pred[None][0] == "en" and pred[9004][0] == "en" and pred[9005][0] in PARTS


def test_columns_of_the_label_are_no_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(docs.filter("doc_id < 300"))
    one = docs.select("doc_id", langid.identify(F.col("text"), model).alias("f")).collect()
    two = docs.withColumn("lang", F.lit(None).cast("string")).select("doc_id", langid.identify(F.col("text"), model).alias("f")).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_nothing_to_learn_from(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(5)
    model = langid.fit(docs.filter("false"))
    assert {tuple(r["f"]) for r in docs.select(langid.identify(F.col("text"), model).alias("f")).collect()} == {("und", 0.0)}


def test_query_without_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_langid(spark, str(tmp_path)).collect() == []


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        data = bytes(i % 251 for i in range(n))
        cuts = langid.cut(data)
        for width in langid.WIDTHS:
            seen = {w[i : i + width] for w in cuts for i in range(len(w) - width + 1)}
            assert seen == {data[i : i + width] for i in range(n - width + 1)}
        assert b"".join(c[: langid.STRIDE] if k < len(cuts) - 1 else c for k, c in enumerate(cuts)) == data


def test_network_against_plain_sums():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (20, langid.WINDOW), dtype=np.uint8)
    model = langid.train(windows, rng.integers(0, 3, 20), ("a", "b", "c"), rounds=2)
    got = langid.Network(model).probabilities(windows)
    for row, x in zip(got, windows, strict=True):
        pooled = [max(sum(f[k, x[i + k], j] for k in range(len(f))) for i in range(len(x) - len(f) + 1)) for f in model.filters for j in range(f.shape[2])]
        seen = np.maximum(np.array(pooled) + model.biases, 0)
        e = np.exp(seen @ model.weights + model.offsets)
        np.testing.assert_allclose(row, e / e.sum(), rtol=1e-4)


def test_slopes_lower_the_loss():
    rng = np.random.default_rng(5)
    windows = np.concatenate([rng.integers(97, 104, (60, langid.WINDOW)), rng.integers(101, 110, (60, langid.WINDOW))]).astype(np.uint8)
    labels = np.repeat([0, 1], 60)
    loss = []
    for rounds in (0, 6):
        p = langid.Network(langid.train(windows, labels, ("a", "b"), rounds=rounds)).probabilities(windows)
        loss.append(-np.log(p[np.arange(120), labels]).mean())
    assert loss[1] < 0.1 < loss[0]
