"""Scorers for code windows.

A scorer maps a frame with a ``code`` column to the same frame with
``prediction ARRAY<INT>`` in the order of its ``labels`` instead (plus
``elapsed_time`` and ``error`` where it can tell), dropping ``code`` so that no
text outlives scoring.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorSlicer
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.text import TOKENS, token_words
from ..functions.values import decide
from ..schemas import LABELS, THRESHOLD
from ..session import settle
from ..sources import seen

MIN_HITS = 8
# Label number -> initials of the tokens that speak for it: a..z, then the rest.
INITIALS = [chr(ord("a") + i) for i in range(26)] + ["$_0123456789"]


def token_initials(code: Column) -> Column:
    """The first character of every token, in lower case, as one text."""
    # One match a token takes in what follows it; Java's \w is ASCII.
    return F.lower(F.regexp_replace(code, r"([\w$])[\w$]*+[^\w$]*+|^[^\w$]++", "$1"))


def hits(initials: Column, chars: str) -> Column:
    """How many tokens start with one of ``chars``: what their removal shortens."""
    left = initials
    for ch in chars:
        left = F.replace(left, F.lit(ch), F.lit(""))
    return F.length(initials) - F.length(left)


@dataclass
class RuleScorer:
    """Counts tokens by first character; enough of one kind shows its label.

    Stands in for a trained network where none is at hand. One regex pass keeps
    each token's first letter; the counts are plain text replacements on that,
    all inside generated code.
    """

    labels: list[str] = field(default_factory=lambda: list(LABELS))
    initials: Sequence[str] = field(default_factory=lambda: list(INITIALS))
    min_hits: int = MIN_HITS
    can_fail = False

    def __call__(self, windows: DataFrame) -> DataFrame:
        rest = [c for c in windows.columns if c != "code"]
        named = windows.select(*rest, token_initials(F.col("code")).alias("_heads"))
        # A null window keeps null predictions: nothing was seen.
        shown = [(hits(F.col("_heads"), chars) >= self.min_hits).cast("int") for chars in self.initials]
        return named.select(*rest, F.array(*shown).alias("prediction"))


@dataclass
class ArrowScorer:
    """Scores batches of windows with any Python model.

    ``load`` runs once per Python worker, which serves many tasks, and returns a
    function from a list of texts to a (texts x labels) array of logits. It gets
    at most ``batch`` texts at a time, whatever the size of Arrow's batches, and
    texts of like length together, as models fill texts up to the longest one.
    Texts that fail together are retried one by one, so an error marks only the
    window it belongs to.
    """

    load: Callable[[], Callable[[list[str]], np.ndarray]]
    labels: list[str] = field(default_factory=lambda: list(LABELS))
    threshold: float = THRESHOLD
    batch: int = 256
    parts: int | None = None
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __call__(self, windows: DataFrame) -> DataFrame:
        load, width, size, token = self.load, len(self.labels), self.batch, self.token

        @F.pandas_udf("logits array<double>, elapsed_time double, error string")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            import sys

            # Kept in the worker, not in this function, which every task gets anew. One model at a time.
            kept = vars(sys).setdefault("_codelabels_model", {})
            if token not in kept:
                kept.clear()
                kept[token] = load()
            predict = kept[token]

            def one(code: str):
                try:
                    return np.asarray(predict([code]), dtype=float)[0], None
                except Exception as problem:  # noqa: BLE001 - reported as data
                    return np.full(width, -np.inf), str(problem) or type(problem).__name__

            def some(texts: list[str]):
                try:
                    return [(row, None) for row in np.asarray(predict(texts), dtype=float)]
                except Exception:  # noqa: BLE001 - find the window at fault
                    return [one(text) for text in texts]

            for codes in batches:
                begun = time.perf_counter()
                known = codes.notna()
                texts = codes[known].tolist()
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
                pairs = [None] * len(texts)
                for at in range(0, len(texts), size):
                    chosen = order[at : at + size]
                    for i, pair in zip(chosen, some([texts[i] for i in chosen]), strict=True):
                        pairs[i] = pair
                share = (time.perf_counter() - begun) / max(len(codes), 1)
                found = iter(pairs)
                rows = [next(found) if k else (None, None) for k in known]
                logits = [None if row is None else row.tolist() for row, _ in rows]
                yield pd.DataFrame({"logits": logits, "elapsed_time": share, "error": [problem for _, problem in rows]}, dtype=object)

        source = windows.repartition(self.parts) if self.parts else windows
        rest = [c for c in windows.columns if c != "code"]
        scored = source.select(*rest, score("code").alias("_score"))
        # A null window (a file without any) has no logits and so no prediction.
        return scored.select(
            *rest,
            decide(F.col("_score.logits"), self.threshold).alias("prediction"),
            F.col("_score.elapsed_time").alias("elapsed_time"),
            F.col("_score.error").alias("error"),
        )


VERDICT = StructType(
    [
        StructField("window", StringType()),
        StructField("prediction", ArrayType(IntegerType())),
        StructField("elapsed_time", DoubleType()),
    ]
)


@dataclass
class ScoreOnce:
    """Scores each distinct window once, now and in later runs.

    Versions of a file share most of their windows. Here windows are known by the
    hash of their text. Only texts without a kept verdict go to ``scorer``, each
    once; verdicts without an error are added to ``index`` (:mod:`..sources.seen`)
    and found there by later runs at the cost of what they ask. Keep one index per
    model. Windows are cut twice, once for their hashes and once for the texts that
    are new, so this pays where a model costs more than cutting does.
    """

    scorer: Callable
    index: str

    @property
    def labels(self) -> list[str]:
        return self.scorer.labels

    @property
    def can_fail(self) -> bool:
        return getattr(self.scorer, "can_fail", True)

    def __call__(self, windows: DataFrame) -> DataFrame:
        spark = windows.sparkSession
        hashed = windows.withColumn("window", F.sha2("code", 256))
        places = settle(hashed.drop("code"), "window-places")
        asked = settle(places.select("window").where(F.col("window").isNotNull()).distinct(), "window-hashes")
        known = settle(seen.lookup(spark, self.index, asked, "window", VERDICT).select(*VERDICT.fieldNames()), "window-known")
        new = settle(asked.join(known, "window", "left_anti"), "window-new")
        texts = hashed.select("window", "code").join(new, "window", "left_semi")
        scored = self.scorer(texts.groupBy("window").agg(F.first("code").alias("code")))
        for name, kind in (("elapsed_time", "double"), ("error", "string")):
            if name not in scored.columns:
                scored = scored.withColumn(name, F.lit(0.0 if kind == "double" else None).cast(kind))
        scored = settle(scored.select(*VERDICT.fieldNames(), "error"), "window-verdicts")
        seen.remember(spark, self.index, scored.where("error is null").drop("error"), "window", uuid.uuid4().hex, 0)
        verdicts = scored.unionByName(known.withColumn("error", F.lit(None).cast("string")))
        # Hot windows, such as the empty one, meet a plain table of one row each: AQE can split them.
        return places.join(settle(verdicts, "window-all"), "window", "left").drop("window")


def rule_model(labels: int = len(LABELS), min_hits: int = MIN_HITS) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """The rule of :class:`RuleScorer` as a loadable Python model."""

    def load():
        import re

        first = re.compile(f"({TOKENS[:-1]}){TOKENS[:-1]}*")
        column = {ch: i for i, chars in enumerate(INITIALS[:labels]) for ch in chars}

        def predict(texts: list[str]) -> np.ndarray:
            counts = np.zeros((len(texts), labels))
            for row, text in enumerate(texts):
                found = [column[ch] for ch in (m.lower() for m in first.findall(text)) if ch in column]
                counts[row] = np.bincount(found, minlength=labels)
            return counts - (min_hits - 0.5)

        return predict

    return load


# --- one binary classifier per label ---------------------------------------

# Columns whose name starts so are the same for all labels.
SHARED = "shared_"


def fan_out(
    windows: DataFrame,
    models: dict[str, Callable[[Column], Column]],
    prepare: Callable[[Column], Column] = lambda code: code,
) -> DataFrame:
    """Every expression model scores every window: one row per (model, window).

    The models are a literal list inside each row, so nothing is joined and the
    text is dropped as soon as it is scored. ``prepare`` is the part they share.
    """
    rest = [c for c in windows.columns if c != "code"]
    ready = windows.select(*rest, prepare(F.col("code")).alias("_input"))
    verdicts = [F.struct(F.lit(n).alias("model"), m(F.col("_input")).cast("int").alias("prediction")) for n, m in models.items()]
    return ready.select(*rest, F.inline(F.array(*verdicts)))


def initial_models(names: Sequence[str], min_hits: int = MIN_HITS) -> dict[str, Callable[[Column], Column]]:
    """The rule of :class:`RuleScorer` as one expression model per name ``Kn``.

    The models read :func:`token_initials` of a window.
    """

    def model(chars: str) -> Callable[[Column], Column]:
        return lambda initials: hits(initials, chars) >= min_hits

    return {n: model(INITIALS[(int(n[1:]) - 1) % len(INITIALS)]) for n in names}


def allowed(registry: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Registry rows on the allow-list (column ``name``); None allows all."""
    return registry if names is None else registry.where(F.col("name").isin(*names))


class BestFeatures(Estimator):
    """Chooses the ``top`` binary features that depend most on a 0/1 label (chi-squared; ties to smaller numbers).

    One aggregate counts all features; only these counts, two a feature, reach the driver.
    """

    def __init__(self, counts: str, output: str, top: int, label: str = "label") -> None:
        super().__init__()
        self.counts, self.output, self.top, self.label = counts, output, top, label

    def _fit(self, rows: DataFrame) -> VectorSlicer:
        by_label = rows.groupBy(F.col(self.label).cast("double").alias("y")).agg(
            F.count(F.lit(1)).alias("n"), Summarizer.numNonZeros(F.col(self.counts)).alias("held")
        )
        found = {r["y"]: (float(r["n"]), r["held"].toArray()) for r in by_label.collect()}
        if not found:
            raise ValueError("no row to choose features from")
        n, held = sum(m for m, _ in found.values()), sum(h for _, h in found.values())
        total, both = found.get(1.0, (0.0, np.zeros_like(held)))
        # The four cells' formula of chi-squared; a feature in all rows or in none tells nothing.
        spread = held * (n - held) * total * (n - total)
        gap = both * (n - total - held + both) - (held - both) * (total - both)
        chi = np.divide(n * gap**2, spread, out=np.zeros_like(held), where=spread > 0)
        order = np.argsort(-chi, kind="stable")
        return VectorSlicer(inputCol=self.counts, outputCol=self.output, indices=sorted(int(i) for i in order[: self.top]))


def classifier(name: str, features: int = 1 << 15, top: int = 200, grams: int = 2, rounds: int = 100) -> Pipeline:
    """Untrained per-label pipeline: hashed n-grams, best features, linear model.

    Every n-gram counts; ``features`` is the number of hash buckets. The words,
    n-grams and counts have the same column names in all labels' pipelines, so that
    :func:`classify` makes them once.
    """
    words, pairs, counts, best = "shared_words", f"shared_grams_{grams}", f"shared_counts_{grams}_{features}", f"{name}_best"
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="tokens", outputCol=words, pattern=r"\s+", toLowercase=False),
            NGram(n=grams, inputCol=words, outputCol=pairs),
            HashingTF(inputCol=pairs, outputCol=counts, numFeatures=features, binary=True),
            BestFeatures(counts, best, top),
            LogisticRegression(
                featuresCol=best,
                labelCol="label",
                predictionCol=f"{name}_prediction",
                rawPredictionCol=f"{name}_raw",
                probabilityCol=f"{name}_probability",
                maxIter=rounds,
                regParam=0.01,
                threshold=THRESHOLD,
            ),
        ]
    )


def with_tokens(windows: DataFrame) -> DataFrame:
    """Windows of normalised lines reduced to the classifiers' token text; those without code have it already."""
    if "code" not in windows.columns:
        return windows
    return windows.withColumn("tokens", token_words(F.coalesce("code", F.lit("")))).drop("code")


def _output(stage: Transformer) -> str:
    return stage.getOutputCol() if stage.hasParam("outputCol") else ""


def _is_shared(stage: Transformer) -> bool:
    return _output(stage).startswith(SHARED)


def left_over(stages: Sequence[Transformer], columns: Sequence[str]) -> list[Transformer]:
    """The stages after the last one whose output is already there."""
    made = [i for i, stage in enumerate(stages) if _output(stage) in columns]
    return list(stages[made[-1] + 1 :] if made else stages)


def featured(windows: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Windows as the counts the models share, without texts: settled, they serve any number of :func:`classify` calls."""
    rest, made, last = _own_columns(windows), with_tokens(windows), []
    for model in models.values():
        shared = [stage for stage in model.stages if _is_shared(stage)]
        for stage in left_over(shared, made.columns):
            made = stage.transform(made)
        last += [_output(stage) for stage in shared[-1:]]
    return made.select(*rest, *dict.fromkeys(last))


def same_features(one: dict[str, PipelineModel], other: dict[str, PipelineModel]) -> bool:
    """Do both make their shared columns by the same stages with the same parameters?"""

    def made(models: dict[str, PipelineModel]) -> set[str]:
        return {
            repr((type(stage).__name__, sorted((p.name, v) for p, v in stage.extractParamMap().items())))
            for model in models.values() for stage in model.stages if _is_shared(stage)
        }

    return made(one) == made(other)


def fit_each(rows: DataFrame, targets: dict[str, str], **choices: int) -> dict[str, PipelineModel]:
    """A classifier per name, fitted to its 0/1 column of token texts (``tokens``).

    The counts that all share are made once and settled; every pass of every fit reads those.
    """
    stages = {name: classifier(name, **choices).getStages() for name in targets}
    shared = {name: [s for s in own if isinstance(s, Transformer) and _is_shared(s)] for name, own in stages.items()}
    counts = settle(featured(rows, {name: PipelineModel(own) for name, own in shared.items()}), "training-counts")
    models = {}
    for name, target in targets.items():
        own = Pipeline(stages=stages[name][len(shared[name]) :])
        models[name] = PipelineModel(shared[name] + own.fit(counts.withColumn("label", F.col(target).cast("double"))).stages)
    return models


def _own_columns(windows: DataFrame) -> list[str]:
    return [c for c in windows.columns if c not in ("code", "tokens") and not c.startswith(SHARED)]


def classify(windows: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Every classifier scores every window: one row per (model, window).

    Stages whose output is there (words, n-grams, counts), made by an earlier
    model or :func:`featured`, are not run again.
    """
    rest = _own_columns(windows)
    scored = with_tokens(windows)
    for name, model in models.items():
        kept = list(scored.columns)
        for stage in left_over(model.stages, scored.columns):
            scored = stage.transform(scored)
            if _is_shared(stage):
                kept.append(_output(stage))
        scored = scored.select(*kept, F.col(f"{name}_prediction").cast("int").alias(f"{name}_prediction"))
    verdicts = [F.struct(F.lit(n).alias("model"), F.col(f"{n}_prediction").alias("prediction")) for n in models]
    return scored.select(*rest, F.inline(F.array(*verdicts)))


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder.rstrip('/')}/{name}")


def model_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sub-folders that hold a complete saved pipeline (name, stages).

    Read from the pipelines' own metadata, so folders lacking a vectoriser,
    selector or model are passed over.
    """
    place = folder.rstrip("/")
    lines = spark.read.option("recursiveFileLookup", "true").text([f"{place}/*/metadata", f"{place}/*/stages/*/metadata"])
    meta = lines.select(
        F.regexp_extract(F.input_file_name(), r"/([^/]+)/(?:stages/[^/]+/)?metadata/part-[^/]*$", 1).alias("name"),
        F.get_json_object("value", "$.class").alias("class"),
    ).where("name <> '' and class is not null")
    has = {
        "vectoriser": F.max(F.col("class").rlike("CountVectorizerModel|HashingTF")),
        "selector": F.max(F.col("class").rlike("SelectorModel|VectorSlicer")),
        "model": F.max(F.col("class").rlike(r"\.classification\.")),
    }
    found = meta.groupBy("name").agg(*[test.alias(part) for part, test in has.items()])
    return found.where("vectoriser and selector and model").select("name")


def load_models(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict[str, PipelineModel]:
    """Saved classifiers by name; the list of names is short by nature."""
    chosen = allowed(model_names(spark, folder), names).orderBy("name")
    return {row["name"]: PipelineModel.load(f"{folder.rstrip('/')}/{row['name']}") for row in chosen.toLocalIterator()}
