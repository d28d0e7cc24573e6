"""Toxicity by a weighted lexicon, matched over folded text.

Folding undoes accents, look-alike letters of other alphabets and digits or signs
written for letters, so disguised words meet the lexicon. All terms are found in one
pass by an Aho-Corasick automaton; a term inside an exception phrase does not count.
The summed weight is set against the length of the text and turned into a score from
0 to 1 by a logistic curve.

The lexicon, its weights, the exceptions and the curve are fitted on labelled texts, of
which at most `sample` (those with the smallest key hash) are used. Every word over the
odds threshold, and too one-sided for chance, enters the lexicon, whatever its length. Exceptions are phrases of two or
three words around such a word that harmless texts hold and toxic ones do not.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import drawn, plain

# Letters of other alphabets that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухікмтвнѕјԁԛԝһαεορυικντρχ", "aeopcyxikmtbhsjdqwhaeopuikvtpx", strict=True))
# Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
def _fold_table() -> dict[int, str]:
    table = {}
    for point in (*range(0x41, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain_form = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)).casefold()
        if plain_form and plain_form != chr(point):
            table[point] = plain_form
    for odd, letter in LOOKALIKES.items():
        table[ord(odd)] = table[ord(odd.upper())] = letter
    for sign, letter in SIGNS.items():
        table[ord(sign)] = letter
    for point in range(0x300, 0x370):
        table[point] = ""
    return table


@lru_cache(maxsize=1)
def _table() -> dict[int, str]:
    return _fold_table()


def fold(text: str) -> str:
    """Lower case without accents, look-alikes or letters written as digits."""
    return text.translate(_table())


@dataclass(frozen=True)
class Model:
    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    offset: float
    slope: float

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * math.log1p(density)))))


def _automaton(weights: Sequence[tuple[str, float]], exceptions: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in weights:
        found.add_word(term, (len(term), weight))
    for phrase in exceptions:
        folded = fold(phrase)
        found.add_word(folded, (len(folded), None))
    if len(found):
        found.make_automaton()
    return found


def _density(text: str, automaton) -> float:
    """Weight of the terms that stand as whole words outside exception phrases, per 100 words."""
    folded = fold(text)
    n = len(folded)
    hits, spared = [], []
    for last, (length, weight) in automaton.iter(folded) if len(automaton) else ():
        start, end = last + 1 - length, last + 1
        if (start and folded[start - 1].isalnum()) or (end < n and folded[end].isalnum()):
            continue
        (spared if weight is None else hits).append((start, end, weight))
    if not hits:
        return 0.0
    # One sweep by start: a hit is spared if a phrase that began by then reaches its end.
    total, reach, waiting = 0.0, -1, iter(sorted((a, b) for a, b, _ in spared))
    following = next(waiting, None)
    for start, end, weight in sorted(hits):
        while following and following[0] <= start:
            reach, following = max(reach, following[1]), next(waiting, None)
        if end > reach:
            total += weight
    return 100 * total / (20 + folded.count(" ") + folded.count("\n"))


def density(text: Column, weights: Sequence[tuple[str, float]], exceptions: Sequence[str] = ()) -> Column:
    weights, exceptions = tuple(weights), tuple(exceptions)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(weights, exceptions)
        for texts in batches:
            yield pa.array([_density(t, automaton) for t in plain(texts)], pa.float64())

    return run(text)


_WORD = re.compile(r"[^\W_]+")


def _around(text: str, terms: frozenset[str]) -> set[str]:
    """Phrases of two and three words, a space apart, that hold a term."""
    folded = fold(text)
    words = [(m.start(), m.end()) for m in _WORD.finditer(folded)]
    found = set()
    for i, (start, end) in enumerate(words):
        if folded[start:end] not in terms:
            continue
        for low, high in ((i - 1, i), (i, i + 1), (i - 2, i), (i - 1, i + 1), (i, i + 2)):
            if low >= 0 and high < len(words) and all(folded[words[k][1] : words[k + 1][0]] == " " for k in range(low, high)):
                found.add(folded[words[low][0] : words[high][1]])
    return found


def _phrases(text: Column, terms: Sequence[str]) -> Column:
    terms = frozenset(terms)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(_around(t, terms)) for t in plain(texts)], pa.list_(pa.string()))

    return run(text)


def _folded(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fold(t) for t in plain(texts)], pa.string())

    return run(text)


def _curve(points: list[tuple[float, int]], rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Offset and slope of a logistic curve over log density, by Newton's method."""
    import numpy as np

    x = np.array([[1.0, math.log1p(d)] for d, _ in points]).reshape(-1, 2)
    y, w = np.array([t for _, t in points], float), np.zeros(2)
    for _ in range(rounds if len(points) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * len(points) * np.eye(2), x.T @ (y - p) - ridge * len(points) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, min_docs: int = 3, min_odds: float = 2.0, chance: float = 0.05, exceptions: Sequence[str] = ()) -> Model:
    """Fits on at most `sample` labelled texts; `exceptions` are phrases known beforehand.

    A word of `min_docs` toxic texts or more enters if its log odds reach `min_odds` and
    if its texts, dealt at random, would be as one-sided with a probability (by Chernoff's
    bound) below `chance` over the number of such words.

    Rows without key or label are left out; any label but 0 is toxic; of several labels of
    a key the toxic one holds, and equal texts count once. Lexicon and exceptions are as
    large as these texts' vocabulary at most. Without usable labels no word has a weight and
    every score is 0.05, below any verdict.
    """
    chosen = labels.select(F.col(key).alias("k"), (F.col(label) != 0).cast("int").alias("y")).dropna()
    chosen = settle(chosen.groupBy("k").agg(F.max("y").alias("y")), "toxicity-labelled")
    chosen = settle(drawn(chosen, "k", sample), "toxicity-labels")
    # At most `sample` pairs of numbers: a bound that does not depend on the data.
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    # Copies of a text are one witness, not many.
    known = settle(known.groupBy("t").agg(F.max("y").alias("y")).select("y", "t"), "toxicity-texts")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model((), tuple(exceptions), math.log(0.05 / 0.95), 0.0)
    words = known.select("y", F.explode(F.array_distinct(F.split(_folded(F.col("t")), r"[^\p{L}\p{N}]+"))).alias("w")).filter("w <> ''")
    counts = words.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") >= min_docs)
    counts, share = settle(counts, "toxicity-words"), bad / (bad + good)
    odds = F.log((F.col("a") + 0.5) / (bad + 1.0)) - F.log((F.col("b") + 0.5) / (good + 1.0))
    n = F.col("a") + F.col("b")
    proof = F.col("a") * F.log(F.col("a") / n / share) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / n / (1 - share))).otherwise(F.lit(0.0))
    found = counts.select("w", odds.alias("odds"), proof.alias("proof")).filter((F.col("odds") >= min_odds) & (F.col("proof") >= math.log(max(1, counts.count()) / chance))).orderBy("w").collect()
    weights = tuple((r["w"], float(r["odds"])) for r in found)
    near = known.select("y", F.explode(_phrases(F.col("t"), [w for w, _ in weights])).alias("p"))
    near = near.groupBy("p").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter((F.col("a") == 0) & (F.col("b") >= min_docs))
    spared = (*exceptions, *(r["p"] for r in near.orderBy("p").collect()))
    points = known.select(density(F.col("t"), weights, spared).alias("d"), "y").collect()
    offset, slope = _curve(sorted((r["d"], r["y"]) for r in points))
    return Model(weights, spared, offset, slope)


def score(text: Column, model: Model) -> Column:
    """Score from 0 to 1; null and empty texts get the score of a text without hits.

    A text of any length is searched whole, in one pass; equal texts get equal scores.
    """
    x = model.offset + model.slope * F.log1p(density(text, model.weights, model.exceptions))
    return 1 / (1 + F.exp(-x))


def for_training(key: Column, folds: int = 5) -> Column:
    """True for rows that may be learnt from: crc32 of the key as text is not divisible by `folds`."""
    return F.crc32(key.cast("string")) % folds != 0
