"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of fixed length, which overlap so that no filter misses a
byte sequence at a border. Filters of several widths slide over the bytes of a window; of
each filter the largest response counts, cut off below zero; a softmax over these gives
the window's language. A text's probabilities are the mean of its windows', weighted by
their bytes, so every byte of a text takes part.

Filters look at single bytes (one weight per filter, offset and byte value), so a
response is a sum of table entries. For use the entries of neighbouring offsets are added up
beforehand in tables over byte pairs, which halves the look-ups and changes no result.

The network is trained on windows of at most `sample` labelled texts, as many of each
language: those with the smallest key hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import below, plain

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
SAMPLE, CUTS = 4_000, 3  # labelled texts, windows of each
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_BATCH = 1 << 9  # windows scored at a time; their responses fit in a processor's cache


@dataclass(frozen=True, eq=False)
class Model:
    languages: tuple[str, ...]
    filters: tuple[np.ndarray, ...]  # per width: offset x byte x filter
    biases: np.ndarray  # all filters
    weights: np.ndarray  # all filters x language
    offsets: np.ndarray  # language


def cut(data: bytes) -> list[bytes]:
    """Windows that cover all bytes; neighbours share the widest filter's reach."""
    return [data[at : at + WINDOW] for at in range(0, max(1, len(data) - WINDOW + STRIDE), STRIDE)]


def padded(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)


def _pair_tables(filters: np.ndarray) -> list[np.ndarray]:
    """Summed responses of two neighbouring bytes, per pair of offsets; the last may stand alone."""
    tables = [(filters[k][:, None, :] + filters[k + 1][None, :, :]).reshape(1 << 16, -1) for k in range(0, len(filters) - 1, 2)]
    return [np.ascontiguousarray(t) for t in tables] + ([np.ascontiguousarray(filters[-1])] if len(filters) % 2 else [])


class Network:
    """A model made ready for scoring windows."""

    def __init__(self, model: Model):
        self.model, self.tables = model, [_pair_tables(f) for f in model.filters]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Window x language, for rows of padded bytes."""
        pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        pooled = []
        for width, tables in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - width + 1
            total = None
            for k, table in enumerate(tables):
                part = table.take((pairs if len(table) > 256 else windows)[:, 2 * k : 2 * k + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(1))
        seen = np.maximum(np.concatenate(pooled, axis=1) + self.model.biases, 0)
        return _softmax(seen @ self.model.weights + self.model.offsets)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], rounds: int = 12, batch: int = 128, rate: float = 0.02, seed: int = 1) -> Model:
    """Minimises cross-entropy by Adam; filters, pooling and softmax are trained together."""
    rng = np.random.default_rng(seed)
    n_all, n_lang = FILTERS * len(WIDTHS), len(languages)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(n_all, np.float32), rng.normal(0, 0.3, (n_all, n_lang)).astype(np.float32), np.zeros(n_lang, np.float32)]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    gold, turn = np.eye(n_lang, dtype=np.float32)[labels], 0
    columns = np.arange(FILTERS)
    for _ in range(rounds if n_lang > 1 else 0):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            x, rows = windows[some], np.arange(len(some))[:, None]
            peaks, pooled = [], []
            for width, filters in zip(WIDTHS, params, strict=False):
                n = WINDOW - width + 1
                response = sum(filters[k].take(x[:, k : k + n], axis=0) for k in range(width))
                peaks.append(response.argmax(1))
                pooled.append(np.take_along_axis(response, peaks[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + params[-3]
            seen = np.maximum(raw, 0)
            slope = (_softmax(seen @ params[-2] + params[-1]) - gold[some]) / len(some)
            inner = (slope @ params[-2].T) * (raw > 0)
            slopes = []
            for k, (width, peak) in enumerate(zip(WIDTHS, peaks, strict=True)):
                # Only the bytes under a filter's largest response pass its slope on.
                part = inner[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros((width, 256, FILTERS), np.float32)
                for t in range(width):
                    np.add.at(grad[t], (x[rows, peak + t], columns), part)
                slopes.append(grad)
            slopes += [inner.sum(0), seen.T @ slope, slope.sum(0)]
            turn += 1
            for p, g, m, v in zip(params, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Model(languages, tuple(params[: len(WIDTHS)]), *params[len(WIDTHS) :])


def _drawn(text: Column, cuts: int) -> Column:
    """Windows of a text for training: up to `cuts` whole ones at places drawn by the text's checksum, and one short piece."""

    @F.arrow_udf("array<binary>")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in plain(texts):
            data = t.encode("utf-8", "replace")
            every, draw = cut(data), np.random.default_rng(zlib.crc32(data))
            chosen = draw.permutation(len(every))[:cuts]
            rows = [every[k] for k in chosen]
            # Short texts are as common as long ones: a piece of 16 bytes or more is learnt too.
            size = int(draw.integers(16, WINDOW))
            at = int(draw.integers(0, max(1, len(data) - size)))
            out.append([*rows, data[at : at + size]])
        return pa.array(out, pa.list_(pa.binary()))

    return run(text)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, cuts: int = CUTS) -> Model:
    """Trains on at most `sample` rows with key, text and language, at most `cuts` + 1 windows of each.

    All languages that occur are learnt, if there are no more than `sample`; none gives a
    model without languages. Which rows are taken does not depend on their order; of
    repeated rows one counts.
    """
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")).filter("k is not null and lang is not null and length(t) > 0")
    known = known.filter(F.col("t").rlike(r"\p{L}"))
    sizes = settle(known.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    languages = [r["lang"] for r in sizes.select("lang").orderBy("lang").limit(sample).collect()]
    if not languages:
        return Model((), (), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    each = max(1, sample // len(languages))
    # About twice as many as are taken pass by their hash alone, whatever a language's size; only these are ranked.
    drawn = known.select("lang", "k", F.xxhash64("t").alias("h"), F.xxhash64("k", F.lit(1)).alias("draw"))
    drawn = drawn.join(sizes, "lang").filter(below(F.col("draw"), (2.0 * each + 100) / F.col("n"))).select("lang", "k", "h", "draw").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "k", "h"))
    ids = settle(drawn.withColumn("rank", rank).filter(F.col("rank") <= each).select("lang", "k", "h"), "language-sample")
    # At most `sample` rows of two numbers and a name.
    found = known.withColumn("h", F.xxhash64("t")).join(F.broadcast(ids), ["lang", "k", "h"])
    pieces = found.dropDuplicates(["lang", "k", "h"]).select("lang", F.explode(_drawn(F.col("t"), cuts)).alias("w"))
    rows = sorted((r["lang"], bytes(r["w"])) for r in pieces.collect())
    windows, place = padded([w for _, w in rows]), {name: i for i, name in enumerate(languages)}
    return train(windows, np.array([place[name] for name, _ in rows], np.int64), tuple(languages))


def _has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def scores(texts: list[str], network: Network) -> list[tuple[str, float]]:
    """(language, mean probability) per text; (`und`, 0) without a letter."""
    model = network.model
    totals, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    chosen = [i for i, t in enumerate(texts) if _has_letter(t)] if model.languages else []
    windows, owners = [], []

    def settle_windows() -> None:
        if windows:
            weights = np.array([len(w) for w in windows], float)
            np.add.at(totals, owners, network.probabilities(padded(windows)) * weights[:, None])
            np.add.at(sizes, owners, weights)
            windows.clear()
            owners.clear()

    for i in chosen:
        every = cut(texts[i].encode("utf-8", "replace"))
        for low in range(0, len(every), _BATCH):
            part = every[low : low + _BATCH]
            windows += part
            owners += [i] * len(part)
            if len(windows) >= _BATCH:
                settle_windows()
    settle_windows()
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    for i in chosen:
        best = int(totals[i].argmax())
        out[i] = (model.languages[best], float(min(1.0, totals[i, best] / sizes[i])))
    return out


def identify(text: Column, model: Model) -> Column:
    """struct<lang, score> of a whole text.

    lang is a learnt language (the first of several with equal scores), or `und` with
    score 0 for texts that are null, empty or without a letter, and for all if nothing was learnt.
    """

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        network = Network(model)
        for texts in batches:
            found = scores(plain(texts), network)
            yield pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["lang", "score"])

    return run(text)


def for_training(key: Column, folds: int = 4, held: int = 2) -> Column:
    """True for rows that may be learnt from: crc32 of the key as text is not `held` modulo `folds`."""
    return F.crc32(key.cast("string")) % folds != held
