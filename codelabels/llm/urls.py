"""URL filters: rules by host and path, and a learnt verdict for all other URLs.

The learnt part is a logistic regression on hashed character n-grams of host and path.
Everything here is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import ascii_lower

SIZE = 1 << 12
GRAMS = (3, 4)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """A host, which stands for its subdomains too, followed by the start of a path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    def fits(self, host_of: Column, path_of: Column) -> Column:
        _, slash, rest = self.text.partition("/")
        return ((host_of == self.host) | F.endswith(host_of, F.lit(f".{self.host}"))) & F.startswith(path_of, F.lit(slash + rest))


def ruled(host_of: Column, path_of: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct (rule, verdict), null if none fits.

    Rules are a short list written by hand; they become one expression. Of equally
    long ones the first in order of text holds.
    """
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        hit = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host_of, path_of), hit) if found is None else found.when(rule.fits(host_of, path_of), hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def features(host_of: Column, path_of: Column, size: int = SIZE, grams: Sequence[int] = GRAMS) -> Column:
    """Hashed n-grams of host and path, marked by part and with their ends marked; empty parts have none."""

    def of(part: Column, tag: str, n: int) -> Column:
        chars = F.when(F.length(part) > 0, F.split(F.concat(F.lit("^"), part, F.lit("$")), "")).otherwise(F.array().cast("array<string>"))

        def hashed(cs: Column) -> Column:
            last = F.size(cs) - n
            starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.concat(F.lit(tag), *(F.get(cs, i + k) for k in range(n)))), F.lit(size)).cast("int"))

        # An array of one element binds the characters, so a URL is split only once.
        return F.get(F.transform(F.array(chars), hashed), 0)

    return F.concat(*(of(part, tag, n) for part, tag in ((host_of, "h"), (path_of, "p")) for n in grams))


@dataclass(frozen=True)
class Model:
    offset: float
    weights: tuple[float, ...]

    def score(self, found: Column) -> Column:
        """Chance of the positive label; the offset alone decides where there are no n-grams."""
        return 1 / (1 + F.exp(-_margin(found, self.offset, self.weights)))


def _margin(found: Column, offset: float, weights: Sequence[float]) -> Column:
    # One literal for the whole table of weights.
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return F.greatest(F.lit(-40.0), F.least(F.lit(40.0), offset + total / F.sqrt(F.greatest(F.size(found), F.lit(1)))))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", size: int = SIZE, grams: Sequence[int] = GRAMS, sample: int = 2_000, rounds: int = 25, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Fits on at most `sample` labelled URLs per label, those with the smallest hash.

    Rows without URL or label are left out; a URL that is repeated with a label counts once. Each round is one aggregate over the
    sample; its gradient has one number per hashed n-gram, at most `size`.
    """
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).dropna().distinct()
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("url"), "url").limit(sample) for y in (0, 1)]
    rows = picked[0].unionByName(picked[1]).select("y", features(host(F.col("url")), path(F.col("url")), size, grams).alias("f"))
    rows = settle(rows.repartition(2), "url-sample")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total, positive = sum(sizes.values()), sizes.get(1, 0)
    offset, weights = math.log((positive + 1) / (total - positive + 1)), [0.0] * size
    seen, seen_offset = [1e-8] * size, 1e-8
    for _ in range(rounds if 0 < positive < total else 0):
        error = 1 / (1 + F.exp(-_margin(F.col("f"), offset, weights))) - F.col("y")
        step = rows.select(error.alias("e"), "f").select(F.explode(F.concat("f", F.array(F.lit(size)))).alias("i"), F.when(F.col("i") == size, F.col("e")).otherwise(F.col("e") / F.sqrt(F.size("f"))).alias("g"))
        # Rounded, so that the order in which partitions arrive leaves no trace.
        gradient = {r["i"]: r["g"] / total for r in step.groupBy("i").agg(F.round(F.sum("g"), 7).alias("g")).collect()}
        g = gradient.pop(size, 0.0)
        seen_offset += g * g
        offset -= rate * g / math.sqrt(seen_offset)
        for i, g in gradient.items():
            g += ridge * weights[i]
            seen[i] += g * g
            weights[i] = round(weights[i] - rate * g / math.sqrt(seen[i]), 6)
    return Model(offset, tuple(weights))


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, key: str = "page_id", url: str = "url", positive: str = "block", negative: str = "allow", grams: Sequence[int] = GRAMS) -> DataFrame:
    """Per row: key, host, path, rule, verdict, score. The rule's verdict holds; the model judges where none fits.

    A null, empty or malformed URL has an empty host and path, no rule, and the score
    of the model's offset alone. URLs of any length are judged whole; equal rows alike.
    """
    parts = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    scored = parts.select("*", ruled(F.col("host"), F.col("path"), rules).alias("hit"), model.score(features(F.col("host"), F.col("path"), len(model.weights), grams)).alias("score"))
    learnt = F.when(F.col("score") >= 0.5, positive).otherwise(negative)
    return scored.select(key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", learnt).alias("verdict"), "score")
