"""Quality by weak supervision.

Rules look at counts of a text. Each votes for one side, good or bad, or abstains.
Expectation-maximisation over the votes of all documents estimates how often each rule
votes for good and for bad documents, hence its accuracy, and from these follows each
document's probability of being good. No single rule decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain, structs

SYMBOLS, BLANK_BYTES, CAPITALS, SMALL = b"#*$%&|<>", b" \t\n\x0b\x0c\r", bytes(range(65, 91)), bytes(range(97, 123))
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_small", "n_bangs", "n_same")


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a window of eight words which the text holds twice or more."""
    import numpy as np

    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0x100000001B3) + each[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    # Equal hashes are only a first sieve; the words themselves decide.
    maybe = np.sort(order[np.r_[same, False] | np.r_[False, same]]).tolist()
    first: dict[tuple[bytes, ...], int] = {}
    starts = set()
    for i in maybe:
        j = first.setdefault(tuple(words[i : i + WINDOW]), i)
        if j != i:
            starts |= {i, j}
    edges = np.zeros(len(words) + 1, np.int64)
    places = np.fromiter(starts, np.int64, len(starts))
    edges[places] += 1
    np.subtract.at(edges, places + WINDOW, 1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _counts(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    held = [line for line in raw.split(b"\n") if line.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    same = sum(map(bytes.__eq__, words[1:], words))
    return len(words), len(text) - without(BLANK_BYTES), without(SYMBOLS), len(held) - len(set(held)), _repeated(words), len(held), without(CAPITALS), without(SMALL), raw.count(b"!"), same


def counts(text: Column) -> Column:
    """A struct of COUNTS; a null text has none of anything."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def run(texts: pa.Array) -> pa.Array:
        rows = [_counts(t) for t in plain(texts)]
        columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
        return structs(**{c: (v, pa.int64()) for c, v in zip(COUNTS, columns, strict=True)})

    return run(text)


# (rule, vote, condition over COUNTS): the rule votes good (1) or bad (0) where the condition holds.
RULES = (
    ("short", 0, "n_words < 20"),
    ("symbols", 0, "n_symbols * 10 > n_words"),
    ("capitals", 0, "n_capitals * 10 > 3 * (n_capitals + n_small)"),
    ("exclamations", 0, "n_bangs * 10 > n_words"),
    ("repeated_lines", 0, "n_dup_lines * 10 > 3 * n_lines"),
    ("repeated_words", 0, "n_repeat_words * 10 > 3 * n_words"),
    ("same_words", 0, "n_same * 5 > n_words"),
    ("word_length", 0, "word_chars * 2 < 5 * n_words or word_chars > 15 * n_words"),
    ("long_enough", 1, "n_words >= 50"),
    ("few_marks", 1, "n_symbols * 50 <= n_words and n_bangs * 50 <= n_words and n_capitals * 10 <= n_capitals + n_small and n_words > 0"),
    ("flowing", 1, "n_same * 20 <= n_words and word_chars between 3 * n_words and 12 * n_words and n_words > 0"),
    ("unrepeated", 1, "n_dup_lines = 0 and n_repeat_words * 10 <= n_words and n_words > 0"),
)


def votes(rules: tuple[tuple[str, int, str], ...] = RULES) -> Column:
    """Bit k is set where rule k votes; over columns named COUNTS."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, _, condition) in enumerate(rules)]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total.cast("int")


@dataclass(frozen=True)
class Model:
    offset: float
    weights: tuple[tuple[float, float], ...]  # log odds of good where rule k abstains, votes
    accuracy: tuple[float, ...]  # chance that rule k is right where it votes

    def probability(self, bits: Column) -> Column:
        total = F.lit(self.offset)
        for k, (silent, voting) in enumerate(self.weights):
            total = total + F.when(bits.bitwiseAND(1 << k) != 0, F.lit(voting)).otherwise(F.lit(silent))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))))


def fit(voted: DataFrame, bits: str = "votes", rules: tuple[tuple[str, int, str], ...] = RULES, rounds: int = 500, tolerance: float = 1e-9) -> Model:
    """Expectation-maximisation over the patterns of votes of all rows.

    What reaches the driver is one count per pattern, at most two to the number of
    rules. A rule is never believed to vote against its own side: where the estimate
    says so, it is taken as blind. Without rows every probability is one half.
    """
    import numpy as np

    found = voted.groupBy(F.col(bits).alias("b")).agg(F.count("*").alias("n")).collect()
    sides = np.array([side for _, side, _ in rules], bool)
    patterns = np.array([[r["b"] >> k & 1 for k in range(len(rules))] for r in sorted(found)], float).reshape(-1, len(rules))
    weight = np.array([r["n"] for r in sorted(found)], float)
    if not len(found):
        return Model(0.0, ((0.0, 0.0),) * len(rules), (0.5,) * len(rules))
    for_good, for_bad = patterns[:, sides].sum(1), patterns[:, ~sides].sum(1)
    # Any vote for bad makes a document suspect at the start, in proportion.
    good = (for_good + 1) / (for_good + len(rules) * for_bad + 2)
    before = None
    for _ in range(rounds):
        n_good, n_bad = weight @ good, weight @ (1 - good)
        prior = (n_good + 1) / (n_good + n_bad + 2)
        if_good, if_bad = ((weight * good) @ patterns + 1) / (n_good + 2), ((weight * (1 - good)) @ patterns + 1) / (n_bad + 2)
        both = (weight @ patterns + 1) / (weight.sum() + 2)
        blind = (if_good > if_bad) != sides
        if_good, if_bad = np.where(blind, both, if_good), np.where(blind, both, if_bad)
        silent, voting = np.log((1 - if_good) / (1 - if_bad)), np.log(if_good / if_bad)
        offset = math.log(prior / (1 - prior))
        good = 1 / (1 + np.exp(-np.clip(offset + patterns @ voting + (1 - patterns) @ silent, -50, 50)))
        if before is not None and np.abs(good - before).max() < tolerance:
            break
        before = good
    p_good, p_bad = prior * if_good, (1 - prior) * if_bad
    accuracy = np.where(sides, p_good, p_bad) / (p_good + p_bad)
    return Model(offset, tuple((float(a), float(b)) for a, b in zip(silent, voting, strict=True)), tuple(map(float, accuracy)))


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
