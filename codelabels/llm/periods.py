"""Periodic runs of words, found by a longest-common-extension index on a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least max(`MIN_WORDS`, `MIN_TIMES` * q) long, which neither neighbouring
word extends with that period.

Enumeration goes over harmonic grids: for each q, at every (`MIN_TIMES` - 1) * q-th word
i, the words at i and i + q are extended together to the right and to the left. A run holds such a
pair of words at least (`MIN_TIMES` - 1) * q times in a row, so one of its grid points is always hit;
n words have about n ln n / 3 grid points.

How far two places agree is answered in constant time. Only suffixes at the places of a
difference cover modulo v are sorted, by their first v words and then by doubling. From
any two places both reach the cover after the same number of fewer than v words. Those
are compared directly; the rest is the minimum of the common prefixes of neighbours in
sorted order, looked up in a sparse table. The left extension asks the same of the reversed text.

Texts of a batch are indexed together, each closed by a word of its own, and are sorted
apart, so copies of a text cost no more than other texts.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import plain

MIN_WORDS, MIN_TIMES = 6, 4
# Perfect difference sets; every difference modulo the key occurs between two members.
COVERS = {13: (0, 1, 3, 9), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
LARGE = 1 << 20  # from so many words on the sparser cover
GROUP_WORDS, _PAIRS = 1 << 18, 1 << 20  # words indexed together, grid points looked at together
RUN = "struct<start:long,length:long,period:long>"


class Extensions:
    """Common extensions of places in a row of word numbers.

    `texts` numbers the text each word belongs to. The last word of a text occurs
    nowhere else. Places are only compared within a text.
    """

    def __init__(self, words: np.ndarray, texts: np.ndarray, cover: int | None = None):
        self.v = v = cover or (57 if len(words) >= LARGE else 13)
        self.members, self.n = COVERS[v], len(words)
        self.words = np.r_[words + 1, np.zeros(v, words.dtype)]
        self.texts, self.table = texts, None
        # Steps from each pair of remainders until both are in the cover.
        inside = np.zeros(2 * v, bool)
        inside[[*self.members, *(m + v for m in self.members)]] = True
        at = np.arange(v)
        both = inside[at[:, None, None] + at] & inside[at[None, :, None] + at]
        self.steps = both.argmax(2)

    def _sort(self) -> None:
        v, n, words = self.v, self.n, self.words
        places = [np.arange(m, n, v) for m in self.members]
        sizes = np.array([len(p) for p in places])
        base = np.cumsum(sizes) - sizes
        self.base = np.zeros(v, np.int64)
        self.base[list(self.members)] = base
        place = np.concatenate(places)
        ends, m = np.repeat(base + sizes, sizes), len(place)
        bits = int(words.max()).bit_length()
        keys, each = [], 63 // bits
        for low in range(0, v, each):
            key = np.zeros(m, np.int64)
            for t in range(low, min(low + each, v)):
                key = (key << bits) | words[place + t]
            keys.append(key)
        keys = [self.texts[place], *keys]
        order = np.lexsort(keys[::-1])
        new = np.ones(m, bool)
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        at = np.arange(m)
        rank = np.empty(m, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, at, 0))
        levels, step = [rank], 1
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        while len(tied):
            who = order[tied]
            on = who + step
            after = np.where(on < ends[who], rank[np.minimum(on, m - 1)] + 1, 0)
            key = rank[who] * (m + 1) + after
            o = np.argsort(key, kind="stable")
            who, key = who[o], key[o]
            order[tied] = who
            new = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[who] = tied[np.maximum.accumulate(np.where(new, at[: len(new)], 0))]
            levels.append(rank)
            step *= 2
            tied = tied[~(new & np.r_[new[1:], True])]
        self.rank = rank
        # Common words of neighbours in order: whole blocks by halving steps, then single words.
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, m - 1), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = (levels[level][a] == levels[level][b]) << level
            a, b, common = a + same, b + same, common + same
        common, alive = common * v, np.ones(len(common), bool)
        a, b = place[a], place[b]
        for t in range(v):
            alive &= words[a + t] == words[b + t]
            common += alive
        self.table, width = [common.astype(np.int32 if n < 1 << 31 else np.int64)], 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, for all pairs at once; i and j differ."""
        steps, out, left = self.steps[i % self.v, j % self.v], np.zeros(len(i), np.int64), np.arange(len(i))
        reached = []
        for t in range(self.v):
            there = steps[left] == t
            reached.append(left[there])
            left = left[~there]
            left = left[self.words[i[left] + t] == self.words[j[left] + t]]
            out[left] = t + 1
        reached = np.concatenate(reached)
        if len(reached):
            if self.table is None:
                self._sort()
            a, b = (self.rank[self.base[p % self.v] + p // self.v] for p in (i[reached] + steps[reached], j[reached] + steps[reached]))
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp(high - low)[1] - 1
            least = np.empty(len(reached), np.int64)
            for k in np.unique(level):
                some, row = level == k, self.table[k]
                least[some] = np.minimum(row[low[some]], row[high[some] - (1 << int(k))])
            out[reached] += least
        return out


def _grid(sizes: np.ndarray):
    """Chunks (text, q, place within the text) of all harmonic grids."""
    apart = MIN_TIMES - 1
    longest = sizes // MIN_TIMES
    text = np.repeat(np.arange(len(sizes)), longest)
    q = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    counts = (sizes[text] - 1 - q) // (apart * q) + 1
    upto = np.cumsum(counts)
    for low in range(0, int(upto[-1]) if len(upto) else 0, _PAIRS):
        flat = np.arange(low, min(low + _PAIRS, int(upto[-1])))
        row = np.searchsorted(upto, flat, side="right")
        yield text[row], q[row], (flat - upto[row] + counts[row]) * apart * q[row]


def find(texts: list[np.ndarray], cover: int | None = None) -> list[np.ndarray]:
    """Per text, given as word numbers, its runs as rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros((0, 3), np.int64)
    if not len(sizes) or sizes.max() < MIN_WORDS:
        return [none] * len(texts)
    top = max(int(t.max()) for t in texts if len(t)) + 1
    # Every text is closed by a number of its own; so is the front, for the way back.
    joined = np.concatenate([np.array([top]), *(np.r_[t, top + 1 + k] for k, t in enumerate(texts))]).astype(np.int64)
    number = np.r_[0, np.repeat(np.arange(len(texts)), sizes + 1)]
    offset = np.cumsum(sizes + 1) - sizes
    right, n = Extensions(joined, number, cover), len(joined)
    # Seen backwards a text is closed by what stands before it.
    left = Extensions(joined[::-1].copy(), np.r_[np.repeat(np.arange(len(texts)), sizes + 1), len(texts)][::-1].copy(), cover)
    found = []
    for text, q, i in _grid(sizes):
        i = i + offset[text]
        same = joined[i] == joined[i + q]
        text, q, i = text[same], q[same], i[same]
        ahead = right(i, i + q)
        back = left(n - i, n - i - q)
        hit = ahead + back + q >= np.maximum(MIN_WORDS, MIN_TIMES * q)
        found.append(np.stack([text[hit], i[hit] - back[hit] - offset[text[hit]], (ahead + back + q)[hit], q[hit]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    # The same stretch also has the multiples of its period; it is a run of the smallest.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)][: len(rows)]]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _best(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length per period, exactly; ties to the first by start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stand in the first period of every run that holds them."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def _numbers(group: list[list[bytes]]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    return [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in group]


def _groups(texts: list[str]):
    group, held = [], 0
    for t in texts:
        group.append(t.encode("utf-8", "replace").split())
        held += len(group[-1])
        if held >= GROUP_WORDS:
            yield group
            group, held = [], 0
    yield group


def runs(text: Column) -> Column:
    """struct<runs, best, collapsed> of a text's words `[^\\x20\\x09-\\x0D]+`.

    runs: all runs as (start, length, period) in words, by start, then period; best: the one
    with the greatest length / period, ties to the first, null without runs; collapsed: the
    words less those that a run repeats, joined by one space. Null and empty texts have no
    words. Very long texts are looked at whole, by themselves. Equal rows get equal results.
    """

    @F.arrow_udf(f"struct<runs:array<{RUN}>,best:{RUN},collapsed:string>")
    def run(texts: pa.Array) -> pa.Array:
        found, kept = [], []
        for group in _groups(plain(texts)):
            some = find(_numbers(group))
            found += some
            kept += [_kept(words, r) for words, r in zip(group, some, strict=True)]

        def table(rows: np.ndarray, mask=None) -> pa.Array:
            return pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"], mask=mask)

        best = [_best(r) for r in found]
        every = np.concatenate([np.zeros((0, 3), np.int64), *found])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32()), table(every))
        firsts = table(np.array([b or (0, 0, 0) for b in best], np.int64).reshape(-1, 3), pa.array([b is None for b in best], pa.bool_()))
        return pa.StructArray.from_arrays([lists, firsts, pa.array(kept, pa.binary()).cast(pa.string())], ["runs", "best", "collapsed"])

    return run(text)
