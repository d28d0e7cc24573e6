"""A cuckoo filter over 64-bit hashes, worked on in whole numpy arrays."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5BD1E995)


class Cuckoo:
    """Holds one 16-bit mark per inserted hash; insert each hash once, delete only what was inserted.

    It never misses an inserted hash. A hash that was not inserted is found with a
    chance of about 8 in 65,536.
    """

    def __init__(self, buckets: int):
        size = 1 << max(0, int(buckets - 1).bit_length())
        self.table = np.zeros((size, SLOTS), np.uint16)

    @classmethod
    def holding(cls, hashes: np.ndarray) -> Cuckoo:
        """A filter of the hashes with room for as many again."""
        buckets = max(4, len(hashes) * 2 // SLOTS)
        while not (made := cls(buckets)).insert(hashes):
            buckets *= 2
        return made

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        made = cls(1)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _other(self, marks: np.ndarray, places: np.ndarray) -> np.ndarray:
        return places ^ ((marks.astype(np.uint64) * _SPREAD) & np.uint64(len(self.table) - 1))

    def _spots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            mixed = hashes.astype(np.int64).view(np.uint64) * _MIX
        mixed ^= mixed >> np.uint64(29)
        marks = (mixed >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        places = mixed & np.uint64(len(self.table) - 1)
        return marks, places, self._other(marks, places)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        marks, one, two = self._spots(hashes)
        return (self.table[one] == marks[:, None]).any(1) | (self.table[two] == marks[:, None]).any(1)

    def _place(self, marks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Fills free slots; returns which marks found none."""
        order = np.argsort(places, kind="stable")
        ordered = places[order]
        starts = np.r_[True, ordered[1:] != ordered[:-1]]
        turn = np.arange(len(ordered)) - np.maximum.accumulate(np.where(starts, np.arange(len(ordered)), 0))
        full = self.table[ordered] != 0
        fits = turn < SLOTS - full.sum(1)
        slot = np.argsort(full, axis=1, kind="stable")[np.arange(len(ordered)), np.minimum(turn, SLOTS - 1)]
        self.table[ordered[fits], slot[fits]] = marks[order][fits]
        left = np.ones(len(marks), bool)
        left[order[fits]] = False
        return left

    def insert(self, hashes: np.ndarray, rounds: int = 500) -> bool:
        """False if the table is too full; it must then be built anew."""
        marks, places, others = self._spots(hashes)
        left = self._place(marks, places)
        marks, places = marks[left], others[left]
        for turn in range(rounds):
            if not len(marks):
                return True
            left = self._place(marks, places)
            marks, places = marks[left], places[left]
            # One mark per full bucket pushes out another, which tries its own other bucket.
            _, first = np.unique(places, return_index=True)
            slot = turn % SLOTS
            pushed = self.table[places[first], slot].copy()
            self.table[places[first], slot] = marks[first]
            marks[first], places[first] = pushed, self._other(pushed, places[first])
        return not len(marks)

    def delete(self, hashes: np.ndarray) -> None:
        marks, one, two = self._spots(hashes)
        while len(marks):
            # Equal marks in the same pair of buckets are taken out one by one.
            pair = np.stack([np.minimum(one, two), marks.astype(np.uint64)])
            first = np.unique(pair, axis=1, return_index=True)[1]
            for places in (one, two):
                match = self.table[places[first]] == marks[first][:, None]
                hit = match.any(1)
                self.table[places[first][hit], match.argmax(1)[hit]] = 0
                if places is one:
                    keep = np.ones(len(marks), bool)
                    keep[first] = False
                    first = first[~hit]
            marks, one, two = marks[keep], one[keep], two[keep]
