"""Minimal perfect hashing of 64-bit keys: a cascade of bit arrays, ranked by prefix counts.

Level by level the keys left over are hashed into a bit array; a place that just one
key hits keeps that key, the others go on. A key's index is the number of set bits in
front of its own, over all levels, so n keys get the indices 0 .. n - 1. A stranger
may hit a set bit too: the keys are stored in index order and every look-up is verified.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0  # places per key of a level
_ONE = np.uint64(1)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed."""
    z = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


class PerfectHash:
    """Minimal perfect hash of distinct unsigned 64-bit keys; ``keys`` are in index order."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        self.levels, self.keys = levels, keys
        counts = [np.bitwise_count(words) for words in levels]
        ends = np.cumsum([0] + [int(c.sum()) for c in counts])
        self.before = [end + np.cumsum(c) - c for end, c in zip(ends, counts)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys = np.unique(keys.astype(np.uint64))
        levels, left = [], keys
        while len(left):
            places = 64 * max(1, int(np.ceil(GAMMA * len(left) / 64)))
            at = (mixed(left, len(levels)) % np.uint64(places)).astype(np.int64)
            alone = np.bincount(at, minlength=places)[at] == 1
            words = np.zeros(places // 64, np.uint64)
            np.bitwise_or.at(words, at[alone] >> 6, _ONE << (at[alone] & 63).astype(np.uint64))
            levels.append(words)
            left = left[~alone]
        table = cls(levels, np.zeros(len(keys), np.uint64))
        table.keys[table._place(keys)] = keys
        return table

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where every level misses; strangers get any index."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for number, (words, before) in enumerate(zip(self.levels, self.before)):
            at = (mixed(keys[open_], number) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & _ONE).astype(bool)
            below = np.bitwise_count(word & ((_ONE << bit) - _ONE))
            out[open_[hit]] = (before[at >> 6] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Verified index of each key, -1 for strangers."""
        place = self._place(keys)
        if len(self.keys):
            place[self.keys[place] != keys] = -1
        return place

    def to_bytes(self) -> bytes:
        head = np.array([len(self.keys), len(self.levels), *map(len, self.levels)], "<u8")
        return b"".join(x.astype("<u8").tobytes() for x in (head, *self.levels, self.keys))

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        raw = np.frombuffer(blob, "<u8").astype(np.uint64)
        n, levels = int(raw[0]), int(raw[1])
        ends = np.cumsum([2 + levels, *raw[2:2 + levels].astype(np.int64)])
        return cls([raw[a:b] for a, b in zip(ends, ends[1:])], raw[ends[-1]:ends[-1] + n])
