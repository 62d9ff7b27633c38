"""Minimal perfect hashing of 128-bit keys: levels of bit arrays, a key's slot is its bit's rank."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it.
LOAD = 2
#: Levels after which the keys left (about e^-0.5 to the power 40 of them) are listed in order.
LEVELS = 40


def _mixed(high: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """A hash of both key halves that differs with the level (multiply-and-shift rounds)."""
    with np.errstate(over="ignore"):
        x = high ^ (low * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct keys to its own slot 0..n-1; other keys to any slot or to -1."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels = levels
        self.left = left
        self.ranks = []
        total = 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            total += int(ones.sum())
        self.placed = total

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high) and len(levels) < LEVELS:
            words = (len(high) * LOAD + 63) // 64
            at = _mixed(high, low, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64)[at.astype(np.int64)] == 1
            bits = np.zeros(words, np.uint64)
            own = at[alone]
            np.bitwise_or.at(
                bits, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63))
            )
            levels.append(bits)
            high, low = high[~alone], low[~alone]
        left = np.zeros(len(high), [("high", np.uint64), ("low", np.uint64)])
        left["high"], left["low"] = high, low
        return cls(levels, np.sort(left))

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found = np.full(len(high), -1, np.int64)
        open_ = np.arange(len(high))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = _mixed(high[open_], low[open_], level) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = ranks[word] + np.bitwise_count(below)
            found[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        if len(self.left) and len(open_):
            keys = np.zeros(len(open_), self.left.dtype)
            keys["high"], keys["low"] = high[open_], low[open_]
            i = np.minimum(np.searchsorted(self.left, keys), len(self.left) - 1)
            same = self.left[i] == keys
            found[open_[same]] = self.placed + i[same]
        return found

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels), len(self.left)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, *self.levels, self.left))

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n + 2)
        at = 8 * (n + 2)
        levels = []
        for size in sizes[1:-1]:
            levels.append(np.frombuffer(data, np.uint64, int(size), at))
            at += 8 * int(size)
        left = np.frombuffer(data, [("high", np.uint64), ("low", np.uint64)], int(sizes[-1]), at)
        return cls(levels, left)
