"""A BM25 inverted index with block maxima, searched by block-max WAND inside tasks."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from math import log

import numpy as np

#: Saturation and length weight of BM25.
K1, B = 1.2, 0.75
#: Entries per block; each block of a term's list knows its largest score.
BLOCK = 4
#: Block maxima, and sums of them, that are laid out at a time for bounds over many passages.
ENTRIES = 1 << 19


@dataclass
class Spread:
    """How words are spread over all entries, also those of other indexes."""

    entries: int = 0
    words: int = 0
    holding: Counter[bytes] = field(default_factory=Counter)  # entries that have the word

    def add(self, entry: list[bytes]) -> None:
        self.entries += 1
        self.words += len(entry)
        self.holding.update(set(entry))

    def of(self, entries: list[list[bytes]]) -> Spread:
        """The same, of the words of these entries alone."""
        own = {w for e in entries for w in e}
        return Spread(self.entries, self.words, Counter({w: self.holding[w] for w in own}))


class Index:
    """Scores are shares of what an entry's own words would score, so 1 means all of them."""

    def __init__(self, entries: list[list[bytes]], over: Spread | None = None):
        """``entries``: the words of each entry, in order; an entry without words is never found.

        ``over``: all entries, where these are a part of them, so that scores don't hang on parts.
        """
        self.n = len(entries)
        if over is None:
            over = Spread()
            for e in entries:
                over.add(e)
        spread = dict.fromkeys(w for e in entries for w in e)
        rarity = {w: log(1 + (over.entries - (d := over.holding[w]) + 0.5) / (d + 0.5)) for w in spread}
        mean = over.words / max(1, over.entries) or 1
        self.terms: dict[bytes, int] = {w: i for i, w in enumerate(spread)}
        lists: list[list[tuple[int, float]]] = [[] for _ in spread]
        for i, words in enumerate(entries):
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {w: rarity[w] * n * (K1 + 1) / (n + norm) for w, n in Counter(words).items()}
            own = sum(impact.values())
            for w, x in impact.items():
                lists[self.terms[w]].append((i, x / own))
        self.docs = [[d for d, _ in x] for x in lists]
        self.scores = [[s for _, s in x] for x in lists]
        self.top = [max(x) for x in self.scores]
        self.maxima = []
        for docs, scores in zip(self.docs, self.scores, strict=True):
            most: dict[int, float] = {}
            for d, s in zip(docs, scores, strict=True):
                most[d // BLOCK] = max(most.get(d // BLOCK, 0.0), s)
            self.maxima.append(most)
        # The same block maxima as flat arrays, for bounds over many passages at once.
        self.starts = np.cumsum([0, *map(len, self.maxima)])
        self.blocks = np.array([b for m in self.maxima for b in m], np.int64)
        self.block_tops = np.array([s for m in self.maxima for s in m.values()])

    def promising(self, passage: np.ndarray, term: np.ndarray, n: int, least: float) -> np.ndarray:
        """Which of ``n`` passages have a block whose maxima, summed over the passage's terms, reach
        ``least``. ``passage`` and ``term``: a row for each different term of each passage."""
        width = -(-self.n // BLOCK) or 1
        good = np.zeros(n, bool)
        count = self.starts[term + 1] - self.starts[term]
        first = np.searchsorted(passage, np.arange(n + 1))  # passages are numbered in order of their rows
        reach = np.concatenate([[0], np.cumsum(count)])[first]
        k = 0
        while k < n:
            end = int(np.searchsorted(reach, reach[k] + ENTRIES, "right")) - 1
            end = min(max(end, k + 1), k + max(1, ENTRIES // width), n)
            a, b = first[k], first[end]
            own = count[a:b]
            at = np.arange(own.sum()) + np.repeat(self.starts[term[a:b]] - np.cumsum(own) + own, own)
            cell = np.repeat((passage[a:b] - k) * width, own) + self.blocks[at]
            sums = np.bincount(cell, self.block_tops[at], minlength=(end - k) * width)
            good[k:end] = sums.reshape(end - k, width).max(1) >= least - 1e-9
            k = end
        return good

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """``(entry, score)`` for every entry that scores ``least`` or more (block-max WAND).

        Lists stand in order of their next entry. The pivot is the first list at which the sum of
        the lists' maxima reaches ``least``; no entry before it can. The maxima of the pivot's
        blocks are summed next, and if they fall short all lists skip past the block.
        """
        cursors = [[self.docs[t][0], 0, t] for t in terms]  # next entry, its place, the term
        found = []
        least -= 1e-9  # sums in another order may differ in the last digits
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (_, _, t) in enumerate(cursors):
                bound += self.top[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            entry = cursors[pivot][0]
            block = entry // BLOCK
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            ahead = sum(self.maxima[t].get(block, 0.0) for _, _, t in cursors[: pivot + 1])
            if ahead < least:
                after = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(after, entry + 1))
            elif cursors[0][0] == entry:
                score = sum(self.scores[t][i] for d, i, t in cursors[: pivot + 1])
                if score >= least:
                    found.append((entry, score))
                self._advance(cursors, pivot + 1, entry + 1)
            else:
                self._advance(cursors, pivot, entry)
        return found

    def _advance(self, cursors: list, n: int, entry: int) -> None:
        """Moves the first n lists to their first entry from ``entry`` on; ended lists go."""
        for c in cursors[:n]:
            if c[0] < entry:
                c[1] = bisect_left(self.docs[c[2]], entry, c[1])
                c[0] = self.docs[c[2]][c[1]] if c[1] < len(self.docs[c[2]]) else self.n
        cursors[:] = [c for c in cursors if c[0] < self.n]
