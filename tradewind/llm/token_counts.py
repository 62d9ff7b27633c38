"""Token counts of a byte-level BPE file by finite-state transducers."""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.batches import with_columns

#: Code points of a chunk; the chunks of a stream go through the splitter side by side.
CHUNK = 2048
#: Words and transitions that a task remembers; when so many are held, it starts anew.
REMEMBERED = 400_000
#: Bytes of a word between looks at how much is remembered.
STRETCH = 1 << 16

# The splitter's input classes. Letters that take part in "'s 't 'm 'd 're 've 'll" have their own.
SPACE, WHITE, NUMBER, QUOTE, OTHER, LETTER, ONE, R, V, E, L, END = range(12)
# Its states: what the token being read is. After a white space run it matters whether the run is
# one character or more and whether its last is a space, which the next token takes along.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, SP, WH, RUN_SP, RUN_WH, QU, QU_R, QU_V, QU_L = range(12)
# A transition marks where tokens begin: at this character, at the one before, or at both.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """The transducer that splits text before merging: next state and marks, by state and class."""
    step, mark = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = (LETTER, ONE, R, V, E, L)
    begin = dict.fromkeys(letters, IN_LETTERS) | {
        NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: QU, SPACE: SP, WHITE: WH, END: START,
    }
    for state in range(12):
        for kind in range(12):  # unless said otherwise, a new token begins
            step[state, kind], mark[state, kind] = begin[kind], HERE
    for kind in letters:
        step[IN_LETTERS, kind], mark[IN_LETTERS, kind] = IN_LETTERS, 0
        for state in (QU_R, QU_V, QU_L):  # no contraction: letters began after the quote
            step[state, kind], mark[state, kind] = IN_LETTERS, BEFORE
    for state in (QU_R, QU_V, QU_L):
        for kind in set(range(12)) - set(letters):
            mark[state, kind] = BEFORE | HERE
    step[IN_NUMBERS, NUMBER], mark[IN_NUMBERS, NUMBER] = IN_NUMBERS, 0
    for state in (IN_OTHER, QU):
        for kind in (OTHER, QUOTE):
            step[state, kind], mark[state, kind] = IN_OTHER, 0
    for kind, state in ((ONE, START), (R, QU_R), (V, QU_V), (L, QU_L)):
        step[QU, kind], mark[QU, kind] = state, 0
    for state, kind in ((QU_R, E), (QU_V, E), (QU_L, L)):
        step[state, kind], mark[state, kind] = START, 0
    for state, run in ((SP, False), (RUN_SP, True)):  # the next token takes the space along
        for kind in (*letters, NUMBER, OTHER, QUOTE):
            step[state, kind] = IN_OTHER if kind == QUOTE else begin[kind]
            mark[state, kind] = BEFORE if run else 0
    for kind in (*letters, NUMBER, OTHER, QUOTE):
        mark[RUN_WH, kind] = BEFORE | HERE
    for state in (SP, WH, RUN_SP, RUN_WH):
        for kind, to in ((SPACE, RUN_SP), (WHITE, RUN_WH)):
            step[state, kind], mark[state, kind] = to, 0
    return step, mark


def character_classes(tokenizer) -> list[tuple[int, int]]:
    """``(first code point, class)`` of each run of equal classes, as the library itself splits.

    Unicode has grown since some versions of the library were built, so every letter and number of
    the newest tables is held against the library; what it doesn't know yet is no word character.
    """
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    whole = "".join(map(chr, points))
    probe = tokenizer.pre_tokenizer.pre_tokenize_str

    def joined(before: str, candidates: str) -> set[int]:
        tried = "".join(f"{before}{c}\n" for c in candidates)
        return {ord(candidates[a // 3]) for _, (a, b) in probe(tried) if a % 3 == 0 and b - a == 2}

    letters = joined("a", "".join(regex.findall(r"\p{L}", whole)))
    numbers = joined("1", "".join(regex.findall(r"\p{N}", whole)))
    white = set(map(ord, regex.findall(r"\s", whole)))
    named = {ONE: "stmd", R: "r", V: "v", E: "e", L: "l", QUOTE: "'", SPACE: " "}
    own = {ord(c): kind for kind, cs in named.items() for c in cs}
    runs: list[tuple[int, int]] = []
    for c in points:
        kind = LETTER if c in letters else NUMBER if c in numbers else WHITE if c in white else OTHER
        kind = own.get(c, kind)
        if not runs or runs[-1][1] != kind:
            runs.append((c, kind))
    return runs


class Merger:
    """A transducer over the bytes of a word, compiled as words need it.

    A state is the set of token starts that may still grow: for each, the trie node of the bytes
    since, the token before it, and its count of tokens relative to the count up to here. Every
    prefix of a word has one encoding; its last token is the one whose neighbours no merge joins.
    A transition carries the change in the number of tokens.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            new = ids[a + b]
            self.rank[ids[a], ids[b]] = (k, new)
            self.halves.setdefault(new, (ids[a], ids[b]))
            self.order.setdefault(new, k)
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        reachable = [*self.halves, *(ids[c] for c in byte_of)]
        text_of = {i: t for t, i in ids.items()}
        for token in reachable:
            node = 0
            for c in text_of[token]:
                key = node << 8 | byte_of[c]
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.token_at[node] = token
        self._reset()

    def _reset(self) -> None:
        self._number: dict[tuple, int] = {((0, -1, 0),): 0}
        self._states: list[tuple] = [((0, -1, 0),)]
        self._moves: dict[int, tuple[int, int]] = {}
        self._meet: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens where they meet: their merges are undone, the latest
        first, and a merge across happens if it ranks before the one undone last."""
        undone = (1 << 60, 0)
        while True:
            across = self.rank.get((left, right))
            if across is not None and (across[0], 1) < undone:
                return False
            a, b = self.order.get(left, -1), self.order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                undone, left = (a, 1), self.halves[left][1]
            else:
                undone, right = (b, 2), self.halves[right][0]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        grown, change = [], None
        last = -1
        for node, before, count in self._states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            grown.append((to, before, count))
            token = self.token_at.get(to)
            if token is None:
                continue
            apart = before < 0 or self._meet.get((before, token))
            if apart is None:
                apart = self._meet[before, token] = self._apart(before, token)
            if apart:
                change, last = count + 1, token
        assert change is not None, "every prefix has an encoding"
        items = tuple(sorted([*((n, p, c - change) for n, p, c in grown), (0, last, 0)]))
        number = self._number.setdefault(items, len(self._states))
        if number == len(self._states):
            self._states.append(items)
        self._moves[state << 8 | byte] = (number, change)
        return number, change

    def count(self, word: bytes) -> int:
        """The number of tokens of a word."""
        known = self.known.get(word)
        if known is not None:
            return known
        state = total = 0
        for start in range(0, len(word), STRETCH):
            if len(self.known) + len(self._moves) >= 2 * REMEMBERED:
                reached = self._states[state]
                self._reset()
                state = self._number.setdefault(reached, len(self._states))
                if state:
                    self._states.append(reached)
            moves = self._moves.get
            for byte in word[start : start + STRETCH]:
                state, change = moves(state << 8 | byte) or self._compile(state, byte)
                total += change
        if len(word) <= 64:
            self.known[word] = total
        return total


class Counter:
    """Counts the tokens of texts: the splitter over chunks side by side, the merger over words."""

    def __init__(self, path: str, runs: list[tuple[int, int]], specials: list[str]):
        step, mark = splitter()
        self.step, self.mark = step.ravel(), mark.ravel()
        starts = np.array([r[0] for r in runs])
        kinds = np.array([r[1] for r in runs], np.uint8)
        self.kind_of = kinds[np.searchsorted(starts, np.arange(0x110000), "right") - 1]
        self.merger = load_merger(path)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def _map(self, chunks: np.ndarray) -> np.ndarray:
        """For each chunk, the exit state for each of the entry states."""
        maps = np.tile(np.arange(12, dtype=np.uint8), (len(chunks), 1))
        for column in chunks.T:
            maps = self.step[maps * 12 + column[:, None]]
        return maps

    def _entry_states(self, chunks: np.ndarray) -> np.ndarray:
        """The state in which each chunk begins: the chunks' maps compose in a prefix scan that
        doubles its reach in every round. Where a chunk's end leads to one state from all states,
        that end is its map; other chunks are run whole."""
        maps = self._map(chunks[:, -64:])
        unsure = np.flatnonzero((maps != maps[:, :1]).any(1))
        maps[unsure] = self._map(chunks[unsure])
        reach = 1
        while reach < len(maps):
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.int64), 1)
            reach *= 2
        return np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)

    def _word_starts(self, kinds: np.ndarray) -> np.ndarray:
        n = len(kinds)
        chunks = np.full((-(-n // CHUNK), CHUNK), END, np.uint8)
        chunks.ravel()[:n] = kinds
        states = self._entry_states(chunks)
        marks = np.empty((CHUNK, len(chunks)), np.uint8)
        for k, column in enumerate(np.ascontiguousarray(chunks.T)):
            at = states * 12 + column
            marks[k], states = self.mark[at], self.step[at]
        flat = np.ascontiguousarray(marks.T).ravel()[:n]
        begins = flat & HERE > 0
        begins[:-1] |= flat[1:] & BEFORE > 0
        return np.flatnonzero(begins)

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        parts, owner = [], []
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.special.split(text) if self.special else [text]
            extra[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        whole = "\n".join(parts) + "\n"  # each part ends at a mark, whose class is END
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = self.kind_of[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = END
        starts = self._word_starts(kinds)
        data = whole.encode()
        offsets = starts
        if len(data) > len(points):
            width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            offsets = (np.cumsum(width, dtype=np.int64) - width)[starts]
        places = [*offsets.tolist(), len(data)]
        words = [data[a:b] for a, b in zip(places, places[1:], strict=False)]
        known = self.merger.known
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(found < 0).tolist():
            found[i] = self.merger.count(words[i])
        found[kinds[starts] == END] = 0
        sums = np.concatenate([[0], np.cumsum(found)])
        cut = np.searchsorted(starts, np.concatenate([[0], ends + 1]))
        np.add.at(extra, np.array(owner), np.diff(sums[cut]))
        return extra


@cache
def load_merger(path: str) -> Merger:
    return Merger(path)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = 512, text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``
    tokens), which replace columns of those names.

    Counts are those of the ``tokenizers`` library for a byte-level BPE file, without added
    special tokens; special strings inside a text are one token each. A null or empty text has no
    tokens. Repeated rows each get their counts; an empty table gives an empty one. ``path`` is a
    file that every machine has; the library is asked once, on the driver, for the classes of the
    characters. Rows are worked on alone, so nothing is shuffled.
    """
    from tokenizers import Tokenizer

    path = path or default_path()
    with open(path, encoding="utf-8") as file:
        specials = [t["content"] for t in json.load(file)["added_tokens"]]
    runs = character_classes(Tokenizer.from_file(path))

    def compute():
        counter = Counter(path, runs, specials)

        def work(texts: list[str], _: pa.RecordBatch) -> list:
            counts = counter.counts(texts)
            return [[len(t.encode()) for t in texts], counts.tolist(), (counts > limit).tolist()]

        return work

    columns = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    return with_columns(docs, columns, compute, text)
