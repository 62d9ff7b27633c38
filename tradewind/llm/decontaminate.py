"""Finds test items inside training documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.batches import slices, with_columns
from tradewind.llm.bm25 import Index, Spread

#: Items are indexed in pieces of at most so many words; a passage is two steps of as many words,
#: and passages begin at every step, so that each piece lies whole in some passage.
STEP = 64
#: Items of fewer words are found only where all of their words stand one after the other.
WHOLE_WORDS = 8
#: Items of fewer words are reported, but their words alone make no document a leak: phrases so
#: short stand in ordinary texts as well.
LEAK_WORDS = 5
#: Bytes of item text whose index goes to every task at a time; more items make more passes.
ITEM_BYTES = 8 << 20

#: Code points of text that a task searches at a time.
SLICE_CHARS = 500_000

#: ASCII characters that are neither letters nor digits become spaces, as do those listed below.
_TO_SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_PUNCTUATION = re.compile("[\xa0-\xbf\u2000-\u206f\u3000-\u303f]+")
_ANSWER = re.compile(r"\n\s*(?:answer|a)\s*[:.]\s*|\?\s+(?=\S)(?!.*\?)", re.I | re.S)


def words_of(text: str) -> list[bytes]:
    """The text's words in lower case and UTF-8, without punctuation."""
    text = text.lower()
    if not text.isascii():
        text = _PUNCTUATION.sub(" ", text)
    return text.encode().translate(_TO_SPACES).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and answer.

    The answer follows a line mark ("Answer:") or the last question mark; an item with neither is
    a statement, of which the last third counts as the answer.
    """
    found = None
    for found in _ANSWER.finditer(text):
        pass
    if found:
        question, answer = words_of(text[: found.start()]), words_of(text[found.end() :])
        if question and answer:
            return question, answer
    words = words_of(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def _pairs(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter(words)


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """The share of a part's pairs of neighbouring words (of a single word: the word) that the
    passage has too."""
    own = _pairs(part)
    held = _pairs(passage) if len(part) > 1 else Counter(passage)
    return sum((own & held).values()) / max(1, sum(own.values())) if part else 1.0


def stands_in(run: list[bytes], words: list[bytes]) -> bool:
    """Whether the words of ``run`` stand in ``words``, one after the other."""
    n, at = len(run), -1
    for _ in range(words.count(run[0])):
        at = words.index(run[0], at + 1)
        if words[at : at + n] == run:
            return True
    return False


@dataclass
class Item:
    item_id: int
    question: list[bytes]
    answer: list[bytes]

    @property
    def n_words(self) -> int:
        return len(self.question) + len(self.answer)

    def pieces(self) -> list[list[bytes]]:
        words = self.question + self.answer
        n = -(-len(words) // STEP)
        return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)]


class Detector:
    """The index over the items' pieces, and the check of what it finds."""

    def __init__(self, items: list[Item], over: Spread | None, least_score: float, least_overlap: float):
        self.items, self.least_score, self.least_overlap = items, least_score, least_overlap
        pieces, self.owner = [], []
        for i, item in enumerate(items):
            own = item.pieces()
            pieces += own
            self.owner += [i] * len(own)
        self.index = Index(pieces, over)

    def found(self, texts: list[str]) -> list[tuple[int, Item, float, float, float]]:
        """``(text, item, score, question overlap, answer overlap)``, the best passage of each."""
        words = [words_of(t) for t in texts]
        get, none = self.index.terms.get, repeat(-1)
        terms = np.concatenate([np.fromiter(map(get, w, none), np.int64, len(w)) for w in words])
        sizes = np.array([len(w) for w in words])
        text_of = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        steps = -(-sizes // STEP)
        first = np.cumsum(steps) - steps  # number of each text's first passage
        known = terms >= 0
        at = (first[text_of] + place // STEP)[known]
        # A word stands in the passage that begins with its step and in the one before.
        early = (place // STEP > 0)[known]
        v = max(1, len(self.index.terms))
        rows = at * v + terms[known]
        rows = np.sort(np.concatenate([rows, rows[early] - v]))
        rows = rows[np.diff(rows, prepend=-1) != 0]
        passage, term = rows // v, rows % v
        good = self.index.promising(passage, term, int(steps.sum()), self.least_score)
        best: dict[tuple[int, int], tuple] = {}
        text_at = np.repeat(np.arange(len(texts)), steps)
        for p in np.flatnonzero(good).tolist():
            a, b = np.searchsorted(passage, [p, p + 1])
            text = int(text_at[p])
            start = (p - int(first[text])) * STEP
            for piece, score in self.index.search(term[a:b].tolist(), self.least_score):
                item = self.items[self.owner[piece]]
                reach = max(2 * STEP, item.n_words)
                near = words[text][max(0, start - reach) : start + 2 * STEP + reach]
                if item.n_words < WHOLE_WORDS and not stands_in(item.question + item.answer, near):
                    continue
                q, a_ = overlap(item.question, near), overlap(item.answer, near)
                if min(q, a_) >= self.least_overlap:
                    row = (text, item, score, q, a_)
                    key = (text, self.owner[piece])
                    best[key] = max(best.get(key, row), row, key=lambda r: r[2:])
        return list(best.values())


SCHEMA = (
    "doc_id long, item_id long, item_words long, score double, question_overlap double, "
    "answer_overlap double"
)


def _sent(items: DataFrame, item_bytes: int) -> list[Broadcast]:
    """The different items, in as many parts as their text needs, each sent to every task.

    A part comes with the spread of its words over the items of all parts.
    """
    spark = items.sparkSession
    wanted = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = wanted.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    parts = int(total // item_bytes) + 1

    def made(rows: DataFrame) -> Iterator[Item]:
        return (Item(r[0], *question_and_answer(r[1])) for r in rows.toLocalIterator() if words_of(r[1]))

    over = None
    if parts > 1:
        over = Spread()
        for item in made(wanted):
            for piece in item.pieces():
                over.add(piece)

    def part(k: int) -> Broadcast:
        own = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text")
        found = list(made(own))
        spread = over and over.of([p for item in found for p in item.pieces()])
        return spark.sparkContext.broadcast((found, spread))

    return [part(k) for k in range(parts)]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    least_score: float = 0.6,
    least_overlap: float = 0.5,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``doc_id, item_id, item_words, score, question_overlap, answer_overlap`` for each test item
    found; ``item_words`` is the number of the item's words.

    Every passage of every document is a query to a BM25 index of the items (block-max WAND). An
    item whose share of its own score is ``least_score`` or more is then held against the
    document: of both its question and its answer, ``least_overlap`` of the neighbouring word
    pairs must stand there; of an item of fewer than ``WHOLE_WORDS`` words, all words in a row.
    Case and punctuation don't count.

    A null or empty text holds no item, and an item with a null or empty text is found nowhere.
    Repeated documents each give their rows; rows of equal items are one item. Other columns are
    not read. Without documents or items there are no rows. A null ``doc_id`` stays null.

    The items' index goes to every task. Their text is measured first: beyond ``item_bytes`` they
    are cut into as many parts by hash, and each part is searched in a pass of its own. Rarity and
    mean length are those of all items, so scores are the same however many parts there are.
    """
    read = docs.select(F.col("doc_id").cast("long"), "text")

    def part(sent: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            detector = None
            for batch in batches:
                detector = detector or Detector(*sent.value, least_score, least_overlap)
                for rows, texts in slices(batch, "text", SLICE_CHARS):
                    ids = rows.column(0).to_pylist()
                    found = detector.found(texts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[f[0]] for f in found], pa.int64()),
                            pa.array([f[1].item_id for f in found], pa.int64()),
                            pa.array([f[1].n_words for f in found], pa.int64()),
                            *[pa.array([f[i] for f in found], pa.float64()) for i in (2, 3, 4)],
                        ],
                        names=[
                            "doc_id", "item_id", "item_words", "score", "question_overlap",
                            "answer_overlap",
                        ],
                    )

        return read.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, [part(sent) for sent in _sent(items, item_bytes)])


def flagged(
    docs: DataFrame,
    items: DataFrame,
    column: str = "leak",
    least_score: float = 0.6,
    least_overlap: float = 0.5,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``docs`` with ``column``: whether this very row's text holds a test item of at least
    ``LEAK_WORDS`` words, as found by :func:`contaminated`.

    Each row is judged alone, repeated rows alike, rows of null or equal ids by their own texts. A
    null or empty text holds no item; without items all are false. No key is read and nothing is
    shuffled; a column of that name is replaced, all others pass unchanged.
    """

    def passed(sent: Broadcast, first: bool) -> Callable:
        def compute():
            detector = Detector(*sent.value, least_score, least_overlap)

            def work(texts: list[str], part: pa.RecordBatch) -> list[list]:
                leaks = [False] * len(texts)
                if not first:
                    leaks = part.column(part.schema.names.index(column)).to_pylist()
                for text, item, *_ in detector.found(texts):
                    leaks[text] = leaks[text] or item.n_words >= LEAK_WORDS
                return [leaks]

            return work

        return compute

    docs = docs.drop(column)
    for k, sent in enumerate(_sent(items, item_bytes)):
        work = passed(sent, k == 0)
        docs = with_columns(docs, {column: T.BooleanType()}, work, chars=SLICE_CHARS)
    return docs
