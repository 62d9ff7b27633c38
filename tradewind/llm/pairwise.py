"""Quality scores learnt from preference pairs (Bradley-Terry), cut at a quantile of the scores.

Of a pair of labelled texts, one good and one bad, the model says that the good one is preferred
with probability ``sigmoid(w . (x_good - x_bad))``; ``w`` minimises the logistic loss over such
differences of features. Only texts are looked at, never ids, languages, sources or labels.

Every labelled row that isn't held out takes part. Rows are numbered by the hash of their ids and
dealt into blocks of both labels; Spark sums what the blocks contribute to the moments of the
features and to each of Newton's steps, and ranks the raw scores for the quantile. Only such sums
reach the driver. They are added up as decimals, so that their order doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.functions import dense_numbers, partition_rows
from tradewind.llm.batches import with_columns
from tradewind.llm.quality import STOP_WORDS, SYMBOLS
from tradewind.scratch import written

#: Rows of the more frequent label in a block; a block has about one more of the other at most.
BLOCK_ROWS = 4096
#: Pairs that each text of the more frequent label takes part in.
PAIRS = 8
#: Score at the cut; from here on a text is predicted to be good.
CUT = 0.7
#: Strength of the squared penalty on the weights, per pair.
PENALTY = 1e-3
#: Standardised features are held within this many deviations.
REACH = 5.0
#: Remainder of crc32(doc_id) by 4 whose labels are held out.
HELD_OUT = 2

#: Code points whose words are listed at a time.
CHUNK_CHARS = 1_000_000

_SYMBOLS = SYMBOLS.encode()
_STOPS = frozenset(STOP_WORDS)
_LONG_WORD = 15
#: What is counted in a text, per word (but for the last, per line).
SHARES = (
    "symbols", "calls", "digits", "repeats_1", "repeats_2", "repeats_3", "upper_words",
    "stop_words", "stops", "commas", "bars", "long_words", "copied_words", "copied_lines",
)
#: Every share twice, as it is and by its logarithm, and three measures of size.
FEATURES = (*SHARES, *(f"log_{s}" for s in SHARES), "log_words", "word_length", "log_lines")


def _chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The words of ``text``, listed in chunks of about ``size`` code points."""
    start = 0
    while start < len(text):
        end = start + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end].split()
        start = end


def features(text: str) -> list[float]:
    """The values of ``FEATURES``; those of an empty text are all zero."""
    data = text.encode()

    def count(characters: bytes) -> int:
        return len(data) - len(data.translate(None, characters))

    n_words = length = upper = stops = long_words = copied = 0
    repeats = [0, 0, 0]
    before: list[str] = []
    for words in _chunks(text):
        low = list(map(str.lower, words))
        lengths = list(map(len, words))
        n_words += len(words)
        length += sum(lengths)
        upper += sum(map(str.isupper, words))
        stops += sum(map(_STOPS.__contains__, low))
        long_words += sum(map(_LONG_WORD.__lt__, lengths))
        copied += len(low) - len(set(low))
        low = before + low
        for lag in (1, 2, 3):
            met = sum(map(eq, low, low[lag:])) - sum(map(eq, before, before[lag:]))
            repeats[lag - 1] += met
        before = low[-3:]
    lines = [x for x in text.split("\n") if x.strip()]
    per_word = 1 / max(1, n_words)
    counts = (
        count(_SYMBOLS), count(b"!?"), count(b"0123456789"), *repeats, upper, stops, count(b"."),
        count(b","), count(b"|"), long_words, copied,
    )
    shares = [n * per_word for n in counts]
    shares.append((len(lines) - len(set(lines))) / max(1, len(lines)))
    logs = [math.log1p(100 * s) for s in shares]
    size = [math.log1p(n_words), length * per_word, math.log1p(100 * len(lines) * per_word)]
    return shares + logs + size


@dataclass(frozen=True)
class Ranker:
    """A fitted model: ``weights`` of standardised features, and the raw score at the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at_cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 that rise with the raw ones; exactly ``CUT`` at the cut."""
        bent = np.tanh((self.raw(x) - self.at_cut) / 2)
        return np.where(bent >= 0, CUT + (1 - CUT) * bent, CUT * (1 + bent))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -REACH, REACH)


def preference_pairs(n_good: int, n_bad: int, each: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the good and the bad text of every pair.

    Each text of the larger side meets ``each`` of the smaller, in turn, so their number grows
    with the sample, not with its square.
    """
    large, small = max(n_good, n_bad), min(n_good, n_bad)
    many = np.repeat(np.arange(large), each)
    few = np.arange(large * each) % max(1, small)
    if not small:
        many = few = many[:0]
    return (many, few) if n_good >= n_bad else (few, many)


def _pull(differences: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``good - bad`` contributes to the slope of the loss, and to its second derivative."""
    preferred = 0.5 * (1 + np.tanh(differences @ weights / 2))
    bend = (differences * (preferred * (1 - preferred))[:, None]).T @ differences
    return differences.T @ (preferred - 1), bend


def _newton(
    pull: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
    n: int,
    width: int,
    penalty: float = PENALTY,
    rounds: int = 50,
) -> np.ndarray:
    """Weights of least logistic loss over ``n`` pairs, whose :func:`_pull` the callable sums."""
    weights = np.zeros(width)
    ridge = n * penalty * np.eye(width)
    for _ in range(rounds):
        slope, bend = pull(weights)
        step = np.linalg.solve(bend + ridge, slope + ridge @ weights)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def fit_pairs(differences: np.ndarray, penalty: float = PENALTY, rounds: int = 50) -> np.ndarray:
    """Weights of least logistic loss on ``good - bad``, by Newton's method."""
    n, width = differences.shape
    return _newton(lambda weights: _pull(differences, weights), n, width, penalty, rounds)


@dataclass(frozen=True)
class Block:
    """Features of good and bad texts that meet in pairs. A text of the rarer label may stand in
    several blocks; ``own`` tells the one that counts it, good texts before bad ones."""

    good: np.ndarray
    bad: np.ndarray
    own: np.ndarray

    def owned(self) -> np.ndarray:
        return np.vstack([self.good, self.bad])[self.own]

    def differences(self, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        over, under = preference_pairs(len(self.good), len(self.bad))
        return _standard(self.good, mean, scale)[over] - _standard(self.bad, mean, scale)[under]


#: Sums a vector that each block gives over all blocks.
Summed = Callable[[Callable[[Block], np.ndarray]], np.ndarray]


def _without_pairs(n_bad: int) -> Ranker:
    width = len(FEATURES)
    at_cut = np.inf if n_bad else 0.0
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), at_cut)


def _fitted(
    n_good: int, n_bad: int, summed: Summed, quantile: Callable[[Ranker, float], float]
) -> Ranker:
    n, width = n_good + n_bad, len(FEATURES)
    mean = summed(lambda block: block.owned().sum(axis=0)) / n
    spread = summed(lambda block: ((block.owned() - mean) ** 2).sum(axis=0))
    scale = np.maximum(np.sqrt(spread / n), 1e-6)

    def pull(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = summed(
            lambda block: np.concatenate(
                [part.ravel() for part in _pull(block.differences(mean, scale), weights)]
            )
        )
        return total[:width], total[width:].reshape(width, width)

    weights = _newton(pull, PAIRS * max(n_good, n_bad), width)
    uncut = Ranker(mean, scale, weights, 0.0)
    return Ranker(mean, scale, weights, quantile(uncut, n_bad / n))


def fit(good: np.ndarray, bad: np.ndarray) -> Ranker:
    """A model from the features of good and of bad texts, here all in one block.

    The cut is the quantile of all their raw scores at the share of the bad ones. Without texts
    of both kinds there are no pairs: every text then scores ``CUT``, or 0 if all are bad.
    """
    if not len(good) or not len(bad):
        return _without_pairs(len(bad))
    both = np.vstack([good, bad])
    block = Block(good, bad, np.ones(len(both), bool))
    return _fitted(
        len(good), len(bad), lambda of: of(block), lambda r, q: float(np.quantile(r.raw(both), q))
    )


def _remainder(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def _measured(texts: list[str], _: pa.RecordBatch) -> list:
    return [list(map(features, texts))]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int | None = None) -> DataFrame:
    """``good``, the features ``x`` and the hashed id ``h`` of labelled rows: of all of them, or of
    at most ``per_label`` of each label, those of the smallest hashes.

    Labels 0 and 1 of ids that aren't held out count; a row without an id has no label. Texts are
    measured where they lie, so that only features meet the labels.
    """
    kept = _remainder("doc_id") != HELD_OUT
    known = labels.where(kept & F.col("quality").isin(0, 1))
    known = known.select("doc_id", (F.col("quality") == 1).alias("good"))
    texts = docs.where(kept).select("doc_id", "text")
    measured = with_columns(texts, {"x": T.ArrayType(T.DoubleType())}, lambda: _measured)
    found = (
        measured.select("doc_id", "x")
        .join(known, "doc_id")
        .select("good", "x", F.xxhash64("doc_id").alias("h"))
    )
    if per_label is None:
        return found
    first = (found.where(F.col("good") == good).orderBy("h", "x").limit(per_label) for good in (True, False))
    return next(first).unionByName(next(first))


def _blocks(rows: DataFrame, n_good: int, n_bad: int, block_rows: int) -> DataFrame:
    """``rows``, the features of a block of both labels in each: those of the more frequent label
    in turn, and beside them the like part of the others, one at least."""
    large, small = max(n_good, n_bad), min(n_good, n_bad)
    n_blocks = -(-large // block_rows)
    at = F.col("number") - F.when(F.col("good"), n_bad).otherwise(0)  # bad ones come first
    numbered = rows.withColumn("at", at).withColumn("frequent", F.col("good") == (n_good >= n_bad))
    first = F.expr(f"if(frequent, at div {block_rows}, at * {n_blocks} div {small})")
    last = F.expr(f"if(frequent, at div {block_rows}, ((at + 1) * {n_blocks} + {small - 1}) div {small} - 1)")
    dealt = numbered.withColumn("first", first).withColumn("block", F.explode(F.sequence("first", last)))
    width = len(FEATURES)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("good", "descending"), ("at", "ascending")])
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        own = pc.equal(table["block"], table["first"]).to_numpy(zero_copy_only=False)
        good = table["good"].to_numpy()
        data = np.column_stack([x, good, own]).astype(float).tobytes()
        return pa.table({"rows": pa.array([data], pa.binary())})

    columns = dealt.select("block", "first", "at", "good", "x")
    return columns.groupBy("block").applyInArrow(packed, "rows binary")


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for data in batch.column(0):
            table = np.frombuffer(data.as_buffer()).reshape(-1, len(FEATURES) + 2)
            x, good = table[:, :-2], table[:, -2] == 1
            yield Block(x[good], x[~good], table[:, -1] == 1)


def _summed_by_spark(blocks: DataFrame, of: Callable[[Block], np.ndarray]) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches):
            vector = of(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(vector), dtype=np.int32)), pa.array(vector)], names=["i", "v"]
            )

    parts = blocks.mapInArrow(run, "i int, v double")
    sums = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,12)")).alias("v"))
    return np.array([float(r.v) for r in sums.orderBy("i").collect()])


def _quantile_by_spark(blocks: DataFrame, n: int, ranker: Ranker, share: float) -> float:
    """The quantile of the raw scores of all ``n`` rows, between two neighbours in proportion."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches):
            raw = ranker.raw(block.owned())
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(np.arange(len(raw)))], names=["raw", "tie"])

    # Equal scores, those of many copies, are told apart so that no task gets all of them.
    scores = written(blocks.mapInArrow(run, "raw double, tie long"))
    raw = written(partition_rows(scores, "raw", "tie"))
    place = share * (n - 1)
    low = min(math.floor(place), n - 1)
    near = dense_numbers(raw).where(F.col("number").isin(low, min(low + 1, n - 1)))
    values = sorted(r.raw for r in near.select("raw").collect())
    return values[0] + (values[-1] - values[0]) * (place - low)


def fit_ranker(
    docs: DataFrame, labels: DataFrame, per_label: int | None = None, block_rows: int = BLOCK_ROWS
) -> Ranker:
    """A model of all labelled rows, or of :func:`labelled_sample` with a bound."""
    rows = written(labelled_sample(docs, labels, per_label))
    counted = {r.good: r["count"] for r in rows.groupBy("good").count().collect()}
    n_good, n_bad = counted.get(True, 0), counted.get(False, 0)
    if not n_good or not n_bad:
        return _without_pairs(n_bad)
    # By a hash of the features where ids repeat: what Spark samples for the ranges stays short.
    placed = written(partition_rows(rows.withColumn("t", F.xxhash64("x")), "good", "h", "t"))
    numbered = dense_numbers(placed)
    blocks = written(_blocks(numbered, n_good, n_bad, block_rows))
    return _fitted(
        n_good,
        n_bad,
        lambda of: _summed_by_spark(blocks, of),
        lambda ranker, share: _quantile_by_spark(blocks, n_good + n_bad, ranker, share),
    )


def _scorer(ranker: Ranker) -> Callable:
    def score(texts: list[str], _: pa.RecordBatch) -> list:
        values = ranker.scores(np.array(list(map(features, texts))).reshape(-1, len(FEATURES)))
        return [pa.array(values), pa.array((values >= CUT).astype(np.int32))]

    return score


def pairwise_quality(
    docs: DataFrame, labels: DataFrame, per_label: int | None = None
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.7 on).

    Every row is scored by its whole text; equal texts score the same and a null text as an empty
    one. ``held_out`` tells whether the label of the row's id, if any, was kept from the model;
    it is false for a null id. Columns of these names are replaced, others pass unchanged. Without
    labels of both kinds see :func:`fit`. An empty table gives an empty result. The model learns
    from all labelled rows; ``per_label`` bounds those of each label.
    """
    ranker = fit_ranker(docs, labels, per_label)
    scored = with_columns(
        docs.drop("held_out"),
        {"score": T.DoubleType(), "predicted": T.IntegerType()},
        lambda: _scorer(ranker),
    )
    held = F.coalesce(_remainder("doc_id") == HELD_OUT, F.lit(False))
    return scored.withColumn("held_out", held)
