"""Drops lines that many documents share, probing a sharded minimal perfect hash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.batches import slices, unused, with_columns
from tradewind.llm.perfect_hash import PerfectHash
from tradewind.scratch import written

#: Keys of a shard of the index, about 25 bytes each.
SHARD_KEYS = 500_000
#: An index of at most so many bytes goes to every task; documents send a larger one their keys.
BROADCAST_BYTES = 64 << 20
#: Keys of documents that meet a shard's arrays in one task.
GROUP_KEYS = 1_000_000

_SPACES = b" \t\n\x0b\x0c\r"


def line_keys(text: str, min_chars: int) -> list[bytes | None]:
    """The 128-bit key of every line, in order; None for lines too short to be dropped."""
    keys: list[bytes | None] = []
    for line in text.encode().lower().split(b"\n"):  # bytes.lower() changes A-Z alone
        line = line.strip(_SPACES)
        long = len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars)
        keys.append(xxhash.xxh3_128_digest(line) if long else None)
    return keys


class LineIndex:
    """The shards' arrays: per slot a fingerprint, the documents' count and the keeping document."""

    def __init__(self, shards: dict[int, tuple], n_shards: int):
        self.n_shards = n_shards
        self.shards = {
            k: (
                PerfectHash.from_bytes(hash_),
                np.frombuffer(marks, np.uint64),
                np.frombuffer(counts, np.uint32),
                np.frombuffer(keepers, np.int64),
            )
            for k, (hash_, marks, counts, keepers) in shards.items()
        }

    def keepers(self, keys: list[bytes]) -> list[int | None]:
        """For each key that the index holds, the document that keeps it; None for the rest."""
        halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        high, low = halves[:, 0], halves[:, 1]
        out: list[int | None] = [None] * len(keys)
        shard_of = high.view(np.int64) % self.n_shards
        for shard in np.unique(shard_of):
            if int(shard) not in self.shards:
                continue
            own = np.flatnonzero(shard_of == shard)
            hash_, marks, _, keepers = self.shards[int(shard)]
            slots = hash_.slots(high[own], low[own])
            known = slots >= 0
            known[known] = marks[slots[known]] == low[own][known]
            for i, slot in zip(own[known], slots[known], strict=True):
                out[i] = int(keepers[slot])
        return out


def _pairs(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(high, low, doc_id)``: each document's different keys, as two halves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids = part.column(part.schema.names.index("doc_id")).to_pylist()
                keys, owners = [], []
                for doc, text in zip(ids, texts, strict=True):
                    own = {k for k in line_keys(text, min_chars) if k}
                    keys += own
                    owners += [doc] * len(own)
                halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                        pa.array(owners, pa.int64()),
                    ],
                    names=["high", "low", "doc_id"],
                )

    return docs.mapInArrow(run, "high long, low long, doc_id long")


def build_index(pairs: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """The shards of an index over the keys found in ``min_docs`` documents, and their number.

    A key below that number is never dropped, so it needs no slot; its 64-bit fingerprint, the
    half of the key that does not choose the shard, tells it from those that have one.
    """
    frequent = written(
        pairs.groupBy("high", "low")
        .agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
    )
    n_shards = frequent.count() // SHARD_KEYS + 1

    def build(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_numpy() for c in table.schema.names}
        high, low = rows["high"].view(np.uint64), rows["low"].view(np.uint64)
        hash_ = PerfectHash.build(high, low)
        order = np.empty(len(high), np.int64)
        order[hash_.slots(high, low)] = np.arange(len(high))
        return pa.table(
            {
                "shard": pa.array([int(rows["shard"][0])], pa.int32()),
                "hash": [hash_.to_bytes()],
                "marks": [low[order].tobytes()],
                "counts": [np.minimum(rows["n"][order], 2**32 - 1).astype(np.uint32).tobytes()],
                "keepers": [rows["keeper"][order].tobytes()],
            }
        )

    shards = (
        frequent.withColumn("shard", F.pmod("high", F.lit(n_shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(build, "shard int, hash binary, marks binary, counts binary, keepers binary")
    )
    return written(shards), n_shards


def _kept(texts: list[str], min_chars: int, dropped) -> list[list]:
    """Kept text, lines and dropped lines of each text; ``dropped(i, keys)`` tells what goes."""
    out: list[list] = [[], [], []]
    for i, text in enumerate(texts):
        keys = line_keys(text, min_chars)
        go = dropped(i, keys)
        lines = text.split("\n")
        out[0].append("\n".join(x for x, gone in zip(lines, go, strict=True) if not gone))
        out[1].append(len(lines))
        out[2].append(sum(go))
    return out


_COLUMNS = {"text": T.StringType(), "n_lines": T.LongType(), "n_dropped": T.LongType()}


def _probe_in_tasks(docs: DataFrame, shards: DataFrame, n_shards: int, min_chars: int) -> DataFrame:
    arrays = docs.sparkSession.sparkContext.broadcast({r[0]: tuple(r)[1:] for r in shards.collect()})

    def compute():
        index = LineIndex(arrays.value, n_shards)

        def work(texts: list[str], part: pa.RecordBatch) -> list[list]:
            ids = part.column(part.schema.names.index("doc_id")).to_pylist()
            keys = [line_keys(t, min_chars) for t in texts]
            flat = list({k for own in keys for k in own if k})
            keeper = dict(zip(flat, index.keepers(flat), strict=True)) if flat else {}
            keeper = {k: v for k, v in keeper.items() if v is not None}
            return _kept(
                texts,
                min_chars,
                lambda i, own: [k in keeper and keeper[k] != ids[i] for k in own],
            )

        return work

    return with_columns(docs, _COLUMNS, compute)


def _probe_by_shard(
    docs: DataFrame, pairs: DataFrame, shards: DataFrame, n_shards: int, min_chars: int
) -> DataFrame:
    """For an index too large for a task: its shards meet the documents' keys.

    A shard's keys are dealt to as many groups as their number asks for, each with a copy of the
    shard, so that a line that a third of all documents hold makes no large group.
    """
    pairs = pairs.withColumn(
        "shard", F.pmod("high", F.lit(n_shards)).cast("int")
    )
    groups = pairs.groupBy("shard").agg(
        (F.floor(F.count("*") / GROUP_KEYS) + 1).cast("int").alias("groups")
    )
    asked = pairs.join(groups, "shard").withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "low"), F.col("groups")).cast("int")
    )
    copies = shards.join(groups, "shard").withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    )

    def probe(asks: pa.Table, shard: pa.Table) -> pa.Table:
        gone, ids = [], []
        if shard.num_rows:
            row = shard.to_pylist()[0]
            arrays = (row["hash"], row["marks"], row["counts"], row["keepers"])
            index = LineIndex({row["shard"]: arrays}, n_shards)
            halves = np.stack([asks.column("high").to_numpy(), asks.column("low").to_numpy()], 1)
            keys = [k.tobytes() for k in halves]
            owners = asks.column("doc_id").to_pylist()
            for key, doc, keeper in zip(keys, owners, index.keepers(keys), strict=True):
                if keeper is not None and keeper != doc:
                    gone.append(key)
                    ids.append(doc)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "gone": pa.array(gone, pa.binary())})

    doc, own_gone = unused(docs, "_doc"), unused(docs, "_gone")
    gone = (
        asked.select("shard", "group", "high", "low", "doc_id")
        .groupBy("shard", "group")
        .cogroup(copies.drop("groups").groupBy("shard", "group"))
        .applyInArrow(probe, "doc_id long, gone binary")
        .groupBy(F.col("doc_id").alias(doc))
        .agg(F.collect_set("gone").alias(own_gone))
    )
    marked = docs.join(gone, docs["doc_id"].eqNullSafe(gone[doc]), "left").drop(doc)

    def compute():
        def work(texts: list[str], part: pa.RecordBatch) -> list[list]:
            sets = [set(x or ()) for x in part.column(part.schema.names.index(own_gone)).to_pylist()]
            return _kept(texts, min_chars, lambda i, own: [k in sets[i] for k in own])

        return work

    return with_columns(marked, _COLUMNS, compute).drop(own_gone)


def line_dedup(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` without lines that ``min_docs`` documents share, except in the largest ``doc_id``.

    ``text`` holds the lines that stay; ``n_lines`` and ``n_dropped`` are added, or replace columns
    of those names. A line counts by its key: stripped of ASCII white space at both ends, A-Z in
    lower case, ``min_chars`` code points at least. Documents are told apart by ``doc_id``: rows
    that repeat one count once, and all of them keep its lines. A null ``doc_id`` is no document
    for the count and keeps no line; a null or empty text is one empty line and stays empty; an
    empty table gives an empty one.

    Two passes over the documents: keys are counted by a shuffle of 24 bytes a line, and
    documents then probe the index, whose bytes decide whether it goes to every task.
    """
    typed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    pairs = _pairs(typed.select("doc_id", "text"), min_chars)
    shards, n_shards = build_index(pairs, min_docs)
    sizes = [F.length(c) for c in ("hash", "marks", "counts", "keepers")]
    total = shards.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    if total <= broadcast_bytes:
        return _probe_in_tasks(typed, shards, n_shards, min_chars)
    return _probe_by_shard(typed, written(pairs), shards, n_shards, min_chars)
