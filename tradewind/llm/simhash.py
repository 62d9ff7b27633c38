"""SimHash near-duplicates: BK-trees over shards that pairs within the radius must share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.batches import unused, with_columns
from tradewind.scratch import written

#: Members of a shard's tree, at most; larger shards are cut.
TREE_MEMBERS = 4096
#: Members of a tree to aim at, on average.
SHARD = 1024
#: Times that a shard is cut by further bits.
LEVELS = 3
#: Shingles hashed at a time.
BLOCK = 1 << 16


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of a text's shingles of so many words, as a signed number.

    A-Z count as lower case. A bit is set if more than half of the shingles' XXH64 (seed 42) have
    it. A text of fewer words is one shingle; one without words has fingerprint zero.
    """
    found = text.encode().lower().split()  # ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        spans = zip(starts[k : k + BLOCK].tolist(), last[k : k + BLOCK].tolist(), strict=False)
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist())
    return value - (1 << 64) if value >> 63 else value


class BKForest:
    """BK-trees of many buckets at once; a child's key is its distance to the parent."""

    def __init__(self, values: np.ndarray, buckets: np.ndarray):
        """``values``: different numbers within each bucket; ``buckets``: 0..n-1, ascending."""
        self.values = values
        first = np.flatnonzero(np.diff(buckets, prepend=-1))
        self.root = np.full(int(buckets[-1]) + 1 if len(buckets) else 0, -1)
        self.root[buckets[first]] = first
        at = self.root[buckets]
        open_ = np.setdiff1d(np.arange(len(values)), first)
        edges, children = [], []
        while len(open_):  # all open members step down one level; the first on an edge stays
            distance = np.bitwise_count(values[open_] ^ values[at[open_]]).astype(np.int64)
            edge, where, back = np.unique(at[open_] * 65 + distance, return_index=True, return_inverse=True)
            edges.append(edge)
            children.append(open_[where])
            at[open_] = open_[where][back]
            open_ = np.delete(open_, where)
        keys = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.children = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def within(self, values: np.ndarray, buckets: np.ndarray, radius: int) -> tuple:
        """``(query, member)`` for all members of a query's bucket within the radius."""
        known = (buckets < len(self.root)) & (buckets >= 0)
        query = np.flatnonzero(known)
        query = query[self.root[buckets[query]] >= 0]
        node = self.root[buckets[query]]
        queries, members = [], []
        while len(query):
            distance = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            queries.append(query[near])
            members.append(node[near])
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            query, node = np.repeat(query, n), self.children[at]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *queries]), np.concatenate([none, *members])


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node that the links a-b reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(keys: np.ndarray, rows: dict[str, np.ndarray], radius: int) -> tuple:
    """Links that join what is near within each cell: its members to the first they reach.

    Rows are ordered by cell. Only as many links as members come out, not all pairs.
    """
    cells = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
    values = rows["fp"].view(np.uint64)
    tree, ask = np.flatnonzero(rows["tree"]), np.flatnonzero(rows["ask"])
    if not len(tree) or not len(ask):
        return values[:0], values[:0]
    forest = BKForest(values[tree], cells[tree])
    pairs: list[list[np.ndarray]] = [[], []]
    # Queries in blocks, so that the open paths through large trees stay few.
    sizes = np.bincount(cells[tree], minlength=int(cells[-1]) + 1)[cells[ask]]
    block = np.cumsum(np.maximum(sizes, 1)) // (1 << 20)
    for k in np.flatnonzero(np.diff(block, prepend=-1)):
        own = ask[k : np.searchsorted(block, block[k], "right")]
        q, m = forest.within(values[own], cells[own], radius)
        q, m = own[q], tree[m]
        pairs[0].append(q[q != m])
        pairs[1].append(m[q != m])
    label = _smallest(len(values), np.concatenate(pairs[0]), np.concatenate(pairs[1]))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[linked], values[label[linked]]


def _split(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in ``n`` runs of about one length."""
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _tables(radius: int, n: int) -> list[list[int]]:
    """Bits per table: two fingerprints within the radius agree on all bits of one table.

    Of ``radius + k`` runs of bits, at least k hold no differing bit. k grows with the number of
    fingerprints until trees are small enough on average.
    """
    k = 1
    while n >> (64 * k // (radius + k)) > SHARD and k < 4:
        k += 1
    runs = _split(list(range(64)), radius + k)
    return [sorted(b for run in some for b in run) for some in combinations(runs, k)]


def _finer(tables: list[list[int]], radius: int) -> list[list[int]]:
    """Tables that cut the shards of others: what agrees on a table's bits and lies within the
    radius also agrees on one of ``radius + 1`` runs of the bits that are left."""
    out = []
    for bits in tables:
        left = [b for b in range(64) if b not in set(bits)]
        out += [sorted([*bits, *run]) for run in _split(left, radius + 1)]
    return out


def _shards(prints: DataFrame, n: int, radius: int) -> DataFrame:
    """``cell``, ``fp``, and whether a row belongs to the cell's tree and to its queries.

    A shard is what agrees on a table's bits. Shards of more than ``TREE_MEMBERS`` fingerprints are
    cut by further bits, ``LEVELS`` times at most, each time into ``radius + 1`` tables of much
    smaller shards: rows grow in proportion to the members, not to their pairs. Only what is still
    too large then, of fingerprints alike in nearly all bits, is cut into parts that meet pairwise.
    """
    tables = _tables(radius, n)
    rows, width, found = prints.select("fp"), 0, None

    def keyed(rows: DataFrame, first: int, tables: list[list[int]]) -> DataFrame:
        """Each row under the tables that cut its shard: all at first, else its own."""
        each = F.array(*[F.lit(_mask(t)) for t in tables])
        of = F.sequence(F.lit(0), F.lit(len(tables) - 1))
        if first:
            of = F.sequence(F.col("t") * first, F.col("t") * first + (first - 1))
        dealt = rows.select("fp", F.explode(of).alias("t"))
        return dealt.select("fp", "t", F.col("fp").bitwiseAND(F.get(each, "t")).alias("key"))

    for level in range(LEVELS + 1):
        own = keyed(rows, width, tables)
        large = written(
            own.groupBy("t", "key").count().where(F.col("count") > TREE_MEMBERS)
        )
        cell = F.xxhash64(F.lit(level), "t", "key").alias("cell")
        if large.isEmpty():
            small = own.select(cell, "fp", F.lit(True).alias("tree"), F.lit(True).alias("ask"))
            return small if found is None else found.unionByName(small)
        small = own.join(large, ["t", "key"], "left_anti")
        small = small.select(cell, "fp", F.lit(True).alias("tree"), F.lit(True).alias("ask"))
        found = small if found is None else found.unionByName(small)
        rows = written(own.join(large, ["t", "key"]))
        if level < LEVELS:
            tables, width = _finer(tables, radius), radius + 1
    parts = F.ceil(F.col("count") / TREE_MEMBERS).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part")
    met = rows.select("t", "key", "fp", part, F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    pair = F.least("part", "other"), F.greatest("part", "other")
    return found.unionByName(
        met.select(
            F.xxhash64(F.lit(LEVELS + 1), "t", "key", *pair).alias("cell"),
            "fp",
            (F.col("part") <= F.col("other")).alias("tree"),
            (F.col("part") >= F.col("other")).alias("ask"),
        )
    )


def near_links(prints: DataFrame, n: int, radius: int) -> DataFrame:
    """``(a, b)``: links between different fingerprints (column ``fp``) that connect all those at
    most ``radius`` bits apart, found in the BK-trees of the shards that these must share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_cells(batches):
            a, b = _links(rows["cell"], rows, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

    cells = _shards(prints, n, radius).repartition("cell").sortWithinPartitions("cell", "fp")
    return cells.mapInArrow(run, "a long, b long").distinct()


def _whole_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of the sorted rows, cut between cells."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = {
            c: batch.column(i).to_numpy(zero_copy_only=False)
            for i, c in enumerate(batch.schema.names)
        }
        held = {c: np.concatenate([held[c], rows[c]]) for c in rows} if held else rows
        cells = held["cell"]
        cut = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
        if cut:
            yield {c: v[:cut] for c, v in held.items()}
            held = {c: v[cut:] for c, v in held.items()}
    if held and len(held["cell"]):
        yield held


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: the smallest node it reaches.

    Alternates two steps until nothing changes: each node's larger neighbours go to its smallest
    neighbour, then its smaller ones do. Only minima are gathered per node; the links of a hub
    are joined row by row. Each round is a table on shared storage.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        met = pairs.join(least, "a")
        if larger:
            moved = met.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        else:
            moved = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b"))
            )
        return moved.distinct()

    state = F.struct(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)")))
    pairs = written(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = pairs.agg(state).first()[0]
    for _ in range(max_rounds):
        pairs = written(star(star(pairs, larger=True), larger=False))
        now = pairs.agg(state).first()[0]
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def simhash_components(
    docs: DataFrame, words: int = 4, radius: int = 4, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits), ``component_id`` and ``is_first``, which
    replace columns of those names.

    Fingerprints at most ``radius`` bits apart link; the component is the smallest ``doc_id`` that
    links reach, the document's own included, and ``is_first`` holds for one row of it, one with
    that ``doc_id``. Rows with equal fingerprints, repeated ones among them, share a component.
    Null and empty texts have fingerprint zero, which links like any other. A null ``doc_id`` is
    a component's smallest only where it has no other. An empty table gives an empty one.

    The documents are written once with their fingerprints (without ``text`` if not
    ``keep_text``). Exact copies meet by fingerprint; only different ones enter the trees.
    """

    def compute():
        return lambda texts, _: [[fingerprint(t, words) for t in texts]]

    made = ("fingerprint", "component_id", "is_first")
    fp, row, least_ = (unused(docs, c) for c in ("_fp", "_row", "_least"))
    ids = docs.drop(*made).withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = with_columns(ids, {fp: T.LongType()}, compute)
    marked = marked if keep_text else marked.drop("text")
    rows = written(marked.withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", row)
    own = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")))
    roots = components(near_links(own.select("fp"), own.count(), radius))
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias(least_))
    found = rooted.join(least, "root").select(F.col("fp").alias(fp), least_)
    return (
        rows.join(found, fp)
        .withColumn("fingerprint", F.lower(F.lpad(F.hex(fp), 16, "0")))
        .withColumn("component_id", F.col(least_)["doc_id"])
        .withColumn("is_first", F.col(row) == F.col(least_)[row])
        .drop(fp, row, least_)
    )
