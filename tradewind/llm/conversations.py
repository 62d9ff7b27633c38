"""A trie of conversation prefixes, its subtree totals rolled up in bands of depth.

A node is a distinct sequence of first turns; its key is the depth and a 128-bit sum of the turns'
digests, each mixed with its place. Totals go up in bands of ``BAND`` levels: every node adds its
value to its ancestors down from the top of its band and no further. The tops of the bands form a
trie of a ``BAND``-th of the depth, whose totals are found in the same way; what lies below a
band's bottom nodes is then added to their ancestors in the band. A node so meets ``BAND``
ancestors at most, and the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.scan import running
from tradewind.scratch import written

#: Levels of a band.
BAND = 16
#: Conversations in a hundred follow one another's first turns: c those of c - c % SHARED.
SHARED = 100
#: First turns that a conversation may take from another: crc32(c) % HEADS.
HEADS = 6
#: Ids that are joined to one text at a time when the ends of a node are digested.
IDS = 4096

KEY = ["depth", "k1", "k2"]
PARENT = ["depth - 1 AS depth", "p1 AS k1", "p2 AS k2"]


def _heads(conv_id: str) -> Column:
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    """Each turn's digest and length, numbered within its conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"),
        "turn",
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    return running(turns, ["c"], ["turn", "digest"])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (``c``, ``n`` turns once rebuilt) and their turns (``c``, ``depth`` from
    1, ``digest``, ``chars``).

    Turns of an equal ``turn`` follow in the order of their digests.
    """
    turns = written(_turns(conversations))
    convs = turns.groupBy("c").agg(F.count("*").alias("own")).withColumn("h", _heads("c"))
    bases = (
        turns.where((F.col("c") % SHARED == 0) & (F.col("idx") < HEADS - 1))
        .groupBy(F.col("c").alias("base"))  # at most five rows each
        .agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "chars"))).alias("firsts"))
    )
    of_base = convs.withColumn("base", F.expr(f"c - c % {SHARED}")).join(bases, "base", "left")
    heads = F.coalesce(F.expr("slice(firsts, 1, cast(h AS int))"), F.array().cast("array<struct<idx:bigint,digest:string,chars:bigint>>"))
    convs = written(
        of_base.withColumn("heads", heads)
        .withColumn("k", F.size("heads").cast("long"))
        .withColumn("n", F.expr("k + greatest(own - h, 0)"))
        .select("c", "h", "k", "n", "heads")
    )
    first = convs.select("c", F.inline("heads")).selectExpr("c", "idx + 1 AS depth", "digest", "chars")
    rest = (
        turns.join(convs.select("c", "h", "k"), "c")
        .where("idx >= h")
        .selectExpr("c", "idx - h + k + 1 AS depth", "digest", "chars")
    )
    return convs.select("c", "n"), first.unionByName(rest)


def _mixed(lane: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """``lane`` (64 bits of a digest) spread anew for each depth: sums of these tell sequences
    apart, where sums of digests alone would only tell sets."""
    x = lane + depth * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lanes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c, depth, digest, chars = batch.columns
        raw = b"".join(bytes.fromhex(d)[:16] for d in digest.to_pylist())
        lanes = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        at = depth.to_numpy().view(np.uint64)
        own = [pa.array(_mixed(lanes[:, i], at).view(np.int64)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [c, depth, chars, *own, *own], names=["c", "depth", "chars", "v1", "v2", "k1", "k2"]
        )


def _parents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of a row's parent is its own without its last turn."""
    for batch in batches:
        c, depth, chars, *lanes = batch.columns[:7]
        v1, v2, k1, k2 = (x.to_numpy().view(np.uint64) for x in lanes)
        parent = [pa.array((k - v).view(np.int64)) for k, v in ((k1, v1), (k2, v2))]
        yield pa.RecordBatch.from_arrays(
            [c, depth, chars, lanes[2], lanes[3], *parent],
            names=["c", "depth", "chars", "k1", "k2", "p1", "p2"],
        )


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each conversation ``c`` and depth from 1: the key of its node (``k1``, ``k2``),
    of the node above (``p1``, ``p2``) and the length of the last turn."""
    spread = turns.select("c", "depth", "digest", "chars").mapInArrow(
        _lanes, "c long, depth long, chars long, v1 long, v2 long, k1 long, k2 long"
    )
    summed = running(written(spread), ["c"], ["depth"], ["k1", "k2"])
    return written(
        summed.mapInArrow(
            _parents, "c long, depth long, chars long, k1 long, k2 long, p1 long, p2 long"
        )
    )


def _in_bands(rows: DataFrame) -> DataFrame:
    """``rows`` with ``path``: the keys above the row in its band, from the band's top down."""
    band = F.expr(f"(depth - 1) div {BAND}").alias("band")
    grouped = rows.groupBy("c", band).agg(  # at most BAND rows each
        F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rows")
    )
    keys = "transform(rows, r -> named_struct('depth', r.depth - 1, 'k1', r.p1, 'k2', r.p2))"
    return (
        grouped.withColumn("above", F.expr(keys))
        .select("above", F.posexplode("rows").alias("at", "r"))
        .selectExpr("r.*", "slice(above, 1, at + 1) AS path")
    )


def _summed(contributions: DataFrame, values: list[str]) -> DataFrame:
    return contributions.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values])


def below(rows: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """For each node above others, the ``values`` summed over all nodes beneath it.

    ``rows`` has ``c``, ``depth``, the keys of the row and of its parent, and ``values``: those of
    the node in one of its rows, null in its others.
    """
    rows = written(_in_bands(rows.select("c", *KEY, "p1", "p2", *values)))
    nodes = rows.where(F.col(values[0]).isNotNull())
    ups = nodes.select(F.explode("path").alias("a"), *values).select("a.*", *values)
    if deepest <= BAND:
        return _summed(ups, values)
    inner = written(_summed(ups, values))

    # Bottoms of bands are the tops of the next: a trie of a BAND-th of the depth, in which a top
    # counts for what lies beneath it in its band.
    bottoms = rows.where(f"depth % {BAND} = 0")
    reps = bottoms.where(F.col(values[0]).isNotNull()).select("c", *KEY)
    own = reps.join(inner, KEY, "left").select("c", "depth", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
    tops = (
        bottoms.select("c", *KEY, F.col("path")[0].alias("top"))
        .join(own, ["c", "depth"], "left")
        .selectExpr("c", f"depth div {BAND} AS depth", "k1", "k2", "top.k1 AS p1", "top.k2 AS p2", *values)
    )
    beneath = written(below(tops, values, deepest // BAND).withColumn("depth", F.col("depth") * BAND))

    # Completed totals of tops; those of bottoms pass to their ancestors within the band, its top
    # excepted, whose total holds them already.
    full = written(_summed(inner.where(f"depth % {BAND} = 0").unionByName(beneath), values))
    inside = F.explode(F.expr("slice(path, 2, size(path))")).alias("a")
    passed = (
        bottoms.where(F.col(values[0]).isNotNull())
        .select(*KEY, "path")
        .join(full, KEY)
        .select(inside, *values)
        .select("a.*", *values)
    )
    within = inner.where(f"depth % {BAND} <> 0").unionByName(passed)
    return _summed(within, values).unionByName(full)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests texts that come in pieces, in the order of their keys and places."""
    names = [*KEY, "ends_sha256"]
    key, state = None, None
    for batch in batches:
        done = []
        for *found, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key is not None and found == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append([*key, state.hexdigest()])
                key, state = found, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=names)


def _ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Digest of the ids that end at each node. Ids are joined in runs of at most ``IDS``, and the
    runs of a node pass through one digest one after the other, never at once."""
    last = rows.select("c", *KEY).join(convs.withColumnRenamed("n", "depth"), ["c", "depth"])
    turnless = convs.where("n = 0").selectExpr("c", "n AS depth", "0L AS k1", "0L AS k2")
    numbered = running(written(last.unionByName(turnless)), KEY, ["c"])
    place = F.expr(f"idx div {IDS}").alias("place")
    runs = numbered.groupBy(*KEY, place).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    texts = runs.select(*KEY, "place", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = texts.repartition(*KEY).sortWithinPartitions(*KEY, "place").drop("place")
    return dealt.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are left
    out. A conversation is rebuilt from the first h = crc32(conv_id) % 6 turns of conversation
    ``conv_id - conv_id % 100`` and its own turns after its first h. The result has, for each
    distinct sequence of first turns: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points
    that the members share, over the subtree) and ``ends_sha256`` (of the ids that end here).

    A null role or text reads as an empty one; rows of a null ``conv_id`` belong to no
    conversation and are left out. Null turns come first; turns of an equal number, repeated rows
    among them, all count and follow in the order of their SHA-256 digests. An empty table gives
    an empty result.
    """
    convs, turns = rebuilt(conversations)
    rows = prefixes(turns)
    root = convs.groupBy().agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    root = root.where("n_convs > 0").selectExpr(
        "0L AS depth", "0L AS k1", "0L AS k2", "conv_id", "n_convs",
        "0L AS chars", "CAST(NULL AS long) AS p1", "CAST(NULL AS long) AS p2",
    )
    each = rows.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("chars", "p1", "p2")],
    )
    nodes = written(each.unionByName(root))
    children = (
        nodes.where("depth > 0").selectExpr(*PARENT).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    )
    above = nodes.selectExpr("depth + 1 AS depth", "k1 AS p1", "k2 AS p2", "conv_id AS parent_conv_id")
    nodes = written(
        nodes.join(children, KEY, "left")
        .join(above, ["depth", "p1", "p2"], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", F.expr("(n_convs - 1) * chars"))
    )
    own = nodes.where("depth > 0").selectExpr("conv_id AS c", "depth", "leaves", "saved")
    valued = rows.join(own, ["c", "depth"], "left")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    beneath = below(valued, ["leaves", "saved"], deepest).selectExpr(
        *KEY, "leaves AS more_leaves", "saved AS more_saved"
    )
    return (
        nodes.join(beneath, KEY, "left")
        .join(_ends(convs, rows), KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.expr("leaves + coalesce(more_leaves, 0) AS n_leaves"),
            F.expr("saved + coalesce(more_saved, 0) AS saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
