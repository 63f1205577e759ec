"""The prefix trie of conversations, rolled up by pointer jumping.

A node is the digest of the first d turns of a conversation, and a turn's row holds the edge from its
node to its parent. Digests are sums of the digests of (place, turn), in four lanes of 32 bits each, so
they come out of prefix sums: conversations are dealt by ranges of (conv_id, turn), each range is summed
on its own and a row for each range and conversation carries the sums on. A conversation with any share
of all turns is spread over many tasks.

The rollup doubles: after round k a node has the counts of its subtree down to 2 ** k levels below and
points to its ancestor 2 ** k levels above; adding up what points at a node and following the pointer
once more doubles both. A trie of depth D takes log2(D) rounds, each a few joins on the digest, each
written as a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

LANES = 4
#: Rebuilt conversations share the head of every BLOCK-th conversation, up to MOST_SHARED turns of it.
BLOCK, MOST_SHARED = 5, 8
#: Ids whose digits are joined in one piece of a node's list.
PIECE = 4096


class Trie(NamedTuple):
    """nodes: node, parent (null: root), conv_id (smallest member), parent_conv_id, depth, n_convs,
    n_children, n_leaves, saved_tokens. ends: node, conv_id of each conversation that ends there."""

    nodes: DataFrame
    ends: DataFrame


def _places(batches):
    """Rows sorted by conversation: the partition, and each row's place among its conversation's rows there."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        if ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(place[-1]) + 1
        parts = pa.array(np.full(len(ids), part, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), parts, pa.array(place, pa.int64()), *batch.columns[1:]], names=["conv_id", "part", "place", "content", "bytes"])


def ordered(conversations: DataFrame) -> DataFrame:
    """The turns of each conversation in order: conv_id, part (a range of the order), place (from 0),
    content (the digest of role and text) and bytes (of the text in UTF-8).

    Turns go by turn, null first; ties by role, then text; repeated rows are turns each. A null role or
    text is empty; rows without conv_id belong to no conversation. Other columns are not read.
    """
    spark = conversations.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role").alias("role"), empty("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    # the start of the text is enough to part a crowd of rows of one turn
    rows = rows.repartitionByRange(partitions(spark), *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    content = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = rows.select("conv_id", content.alias("content"), F.octet_length("text").cast("long").alias("bytes"))
    places = stored(rows.mapInArrow(_places, "conv_id long, part int, place long, content string, bytes long"), "trie-places")
    counts = stored(places.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "trie-parts")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c_id"), F.col("part").alias("c_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    both = places.join(counts, (F.col("conv_id") == F.col("c_id")) & (F.col("part") == F.col("c_part")))
    return stored(both.select("conv_id", "part", (F.col("before") + F.col("place")).alias("place"), "content", "bytes"), "trie-ordered")


def sizes(turns: DataFrame) -> DataFrame:
    """(conv_id, size) of conversations given as turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c again as the first h turns of conversation c - c % BLOCK and its own turns after its
    first h, h = crc32(c) % (MOST_SHARED + 1): its turns, and the sizes of all, which may be 0."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    convs = sizes(turns).select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    convs = stored(convs, "trie-convs")
    bases = convs.filter("conv_id = base").select(F.col("conv_id").alias("b_id"), F.col("size").alias("b_size"))
    heads = F.least("h", F.coalesce("b_size", F.lit(0)))
    convs = convs.join(bases, F.col("base") == F.col("b_id"), "left").select("conv_id", "base", "h", heads.alias("head"), "size")
    convs = stored(convs.withColumn("new_size", F.col("head") + F.greatest(F.lit(0), F.col("size") - F.col("h"))), "trie-rebuilt-sizes")
    slim = convs.select(F.col("conv_id").alias("k_id"), "h", "head")
    own = turns.join(slim, F.col("conv_id") == F.col("k_id")).filter("place >= h")
    own = own.select("conv_id", "part", (F.col("head") + F.col("place") - F.col("h")).alias("place"), "content", "bytes")
    first = turns.filter(f"conv_id % {BLOCK} = 0 AND place < {MOST_SHARED}").select(F.col("conv_id").alias("f_id"), "place", "content", "bytes")
    shared = convs.select("conv_id", "base", "h").join(first, (F.col("base") == F.col("f_id")) & (F.col("place") < F.col("h")))
    shared = shared.select("conv_id", F.lit(-1).alias("part"), "place", "content", "bytes")
    return own.unionByName(shared), convs.select("conv_id", F.col("new_size").alias("size"))


def _digest(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", depth, *lanes).cast("binary"), 256), 1, 32))


def edges(turns: DataFrame, sized: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, depth (from 1), node, parent, bytes, last (whether the conversation
    ends there). Prefix sums are taken in each part; the sums of earlier parts are carried over."""
    tag = F.sha2(F.concat_ws(":", F.col("place"), F.col("content")).cast("binary"), 256)
    names = [f"lane{k}" for k in range(LANES)]
    numbers = [F.conv(F.substring("tag", 8 * k + 1, 8), 16, 10).cast("long").alias(n) for k, n in enumerate(names)]
    rows = turns.withColumn("tag", tag).select("conv_id", "part", "place", "bytes", *numbers)
    rows = stored(rows, "trie-turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv_id", "part").agg(*[F.sum(n).alias(n) for n in names])
    carried = carried.select("conv_id", "part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"c_{n}") for n in names])
    carried = carried.join(sized.withColumnRenamed("size", "length"), "conv_id")
    here = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s_{n}": F.sum(n).over(here) for n in names}).join(carried, ["conv_id", "part"])
    depth, upto = F.col("place") + 1, [F.col(f"s_{n}") + F.col(f"c_{n}") for n in names]
    above = [s - F.col(n) for s, n in zip(upto, names, strict=True)]
    last = depth == F.col("length")
    found = rows.select("conv_id", depth.alias("depth"), _digest(depth, upto).alias("node"), _digest(F.col("place"), above).alias("parent"), "bytes", last.alias("last"))
    return stored(found, "trie-edges")


def rollup(nodes: DataFrame, values: tuple[str, ...], depth: int) -> DataFrame:
    """nodes: node (a key), up (its parent or null) and long columns `values`: (node, *values) with the
    values summed over subtrees. depth: the most edges from the root down, a bound is enough."""
    now = stored(nodes.select("node", "up", *values), "trie-round")
    for _ in range(depth.bit_length()):
        # what has passed the root has nothing more to give
        alive = now.filter("up IS NOT NULL")
        given = alive.groupBy(F.col("up").alias("to")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        jumps = now.select(F.col("node").alias("at"), F.col("up").alias("next"))
        ups = alive.select(F.col("node").alias("from"), "up").join(jumps, F.col("up") == F.col("at")).filter("next IS NOT NULL").select("from", "next")
        both = now.drop("up").join(given, F.col("node") == F.col("to"), "left").join(ups, F.col("node") == F.col("from"), "left")
        sums = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
        now = stored(both.select("node", F.col("next").alias("up"), *sums), "trie-round")
    return now.drop("up")


def trie(turns: DataFrame, sized: DataFrame) -> Trie:
    """The prefix trie of conversations given as `ordered` turns and their sizes (0: without turns).

    Conversations of equal turns share all nodes and are members each; one without turns is a member
    of the root alone; without conversations there is no node. saved_tokens counts UTF-8 bytes.
    """
    root = _digest(F.lit(0), [F.lit(0)] * LANES)
    steps = edges(turns, sized)
    first = [F.first(c).alias(c) for c in ("parent", "depth", "bytes")]
    nodes = steps.groupBy("node").agg(*first, F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = sized.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("binary")
    top = top.select(root.alias("node"), none.alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), "conv_id", "n_convs")
    nodes = stored(nodes.unionByName(top), "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("c_node")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("node").alias("a_node"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, F.col("node") == F.col("c_node"), "left").join(above, F.col("parent") == F.col("a_node"), "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("c_node", "a_node")
    nodes = stored(nodes, "trie-children")
    own = {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    summed = rollup(nodes.select("node", F.col("parent").alias("up"), *[v.alias(n) for n, v in own.items()]), tuple(own), deepest)
    nodes = nodes.join(summed.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"))
    nodes = nodes.select("node", "parent", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", *own)
    ends = steps.filter("last").select("node", "conv_id").unionByName(sized.filter("size = 0").select(root.alias("node"), "conv_id"))
    return Trie(nodes, ends)


def _pieces(size: int):
    """Ids sorted by node, joined: a row for each node and `size` ids at most, with the first of them."""

    def row(node, ids):
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})

    def run(batches):
        node, ids = None, []
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) == size):
                    yield row(node, ids)
                    ids = []
                node = n
                ids.append(c)
        if ids:
            yield row(node, ids)

    return run


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids that end at a node, ascending, comma-joined. Ids are sorted
    and joined in pieces by range; a node of more pieces has them streamed through one digest, in order,
    which is as far as this digest can be split."""
    spark = ends.sparkSession
    ends = stored(ends, "trie-ends")
    pieces = ends.repartitionByRange(partitions(spark), "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = stored(pieces.mapInArrow(_pieces(PIECE), "node binary, first long, ids string"), "trie-pieces")
    counts = pieces.groupBy(F.col("node").alias("p_node")).agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.join(counts, F.col("node") == F.col("p_node"))
    alone = pieces.filter("n = 1").select("node", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, node, before = hashlib.sha256(), None, None
        for batch in batches:
            for n, first, ids in zip(*[batch.column(k) for k in range(3)], strict=True):
                node, first = n.as_py(), first.as_py()
                if before is not None and first < before:
                    raise ValueError("pieces of a node came out of order")
                digest.update((b"" if before is None else b",") + ids.as_py().encode())
                before = first
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()])})

    streamed.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    # the row number's window leaves the pieces of a node in order on the exchange that the group uses
    place = F.row_number().over(Window.partitionBy("node").orderBy("first"))
    many = pieces.filter("n > 1").select("node", "first", "ids").withColumn("place", place)
    return alone.unionByName(many.groupBy("node").applyInArrow(streamed, "node binary, ends_sha256 string"))


def report(found: Trie) -> DataFrame:
    digests = end_digests(found.ends).withColumnRenamed("node", "e_node")
    rows = found.nodes.join(digests, F.col("node") == F.col("e_node"), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return rows.select(*names, F.coalesce("ends_sha256", empty).alias("ends_sha256"))
