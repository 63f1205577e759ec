"""Near copies by word-set similarity: operator 8's fingerprints, byte-position index, count filter and
check of bits, then the same index and filter over more bytes for what 64 sign bits cannot show.

A text is the set of its shingles of SHINGLE words (64-bit hashes); texts of one set are one node,
so exact copies cost nothing. Every link is counted on whole sets, in integers, whichever way its
pair was met, so no link is below the similarity.

Sign bits: a node's SimHash fingerprint is the majority of its shingles' hashes, bit by bit. The
fingerprints go through `simhash.links`; nodes of one fingerprint are held to the smallest of them.

Minima: at a similarity of 0.8 two fingerprints differ in about 10 of 64 bits: no byte is sure to
agree, and keys long enough to be selective would be needed by the hundred. So the further
positional bytes are those of minima: byte i of a text's signature is the lowest byte of the least
value of its shingles under the i-th hash function, and two texts of similarity s share each byte
with a probability of s at least.

* Index: BANDS keys of ROWS positions each, over the whole minima. Two sets at 0.8 share a key with
  probability 1 - (1 - 0.8 ** ROWS) ** BANDS, all but 5 in 100 million.
* Count filter: pairs that meet are tallied over all positional bytes, kept from MIN_SHARED on; at
  0.8 a pair shares 102 of 128 with a deviation of 4.5, so fewer than 1 in a million is lost.

Lists of up to LIST nodes are paired whole. In longer ones each node is paired with the list's
smallest. Lists that share nodes make a family; what these pairs leave outside a family's largest
component is then compared with the whole family, in blocks of about BLOCK nodes dealt by hash: two
blocks meet in one task, which counts all their pairs and returns a spanning forest of the links.
No row is made for a pair that is not linked, no task holds more than two blocks, and the members of
the largest component, often all, are never compared with each other again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored
from .components import stars
from .simhash import bit_counts, links, majority, tally

SHINGLE = 5
#: Similarity as a fraction, so that no rounding decides.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
#: Positional bytes that a pair must share, of BANDS * ROWS.
MIN_SHARED = 80
#: So many nodes at most are broadcast, 8 bytes each; more are joined by shuffle.
BROADCAST_NODES = 1_000_000
LIST = 32
BLOCK = 128
SEED = 42
_CHUNK = 1 << 10
_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text in UTF-8, hashed and sorted; a shorter text is one."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if len(words) < shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(p, SEED) for p in parts), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the BANDS * ROWS functions."""
    out = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), _CHUNK):
        out = np.minimum(out, (hashes[k : k + _CHUNK, None] * _A + _B).min(0))
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes, in signed form."""
    return int(np.uint64(majority(bit_counts(hashes), len(hashes))).view(np.int64))


def node_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def keys_of(least: np.ndarray) -> list[int]:
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(rows)]


def signature(least: np.ndarray) -> np.ndarray:
    """The positional bytes, eight to a number."""
    return (least & np.uint64(255)).astype(np.uint8).view("<i8")


def _each(shingle: int, what: str):
    def run(batches):
        for batch in sliced(batches):
            sets = [shingles(t or b"", shingle) for t in batch.column(1).to_pylist()]
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            if what == "keys":
                least = [minima(s) for s in sets]
                numbers = pa.list_(pa.int64())
                more = [pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64())]
                more += [pa.array([keys_of(x) for x in least], numbers), pa.array([signature(x) for x in least], numbers)]
                yield pa.RecordBatch.from_arrays([batch.column(0), nodes, *more], names=["doc_id", "node", "n", "fp", "keys", "sig"])
            else:
                values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([nodes, values], names=["node", "s"])

    return run


def alike(shared: Column, a: Column, b: Column, similar: tuple[int, int] = SIMILAR) -> Column:
    """shared / (a + b - shared) >= similar in integers."""
    p, q = similar
    return shared * (p + q) >= (a + b) * p


def block_links(block: pa.Table, similar: tuple[int, int] = SIMILAR) -> pa.Table:
    """A spanning forest of the links between two blocks; columns side, node, s. A node may be in both."""
    sides, nodes = block["side"].to_numpy(), block["node"].to_numpy()
    column = block["s"].combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    ids = np.unique(column.flatten().to_numpy(), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(nodes)), sizes)
    starts = np.cumsum(sizes) - sizes
    other = np.flatnonzero(sides == 1)
    inside = np.isin(owner, other)
    theirs, whose = ids[inside], owner[inside]
    mark, root, out = np.zeros(len(ids) + 1, bool), list(range(len(nodes))), []
    p, q = similar

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(sides == 0):
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        shared = np.bincount(whose[mark[theirs]], minlength=len(nodes))
        mark[own] = False
        for j in other[shared[other] * (p + q) >= (sizes[other] + sizes[i]) * p]:
            if nodes[i] != nodes[j] and find(i) != find(j):
                root[find(i)] = find(j)
                out.append((nodes[i], nodes[j]))
    return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})


def forest(roots: DataFrame) -> DataFrame:
    """(x, root) of every node of components given as (u, v), v the root."""
    return roots.select(F.col("u").alias("x"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("x"), F.col("v").alias("root")).distinct())


def family_links(lists: DataFrame, linked: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links in the families of long lists that the component of each node does not show yet.
    lists: (node, low), low the smallest node of the list; linked: (u, v), components so far."""
    families = forest(stars(lists.select(F.col("node").alias("u"), F.col("low").alias("v")), "near-families"))
    families = families.select(F.col("x").alias("member"), F.col("root").alias("family"))
    members = families.join(forest(linked), F.col("member") == F.col("x"), "left")
    members = members.select("member", "family", F.coalesce("root", "member").alias("part"))
    parts = members.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy(F.col("family").alias("f")).agg(F.max(F.struct("n", "part")).alias("largest"), F.sum("n").alias("all"))
    sizes = sizes.withColumn("rest", F.col("all") - F.col("largest.n")).filter("rest > 0")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = sizes.select("f", F.col("largest.part").alias("main"), blocks("all").alias("wide"), blocks("rest").alias("tall"))
    members = members.join(sizes, F.col("family") == F.col("f"))
    own = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "member"), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = members.select("member", "family", each("tall").alias("a"), own("near-wide", "wide").alias("b"), F.lit(1).alias("side"))
    left = members.filter("part <> main").select("member", "family", own("near-tall", "tall").alias("a"), each("wide").alias("b"), F.lit(0).alias("side"))
    dealt = left.union(right).join(sets, F.col("member") == F.col("node")).select("family", "a", "b", "side", "node", "s")

    def compared(block: pa.Table) -> pa.Table:
        return block_links(block, similar)

    return dealt.groupBy("family", "a", "b").applyInArrow(compared, "u long, v long")


def sign_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes, u < v, that operator 8 links by their fingerprints; nodes: node, fp.
    Fingerprints within its bits are connected through their smallest nodes, and nodes of one
    fingerprint with the smallest of them."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")), "near-fingerprints")
    of = lambda name, head: heads.select(F.col("fp").alias(name), F.col("head").alias(head))
    met = links(heads.select("fp")).join(of("l", "a"), F.col("u") == F.col("l")).join(of("r", "b"), F.col("v") == F.col("r"))
    same = heads.filter("size > 1").select(F.col("fp").alias("l"), F.col("head").alias("a"))
    same = nodes.join(same, F.col("fp") == F.col("l")).filter("node <> a").select("a", F.col("node").alias("b"))
    return met.select("a", "b").union(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document doc_id and component_id, the smallest doc_id that links of similarity 0.8 reach.

    Null and empty texts are copies of each other and of no other text. A null id is never the
    smallest unless its component has no other; repeated rows return once each; a pair of just
    four fifths is linked; columns other than doc_id and text are not read; an empty table gives
    an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    rows = stored(texts.mapInArrow(_each(shingle, "keys"), f"doc_id {kind}, node long, n long, fp long, keys array<long>, sig array<long>"), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n", "fp", "keys", "sig")])
    nodes = stored(nodes, "near-nodes")
    posts = nodes.filter("n > 0").select("node", "n", F.explode("keys").alias("key"))
    lists = posts.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).filter("size > 1")
    posts = stored(posts.join(lists, F.col("key") == F.col("k")).select("key", "node", "n", "size", "least"), "near-postings")

    short = posts.filter(F.col("size") <= LIST).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    p, q = SIMILAR

    def partners(a: Column, i: Column) -> Column:
        fits = lambda b: (F.least(a["n"], b["n"]) * q >= F.greatest(a["n"], b["n"]) * p)
        later = F.filter(F.slice("m", i + 2, F.size("m")), fits)
        return F.transform(later, lambda b: F.struct(a["node"].alias("u"), b["node"].alias("v")))

    pairs = short.select(F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.u", "e.v")
    long = stored(posts.filter(F.col("size") > LIST).select("node", F.col("least").alias("low")).distinct(), "near-lists")
    hubs = long.filter("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    pairs = pairs.union(hubs).distinct()
    of = lambda name, sig: nodes.select(F.col("node").alias(name), F.col("sig").alias(sig))
    pairs = pairs.join(of("l", "a"), F.col("u") == F.col("l")).join(of("r", "b"), F.col("v") == F.col("r"))
    shared = F.aggregate(F.zip_with("a", "b", lambda x, y: tally(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = pairs.filter(shared >= MIN_SHARED).select("u", "v")
    pairs = stored(pairs.union(sign_pairs(nodes.filter("n > 0").select("node", "fp"))).distinct(), "near-pairs")

    asked = pairs.select(F.col("u").alias("x")).union(pairs.select(F.col("v").alias("x"))).union(long.select(F.col("node").alias("x")))
    asked = stored(asked.distinct(), "near-asked")
    sets = texts.mapInArrow(_each(shingle, "sets"), "node long, s array<long>")
    if asked.count() <= BROADCAST_NODES:
        sets = sets.join(F.broadcast(asked), F.col("node") == F.col("x"), "left_semi")
        sets = sets.groupBy("node").agg(F.first("s").alias("s"))
    else:  # copies become one row before the join
        sets = sets.groupBy("node").agg(F.first("s").alias("s")).join(asked, F.col("node") == F.col("x"), "left_semi")
    sets = stored(sets, "near-sets")

    left = sets.select(F.col("node").alias("l"), F.col("s").alias("a"))
    right = sets.select(F.col("node").alias("r"), F.col("s").alias("b"))
    both = pairs.join(left, F.col("u") == F.col("l")).join(right, F.col("v") == F.col("r"))
    near = both.filter(alike(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("u", "v")
    roots = stars(near, "near-links")
    more = stored(family_links(long, roots, sets), "near-family-links")
    if not more.isEmpty():
        roots = stars(roots.union(more), "near-links")

    linked = forest(roots)
    lows = linked.join(nodes, F.col("x") == F.col("node")).groupBy(F.col("root").alias("c_root")).agg(F.min("low").alias("c"))
    linked = linked.join(lows, F.col("root") == F.col("c_root")).select("x", "c")
    classes = nodes.join(linked, F.col("node") == F.col("x"), "left")
    classes = stored(classes.select(F.col("node").alias("n_node"), F.coalesce("c", "low").alias("component_id")), "near-classes")
    return rows.join(classes, F.col("node") == F.col("n_node")).select("doc_id", "component_id")
