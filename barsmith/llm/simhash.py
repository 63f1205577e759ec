"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints at 2 or fewer differing bits share at least 6 of their 8 positional bytes. The
index works on different fingerprints, not on documents, so exact copies cost nothing. With
single positional bytes as keys every list would hold a 256th of all rows and tallies would be
quadratic; so each posting joins four positional bytes: the 8 positions form 4 pairs, at most 2
pairs are touched, hence two of them agree, and the 6 choices of two pairs are the keys. Pairs
that meet under a key are tallied on all 8 positional bytes, kept from 6 on and verified by the
bits. Lists of up to LIST fingerprints are tallied pair by pair. Longer lists go the exact linear
way: a fingerprint there emits its other 4 bytes and their 32 one-bit variants; two fingerprints
meet under a variant exactly if they differ in 2 bits or fewer, and a variant has at most 33
members, all of which are linked to the smallest.

Components come from alternating stars on the fingerprints that have a link.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored
from .components import stars

SHINGLE = 3
MAX_BITS = 2
LIST = 48
SEED = 42
_CHUNK = 1 << 15
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8 as an unsigned integer."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < shingle:
        parts = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    while True:
        h = np.fromiter((hashed(p, SEED) for p in islice(parts, _CHUNK)), np.uint64)
        if not len(h):
            break
        ones += bit_counts(h)
    return majority(ones, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, n: int) -> int:
    """The bits that more than half of n hashes have, as an unsigned integer."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp the signed 64-bit form."""

    def run(batches):
        for batch in sliced(batches):
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _pair(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _key(fp: Column, choice: int) -> Column:
    i, j = _PAIRS[choice]
    return F.lit(choice << 32).bitwiseOR(F.shiftleft(_pair(fp, i), 16)).bitwiseOR(_pair(fp, j))


def _rest(fp: Column, choice: int) -> Column:
    i, j = (k for k in range(4) if k not in _PAIRS[choice])
    return F.shiftleft(_pair(fp, i), 16).bitwiseOR(_pair(fp, j))


def tally(x: Column) -> Column:
    """Positional bytes that two fingerprints share; x is their exclusive or."""
    zero = [F.when(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for k in range(8)]
    total = zero[0]
    for z in zero[1:]:
        total = total + z
    return total


def links(nodes: DataFrame) -> DataFrame:
    """Verified links (u, v) between different fingerprints; nodes: a column fp, each once.
    Every two linked fingerprints are connected by the result."""
    fp = F.col("fp")
    keys = F.array(*[F.struct(_key(fp, c).alias("key"), _rest(fp, c).alias("rest")) for c in range(len(_PAIRS))])
    posts = nodes.select("fp", F.explode(keys).alias("p")).select("fp", "p.key", "p.rest")
    sizes = posts.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    posts = stored(posts.join(sizes, F.col("key") == F.col("k")).select("key", "rest", "fp", "n"), "simhash-postings")
    short = posts.filter(F.col("n") <= LIST).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("m"))

    def partners(a: Column, i: Column) -> Column:
        later = F.slice("m", i + 2, F.size("m"))
        near = lambda b: (tally(a.bitwiseXOR(b)) >= 8 - MAX_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)
        return F.transform(F.filter(later, near), lambda b: F.struct(a.alias("u"), b.alias("v")))

    edges = short.select(F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.u", "e.v")
    one = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    long = posts.filter(F.col("n") > LIST).select("key", "fp", F.explode(F.transform(one, lambda b: F.col("rest").bitwiseXOR(b))).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("key", "variant"))
    hot = long.withColumn("v", least).filter("fp <> v").select(F.col("fp").alias("u"), "v")
    return edges.union(hot)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document doc_id, fp and component_id, the smallest doc_id that links reach.

    Null and empty texts have the fingerprint zero and are linked like any other. A bit that is set in
    just half of the shingles is 0. Of a component's ids the smallest decides, whatever the order of
    rows, and equal ids share it. A null id is never the smallest unless its component has no other; repeated rows return once each; an
    empty table gives an empty result. Copies need not be paired, and no link is lost.
    """
    rows = stored(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    roots = stars(links(nodes.select("fp")), "simhash-links")
    linked = roots.select(F.col("u").alias("l_fp"), F.col("v").alias("root"))
    linked = linked.union(roots.select(F.col("v").alias("l_fp"), F.col("v").alias("root")).distinct())
    lows = linked.join(nodes, F.col("l_fp") == F.col("fp")).groupBy(F.col("root").alias("c_root")).agg(F.min("low").alias("c"))
    linked = linked.join(lows, F.col("root") == F.col("c_root")).select("l_fp", "c")
    classes = nodes.join(linked, F.col("fp") == F.col("l_fp"), "left")
    classes = stored(classes.select(F.col("fp").alias("n_fp"), F.coalesce("c", "low").alias("component_id")), "simhash-classes")
    return rows.join(classes, F.col("fp") == F.col("n_fp")).select("doc_id", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
