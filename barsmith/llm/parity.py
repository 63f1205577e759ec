"""N-gram Jaccard join on parity sketches.

A text is the set of its different shingles (64-bit hashes); texts of one set are one node, so exact
copies cost nothing. A sketch has P words: each shingle is XORed into one of them, as a bit of the low
half and as a hash of the high half. What two sets share cancels out, so the Hamming distance of the low
halves, and the number of words that differ, are at most the size of the symmetric difference, and at
similarity p/q that is at most (a + b)(q - p)/(p + q) for sizes a and b.

* Size bands: borders grow by RATIO, more than q/p, so partners lie in one band or in two neighbours. A
  set has a sketch for its own band and, if a partner may be there, one for the next; a pair meets in
  the band of its larger set.
* Pigeonhole: D differences at most touch D words, and a sketch has P = D + 1 + skip + spare words, so a
  linked pair shares 1 + skip + spare words or more. Words are the join's keys. Of its own words a set
  posts the D + 1 + spare with the most bits, which leaves out words that say nothing, and a linked pair still has 1 + spare of them in common. Of those that another set posts
  too, it keeps all but the `spare` most frequent: of two sets that share more than `spare` words the
  rarest is kept by both. Words of a passage that many texts hold thus go before any pair is made, and
  texts that share no more than those have no keys left at all.
* Check: pairs that meet are held to the Hamming bound on whole sketches, then to their whole sets in
  integers, so no link is below the similarity and none is lost.

Lists of a key of up to LIST nodes are paired whole. In longer ones, which come from crowds of near
copies, each node is paired with the smallest of the list, and what that leaves outside the largest
component goes through nearcopies' blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored
from .components import stars
from .nearcopies import BROADCAST_NODES, alike, family_links, forest, node_of, shingles

SHINGLE = 4
#: Similarity as a fraction, so that no rounding decides.
SIMILAR = (17, 20)
LIST = 32
#: Words beyond those of the pigeonhole, as shares of its differences: left out as too empty or too frequent.
SKIP, SPARE = 1 / 8, 1 / 8
#: How much wider than the last a size band is.
RATIO = 7, 5
LOW = np.uint64(0xFFFFFFFF)
#: Sets of more shingles than Arrow can count are out of reach, so borders end beyond that.
MOST = 1 << 31


class Bands:
    """Bands of sizes for a similarity: borders, and the differences, spare words and words of each."""

    def __init__(self, similar: tuple[int, int] = SIMILAR, skip: float = SKIP, spare: float = SPARE):
        self.p, self.q = p, q = similar
        self.low = [1]
        while self.low[-1] < MOST:
            self.low.append(max(self.low[-1] * q // p + 1, self.low[-1] * RATIO[0] // RATIO[1]) if p < q else MOST)
        self.top = [x - 1 for x in self.low[1:]] + [self.low[-1] * q // p]
        self.most = [self.differences(x, x) for x in self.top]
        self.spare = [int(np.ceil(d * spare)) for d in self.most]
        self.words = [d + 1 + s + int(np.ceil(d * skip)) for d, s in zip(self.most, self.spare, strict=True)]

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def differences(self, a: int, b: int) -> int:
        """Of two linked sets of these sizes, at most."""
        return (a + b) * (self.q - self.p) // (self.p + self.q)

    def at(self, n: int) -> list[int]:
        """The bands in which a set of size n can meet another one."""
        own = self.of(n)
        return [k for k in (own, own + 1) if self.most[k] and (k == own or n * self.q // self.p >= self.low[k])]

    def posted(self, n: int, at: int) -> int:
        """Words that a set of size n posts in a band."""
        return self.differences(n, min(n * self.q // self.p, self.top[at])) + 1 + self.spare[at]


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Words of the parity of 32 bits and, above, of 32-bit hashes."""
    h = mixed(hashes)  # the order of the sorted set is no part of it
    value = (h & ~LOW) | (np.uint64(1) << ((h >> np.uint64(27)) & np.uint64(31)))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (h % np.uint64(words)).astype(np.int64), value)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(words: np.ndarray, band: int) -> np.ndarray:
    """A key of 48 bits for each word of a band's sketch, by place and value."""
    place = np.arange(len(words), dtype=np.uint64) + np.uint64((band << 40) + 1)
    return (mixed(words ^ mixed(place)) >> np.uint64(16)).view(np.int64)


def posted(words: np.ndarray, at: int, n: int, bands: Bands) -> np.ndarray:
    """The keys that a set of size n posts of its sketch in a band: those of most bits, ties by key."""
    keys = keys_of(words, at)
    return keys[np.lexsort((keys, -np.bitwise_count(words & LOW).astype(np.int64)))[: bands.posted(n, at)]]


def _sketches(shingle: int, bands: Bands):
    numbers = pa.list_(pa.int64())

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            nodes, sizes, own, two = [], [], [], ([], [])
            for text in batch.column(1):
                s = shingles(text.as_py() or b"", shingle)
                band = bands.of(len(s)) if len(s) else -1
                nodes.append(node_of(s))
                sizes.append(len(s))
                own.append(band)
                meets = bands.at(len(s)) if len(s) else []
                for k in (0, 1):
                    two[k].append(sketch(s, bands.words[band + k]).view(np.int64) if band + k in meets else np.zeros(0, np.int64))
            columns = [batch.column(2), pa.array(np.arange(row, row + len(nodes))), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(own, pa.int32()), *[pa.array(x, numbers) for x in two]]
            row += len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "digest", "row", "node", "n", "band", "own", "next"])

    return run


def _postings(bands: Bands):
    def run(batches):
        for batch in sliced(batches):
            nodes, band, size = (batch.column(k).to_numpy() for k in range(3))
            parts = []
            for k in (0, 1):
                for i, words in enumerate(batch.column(3 + k)):
                    values = words.values.to_numpy()
                    if len(values):
                        at = int(band[i]) + k
                        parts.append((nodes[i], at, size[i], posted(values.view(np.uint64), at, int(size[i]), bands)))
            counts = [len(p[3]) for p in parts]
            flat = [pa.array(np.repeat(np.array([p[k] for p in parts], t), counts)) for k, t in enumerate((np.int64, np.int32, np.int64))]
            keys = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*flat, pa.array(keys)], names=["node", "at", "n", "key"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in sliced(batches):
            sets = [shingles(t.as_py() or b"", shingle) for t in batch.column(0)]
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), values], names=["node", "s"])

    return run


def lists(nodes: DataFrame, bands: Bands) -> DataFrame:
    """(key, node, at, n, seen) of the keys that nodes keep: at is the key's band, seen how many nodes have
    posted it. nodes: node, n, band and the sketches."""
    posts = nodes.select("node", "band", "n", "own", "next").mapInArrow(_postings(bands), "node long, at int, n long, key long")
    # postings are found twice and never written: the counts need their keys alone
    counts = posts.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    shared = posts.join(counts, F.col("key") == F.col("k"))
    spare = F.get(F.array(*[F.lit(s) for s in bands.spare]), F.col("at"))
    own = Window.partitionBy("node", "at")  # as many rows as a sketch has words
    place = F.row_number().over(own.orderBy("seen", "key"))
    kept = shared.select("key", "node", "at", "n", "seen").withColumn("place", place).withColumn("words", F.count(F.lit(1)).over(own))
    return stored(kept.filter(F.col("place") <= F.col("words") - spare).drop("place", "words"), "parity-lists")


def candidates(posts: DataFrame, bands: Bands, similar: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v, at) whose sizes allow a link, each once, in the band of the larger set; and (node, low)
    of the lists that are longer than LIST, low the smallest node of the list."""
    p, q = similar
    low = F.get(F.array(*[F.lit(x).cast("long") for x in bands.low]), F.col("at"))
    fits = lambda a, b: (F.least(a, b) * q >= F.greatest(a, b) * p) & (F.greatest(a, b) >= F.col("low"))
    # rows are dealt as they are, and lists of LIST nodes at most are put together where they arrive
    short = posts.filter(F.col("seen") <= LIST).select("key", "node", "at", "n").repartition("key")
    short = short.groupBy("key").agg(F.first("at").alias("at"), F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    short = short.filter(F.size("m") > 1).withColumn("low", low)

    def partners(a: Column, i: Column) -> Column:
        later = F.filter(F.slice("m", i + 2, F.size("m")), lambda b: fits(a["n"], b["n"]))
        return F.transform(later, lambda b: F.struct(a["node"].alias("u"), b["node"].alias("v")))

    pairs = short.select("at", F.explode(F.flatten(F.transform("m", partners))).alias("e")).select("e.u", "e.v", "at")
    long = posts.filter(F.col("seen") > LIST).withColumn("low", low)
    least = long.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("node", "n")).alias("least"))
    long = stored(long.join(least, F.col("key") == F.col("k")).filter(F.col("node") != F.col("least.node")).select("node", "n", "at", "low", "least").distinct(), "parity-long")
    hubs = long.filter(fits(F.col("n"), F.col("least.n"))).select(F.col("least.node").alias("u"), F.col("node").alias("v"), "at")
    ends = long.select("node", F.col("least.node").alias("low"))
    return pairs.union(hubs).distinct(), ends.union(ends.select(F.col("low").alias("node"), "low")).distinct()


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (u, v, at) that are linked: first by the Hamming bound on sketches, then on whole sets."""
    p, q = similar
    words = F.when(F.col("band") == F.col("at"), F.col("own")).otherwise(F.col("next"))
    for name in ("u", "v"):
        of = sketches.select(F.col("node").alias(f"{name}_node"), F.col("n").alias(f"{name}_n"), "band", "own", "next")
        pairs = pairs.join(of, F.col(name) == F.col(f"{name}_node")).withColumn(f"{name}_words", words)
        pairs = pairs.select("at", "u", "v", *[f"{x}_{y}" for x in "uv" for y in ("n", "words") if f"{x}_{y}" in pairs.columns])
    bits = lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(int(LOW))))
    apart = F.aggregate(F.zip_with("u_words", "v_words", bits), F.lit(0), lambda s, x: s + x)
    pairs = pairs.filter(apart * (p + q) <= (F.col("u_n") + F.col("v_n")) * (q - p)).select("u", "v").distinct()
    left = sets.select(F.col("node").alias("l"), F.col("s").alias("a"))
    right = sets.select(F.col("node").alias("r"), F.col("s").alias("b"))
    both = pairs.join(left, F.col("u") == F.col("l")).join(right, F.col("v") == F.col("r"))
    return both.filter(alike(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"), similar)).select("u", "v")


def near_sets(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Per document doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    A text of fewer words than a shingle has the whole sequence for its one shingle. Null texts and
    texts without words have none and are linked with nothing: each is its own component, and so are
    repeated rows of them, by their id. A null id is never the smallest unless its component has no
    other; repeated rows return once each; a pair of just that similarity is linked; columns other than
    doc_id and text are not read; an empty table gives an empty result.
    """
    kind, bands = docs.schema["doc_id"].dataType.simpleString(), Bands(similar)
    text = F.col("text").cast("string").cast("binary")
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))
    schema = f"doc_id {kind}, digest long, row long, node long, n long, band int, own array<long>, next array<long>"
    rows = stored(texts.mapInArrow(_sketches(shingle, bands), schema), "parity-rows")
    members = rows.filter("n > 0").groupBy("node")
    nodes = members.agg(F.min("doc_id").alias("low"), F.min("row").alias("kept_row"), F.min_by("digest", "row").alias("digest"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "parity-nodes")
    # sketches stay where they are; of copies all rows but one go, whose number is the node's in what follows
    copies = nodes.filter("copies > 1").select(F.col("node").alias("c_node"), "kept_row")
    small = copies.count() <= BROADCAST_NODES
    sketched = rows.filter("n > 0").join(F.broadcast(copies) if small else copies, F.col("node") == F.col("c_node"), "left")
    sketched = sketched.filter(F.coalesce(F.col("row") == F.col("kept_row"), F.lit(True)))
    sketched = sketched.select(F.col("row").alias("node"), "n", "band", "own", "next")
    by_row = nodes.select(F.col("kept_row").alias("r"), F.col("node").alias("name"))

    def named(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.join(by_row, F.col(c) == F.col("r")).withColumn(c, F.col("name")).drop("r", "name")
        return df

    pairs, long = candidates(lists(sketched, bands), bands, similar)
    pairs = stored(named(pairs, "u", "v"), "parity-candidates")
    long = stored(named(long, "node", "low"), "parity-crowds")
    asked = pairs.select(F.col("u").alias("x")).union(pairs.select(F.col("v").alias("x"))).union(long.select(F.col("node").alias("x")))
    asked = stored(asked.distinct(), "parity-asked")
    # only the texts that are asked for are cut into shingles again, and of copies one at least
    few = asked.count() <= BROADCAST_NODES
    wanted = asked.join(nodes, F.col("x") == F.col("node")).select(F.col("digest").alias("d")).distinct()
    sets = texts.join(F.broadcast(wanted) if few else wanted, F.col("digest") == F.col("d"), "left_semi").select("text")
    sets = sets.mapInArrow(_sets(shingle), "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))
    sets = sets.join(F.broadcast(asked) if few else asked, F.col("node") == F.col("x"), "left_semi")
    sets = stored(sets, "parity-sets")

    # sketches of other texts stay where they are
    rows_of = asked.join(nodes, F.col("x") == F.col("node")).select(F.col("kept_row").alias("w"))
    few_sketches = sketched.join(F.broadcast(rows_of) if few else rows_of, F.col("node") == F.col("w"), "left_semi")
    sketches = stored(named(few_sketches, "node"), "parity-sketches")

    # a crowd of near copies has pairs by the square of its size, but one a node shows most of its links:
    # what the first rounds connect is not compared any more, and the last one takes all that is left
    roots, left = stars(pairs.select("u", "v").limit(0), "parity-links"), pairs
    for last in (False, False, True):
        if left.isEmpty():
            break
        pick = left if last else stored(left.groupBy("u").agg(F.min(F.struct("v", "at")).alias("p")).select("u", "p.v", "p.at"), "parity-picked")
        near = verified(pick, sketches, sets, similar)
        roots = stars(roots.union(near), "parity-links")
        if not last:
            linked = forest(roots)
            for c in ("u", "v"):
                left = left.join(linked.select(F.col("x").alias(f"{c}_x"), F.col("root").alias(f"{c}_root")), F.col(c) == F.col(f"{c}_x"), "left")
            apart = ~F.coalesce(F.col("u_root") == F.col("v_root"), F.lit(False))
            left = stored(left.filter(apart).select("u", "v", "at").join(pick, ["u", "v", "at"], "left_anti"), "parity-left")
    more = stored(family_links(long, roots, sets, similar), "parity-family-links")
    if not more.isEmpty():
        roots = stars(roots.union(more), "parity-links")

    linked = forest(roots)
    lows = linked.join(nodes, F.col("x") == F.col("node")).groupBy(F.col("root").alias("c_root")).agg(F.min("low").alias("c"))
    linked = linked.join(lows, F.col("root") == F.col("c_root")).select("x", "c")
    classes = nodes.select("node", "low").join(linked, F.col("node") == F.col("x"), "left")
    classes = stored(classes.select(F.col("node").alias("n_node"), F.coalesce("c", "low").alias("component_id")), "parity-classes")
    found = rows.filter("n > 0").join(classes, F.col("node") == F.col("n_node")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(none)
