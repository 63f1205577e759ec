"""Exact top-k search over an impact-ordered index, score at a time.

The index has a row for each block of candidates. In a block every dimension has its postings by
descending size of the component, cut into segments at quantised levels. For one query a segment's
impact is |q| times the largest component in it. Segments of all dimensions are processed by
descending impact, a step of impact at a time, into one accumulator for each candidate. A candidate's
score then differs from its accumulator by no more than what the segments to come can add or take
away, one of each dimension. The search stops only on proof: no candidate outside the possible members
reaches the k-th best score that is proved so far. Once few are left, or no segment is, they are
rescored exactly, however many they are.

Candidates never move: a query block of bounded size is broadcast and one narrow pass over the index
searches every block with it. A task carries each query's k-th best score from block to block, and
only its best k rows for each query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, stored

K = 5
QUERY_EVERY = 50
#: Candidates of an index block, and queries that are broadcast at once: bounds of memory, not of work.
ROWS_PER_BLOCK = 16384
QUERIES_PER_BLOCK = 8192
#: Segments of a dimension, at most.
LEVELS = 64
#: Steps of impact, as parts of a query's highest one; after each the search may stop.
STEPS = (0.2, 0.08, 0.05, 0.035, 0.02, 0.0)
#: Rescoring starts once a 1 / RESCORE of a block's candidates at most can be members.
RESCORE = 16
INDEX = "block string, n int, width int, ids binary, vectors binary"
OUT = "q long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component; null for vectors that take no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    return F.when(vector.isNotNull() & usable, values)


class Segments:
    """The posting segments of a block of candidates. Sums are exact: values are whole numbers,
    of a kind that holds every score."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        n, self.width = self.values.shape
        self.rows, self.parts = [], []
        # a dimension's segments in order: first posting and largest component of each, then its end
        self.first = np.full((self.width, LEVELS + 1), n, np.int64)
        self.top = np.zeros((self.width, LEVELS + 1), values.dtype)
        for d in range(self.width):
            column = np.abs(self.values[:, d])
            step = int(column.max(initial=0)) // LEVELS + 1
            level = (column // step).astype(np.int64)
            rows = np.argsort(-level, kind="stable")
            borders = np.flatnonzero(np.diff(level[rows], prepend=-1))
            self.rows.append(rows)
            self.parts.append(self.values[rows, d])
            self.first[d, : len(borders)] = borders
            self.top[d, : len(borders)] = np.maximum.reduceat(column[rows], borders) if n else 0

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None):
        """Row numbers and exact scores of the best k candidates but the query's own id, of those that
        reach `floor`; better scores first, ties by smaller id."""
        n = len(self.ids)
        mine = np.flatnonzero(self.ids == own)
        others = n - len(mine)
        if not others:
            return np.zeros(0, np.int64), self.values[:0, 0] if self.width else np.zeros(0, self.values.dtype)
        pad = q[: self.width] if len(q) >= self.width else np.r_[q, np.zeros(self.width - len(q), q.dtype)]
        size = np.abs(pad)
        impact = size[:, None] * self.top
        most = impact.max(initial=0)
        scores = np.zeros(n, self.values.dtype)
        at = np.zeros(self.width, np.int64)  # postings done in each dimension
        each = np.arange(self.width)
        possible = None
        for step in STEPS:
            if not most:
                break
            # one segment's impact is no more than that of the one before it
            done = (impact >= most * step if step else impact > 0).sum(1)
            ends = self.first[each, done]
            for d in np.flatnonzero(ends > at).tolist():
                part = slice(at[d], ends[d])
                scores[self.rows[d][part]] += self.parts[d][part] * pad[d]  # each candidate once
            at = ends
            slack = impact[each, done].sum()  # either way, in all dimensions
            bar = floor
            if others >= k:
                told = np.delete(scores, mine) if len(mine) else scores
                proved = np.partition(told, others - k)[others - k] - slack
                bar = proved if bar is None else max(bar, proved)
            if bar is not None:
                possible = np.flatnonzero(scores + slack >= bar)
                if len(possible) * RESCORE <= n:
                    break
        if possible is None:
            possible = np.arange(n)
        if len(mine):
            possible = np.setdiff1d(possible, mine, assume_unique=True)
        exact = self.values[possible] @ pad
        if floor is not None:
            possible, exact = possible[exact >= floor], exact[exact >= floor]
        top = np.lexsort((self.ids[possible], -exact))[:k]
        return possible[top], exact[top]


def _matrix(column) -> np.ndarray:
    """Vectors as rows; shorter vectors end in zeros."""
    vectors = column.to_pylist()
    width = max(map(len, vectors), default=0)
    values = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(values, vectors, strict=True):
        row[: len(v)] = v
    return values


def build(rows: DataFrame) -> DataFrame:
    """The index of (vec_id, v): a stored table with a row for each block of candidates. Blocks
    are cut from the partitions as they are, so nothing is shuffled."""

    def blocks(batches):
        """The partition's rows, ROWS_PER_BLOCK at a time whatever the batches."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= ROWS_PER_BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks()
                yield whole.slice(0, ROWS_PER_BLOCK)
                held = whole.slice(ROWS_PER_BLOCK).to_batches()
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held)

    def run(batches):
        for part in blocks(batches):
            values, ids = _matrix(part.column(1)), part.column(0).to_numpy()
            name = f"{int(ids.min())}-{int(ids.max())}"
            columns = [[name], [len(ids)], [values.shape[1]], [ids.astype("<i8").tobytes()], [values.astype("<i8").tobytes()]]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "n", "width", "ids", "vectors"])

    return stored(rows.select("vec_id", "v").mapInArrow(run, INDEX), "topk-index")


def _scan(sent, kind, k: int):
    """Searches every index block of a task with the queries of a broadcast."""

    def run(batches):
        own, queries = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in own]  # score, id; best first
        for batch in batches:
            for n, width, ids, vectors in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                values = np.frombuffer(vectors, "<i8").reshape(n, width).astype(kind)
                block = Segments(np.frombuffer(ids, "<i8"), values)
                for i, (me, q) in enumerate(zip(own, queries, strict=True)):
                    floor = best[i][-1][0] if len(best[i]) == k else None
                    rows, scores = block.search(q.astype(kind), me, k, floor)
                    if len(rows):
                        more = zip(map(int, scores.tolist()), block.ids[rows].tolist(), strict=True)
                        best[i] = sorted([*best[i], *more], key=lambda x: (-x[0], x[1]))[:k]
        out = [(i, v, s) for i, found in enumerate(best) for s, v in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["q", "vec_id", "score"])

    return run


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """Per query (rows whose vec_id is divisible by `every`) its k best candidates: query_id,
    rank, vec_id, score.

    Null ids, null vectors and vectors with null or non-finite components take no part. Every
    other row is a candidate, repeated rows each, and no query finds a row with its own id. Rows of a
    query that repeat give its result once each. Equal scores go by the smaller vec_id. A shorter
    vector counts as ending in zeros. With fewer candidates than k all are returned; an empty
    table gives an empty result. A reported score that does not fit in 64 bits is an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    is_query = F.col("vec_id") % every == 0
    largest = F.array_max(F.transform("v", F.abs))
    first = rows.agg(F.max(largest).alias("most"), F.max(F.size("v")).alias("width")).first()
    most = max(abs(first["most"] or 0), 1)
    # doubles hold whole numbers below 2 ** 53; larger ones are Python's
    kind = np.float64 if 4 * most * most * max(first["width"] or 1, 1) < 2**53 else object
    index = build(rows)
    queries = rows.filter(is_query).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    queries = stored(queries.withColumn("part", F.xxhash64(F.lit("query"), "vec_id", F.col("v").cast("string"))), "topk-queries")
    blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK) * 2)  # about half full each
    found = shared_path(spark, "topk-found")
    for block in range(blocks if blocks > 2 else 1):
        part = queries if blocks == 2 else queries.filter(F.pmod("part", F.lit(blocks)) == block)
        table = part.select("vec_id", "v", "times").toArrow()  # of bounded size
        own, values = table["vec_id"].to_pylist(), _matrix(table["v"])
        sent = spark.sparkContext.broadcast((own, values))
        hits = index.mapInArrow(_scan(sent, kind, k), OUT)
        names = spark.createDataFrame([(i, o, t) for i, (o, t) in enumerate(zip(own, table["times"].to_pylist(), strict=True))], "n long, query_id long, times long")
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        hits = hits.join(F.broadcast(names), F.col("q") == F.col("n"))  # a row a query of the block
        hits = hits.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        hits.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(found)
        sent.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(found)
