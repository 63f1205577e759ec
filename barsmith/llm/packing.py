"""Best-fit packing by a configuration linear program.

Documents become token ids and an end id; longer ones than a sequence are cut. What decides is
the histogram of piece lengths, at most `capacity` numbers whatever the input. On the driver a
configuration linear program over it is solved by multiplicative weights: lengths have prices, a
knapsack dynamic program finds for each length the most valuable filling of a sequence that holds
it, and the prices of lengths that these fillings cover too often fall. Prices also bound the program
from below: no packing has fewer sequences than their value over that of the best filling.

The program is rounded in passes: a pass prices the pieces that are left, and of each length's best
filling, dearest lengths first, as many whole sequences are closed as half of its scarcest length
allows, if little of a sequence stays empty; the prices of lengths that fall behind rise. Late passes
close fillings that lack a piece with the longest pieces that fit, and accept a little more empty
room. What is left is placed best fit, longest first; if best fit alone were better, it is
taken. The plan says, for each length, which ranks go to which sequences and offsets.

Pieces get their rank within their length from a two-level count (length and hash bucket), so
a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, sliced, stored

CAPACITY = 2048
END = 0
#: Rounds of the program and passes of its rounding, of which the first EXACT take fillings as they are.
ROUNDS, PASSES, EXACT = 40, 80, 8
#: The part of a sequence that the last pass lets stay empty.
EMPTY = 0.05
#: Fixed value: the split pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
#: The rank-based encoder's split pattern needs a stack as deep as a run of white space is long;
#: texts with longer runs go to the file's tokenizer.
LONG_SPACE = 100_000
PIECES = "piece int, start long, length long, ids_crc32 long"

_encoders: dict = {}


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand
    for themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def encoder(vocabulary: str):
    """Text to ids. If the vocabulary file's merges are in id order, which is checked, its ids are
    merge ranks and a rank-based encoder gives the file's own ids, several times faster; texts with
    the special token's string, which the file's tokenizer reads as that token, or with a very long
    run of white space go to that tokenizer, and so does every text if the order is another."""
    long_space = re.compile(rf"\s{{{LONG_SPACE}}}").search
    if vocabulary not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        words, letters = model["vocab"], byte_of()
        merged = [words["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        in_order = all(x < y for x, y in zip(merged, merged[1:], strict=False))
        ranks = {bytes(letters[c] for c in w): i for w, i in words.items() if w != SPECIAL}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # loaded by the first text that needs it, for workers keep what they load
        whole = functools.cache(lambda: Tokenizer.from_file(path))

        def encode(text: str) -> list[int]:
            if not in_order or SPECIAL in text or len(text) >= LONG_SPACE and long_space(text):
                return whole().encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens; the first one may be shorter."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    def run(batches):
        encode = encoder(vocabulary)
        for batch in sliced(batches):
            ids, cols = [], ([], [], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.array([*encode(text or ""), END], "<u4").tobytes()
                start = 0
                for i, n in enumerate(cut(len(tokens) // 4, capacity)):
                    ids.append(row)
                    crc = zlib.crc32(tokens[4 * start : 4 * (start + n)])
                    for col, x in zip(cols, (i, start, n, crc), strict=True):
                        col.append(x)
                    start += n
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *arrays], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")


class Knapsack:
    """The most valuable filling of every room up to a capacity, by dynamic programming; lengths
    ascending, as often as they fit."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, capacity: int):
        self.lengths = lengths
        self.best, self.last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        reach = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
        for c in range(int(lengths[0]), capacity + 1):
            value = self.best[c - lengths[: reach[c]]] + prices[: reach[c]]
            i = int(value.argmax())
            if value[i] > self.best[c - 1]:
                self.best[c], self.last[c] = value[i], i
            else:
                self.best[c] = self.best[c - 1]

    def filling(self, first: int) -> dict[int, int]:
        """The best filling that holds a piece of length `first`."""
        out, c = {first: 1}, len(self.best) - 1 - first
        while c > 0:
            if self.last[c] < 0:
                c -= 1
            else:
                n = int(self.lengths[self.last[c]])
                out[n] = out.get(n, 0) + 1
                c -= n
        return out


def relaxed(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The best lower bound on the sequences that the configuration program gave, and its prices."""
    at = {int(n): i for i, n in enumerate(lengths)}
    bound, found, weights = 0.0, lengths / capacity, np.zeros(len(lengths))
    for r in range(rounds):
        prices = lengths / capacity * np.exp(weights)
        knapsack = Knapsack(lengths, prices, capacity)
        value = float(need @ prices) / knapsack.best[capacity]
        if value > bound:
            bound, found = value, prices
        covered = np.zeros(len(lengths))
        for i, n in enumerate(lengths.tolist()):
            filling = knapsack.filling(n)
            for m, k in filling.items():
                covered[at[m]] += k * need[i] / filling[n]
        ratio = covered / need * (lengths @ need) / (lengths @ covered)
        weights -= 0.025 / np.sqrt(r + 1) * np.log(np.maximum(ratio, 1e-3))
    return bound, found


def rounded(lengths: np.ndarray, need: np.ndarray, prices: np.ndarray, capacity: int, passes: int = PASSES) -> tuple[list, dict[int, int]]:
    """Whole uses of configurations, and the histogram of what they leave."""
    at = {int(n): i for i, n in enumerate(lengths)}
    left, weights, out = need.astype(np.int64), np.log(prices * capacity / lengths), []
    for r in range(passes):
        live = np.flatnonzero(left)
        if not len(live):
            break
        knapsack = Knapsack(lengths[live], lengths[live] / capacity * np.exp(weights[live]), capacity)
        empty = EMPTY * capacity * (r / passes) ** 2
        for i in live[np.argsort(-weights[live] - 1e-9 * lengths[live], kind="stable")].tolist():
            if not left[i]:
                continue
            filling = {m: min(k, int(left[at[m]])) for m, k in knapsack.filling(int(lengths[i])).items() if left[at[m]]}
            room = capacity - sum(m * k for m, k in filling.items())
            j = int(np.searchsorted(lengths, room, "right")) - 1 if room > empty and r >= EXACT else -1
            while j >= 0 and room:
                n = int(lengths[j])
                k = min(room // n, int(left[j]) - filling.get(n, 0))
                if k > 0:
                    filling[n] = filling.get(n, 0) + k
                    room -= k * n
                j = min(j, int(np.searchsorted(lengths, room, "right"))) - 1
            if room > empty:
                continue
            times = min(int(left[at[m]]) // k for m, k in filling.items())
            times = max(1, times // 2) if 2 * r < passes else times
            for m, k in filling.items():
                left[at[m]] -= k * times
            out.append((filling, times))
        behind = left / need
        weights = weights + 0.02 * (behind - behind.mean())
    return out, {int(n): int(c) for n, c in zip(lengths, left, strict=True) if c}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, with groups of equal sequences in place of single ones."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        for room in sorted(r for r in open_ if r >= n):
            r = room
            # the fullest sequences first; each takes as many pieces of this length as fit
            while left and open_.get(r):
                config, count = open_[r].pop()
                k = min(r // n, left)
                whole = min(count, left // k)
                if whole < count:
                    open_[r].append((config, count - whole))
                open_.setdefault(r - k * n, []).append((config + ((n, k),), whole))
                left -= whole * k
            if not left:
                break
        if left:
            k = capacity // n
            if left // k:
                open_.setdefault(capacity - k * n, []).append((((n, k),), left // k))
            if left % k:
                open_.setdefault(capacity - (left % k) * n, []).append((((n, left % k),), 1))
    out = []
    for groups in open_.values():
        for config, count in groups:
            total: dict[int, int] = {}
            for n, k in config:
                total[n] = total.get(n, 0) + k
            out.append((total, count))
    return out


def bound(histogram: dict[int, int], capacity: int = CAPACITY) -> float:
    """A number of sequences that no packing can do without."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0 and n < capacity), np.int64)
    need = np.array([histogram[int(n)] for n in lengths], float)
    return histogram.get(capacity, 0) + (relaxed(lengths, need, capacity)[0] if len(lengths) else 0.0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations with whole uses that cover the histogram exactly."""
    whole = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    parts = {n: c for n, c in histogram.items() if c > 0 and n < capacity}
    if not parts:
        return whole
    lengths = np.array(sorted(parts), np.int64)
    need = np.array([parts[int(n)] for n in lengths], float)
    closed, left = rounded(lengths, need, relaxed(lengths, need, capacity)[1], capacity)
    planned, plain = closed + best_fit(left, capacity), best_fit(parts, capacity)
    return whole + min(planned, plain, key=lambda configs: sum(times for _, times in configs))


def layout(configs: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces in a sequence, first sequence, first offset)."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for config, times in configs:
        offset = 0
        for n in sorted(config, reverse=True):
            k = config[n]
            first = ranks.get(n, 0)
            rows.setdefault(n, []).append((first, k, sequence, offset))
            ranks[n] = first + k * times
            offset += k * n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null text is empty and packs as its end id alone. Rows with equal or null ids are packed
    each; pieces of one length are interchangeable, and ties among them go by a hash, the id and the
    place; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, vocabulary, capacity), "packing-pieces")
    buckets = 4 * partitions(spark)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = stored(rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    # at most `capacity` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = layout(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("length").alias("c_length"), F.col("bucket").alias("c_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("own", F.row_number().over(own) - 1)
    rows = rows.join(first, (F.col("length") == F.col("c_length")) & (F.col("bucket") == F.col("c_bucket")))
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("first")).alias("rank"))

    def place(batches):
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                table = where[int(length)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                j = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + j // row[:, 1]
                offset[at] = row[:, 3] + (j % row[:, 1]) * length
            columns = [batch.column(i) for i in range(5)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(place, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")
