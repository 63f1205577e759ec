"""Sets of bar times as bits: overlaps, missing times and aligned groups without a row for each common time.

A symbol's times are cut into blocks of 4,096 slots of `step` seconds, and a block is 64 words of 64 bits.
Times off the grid have another phase and a block of their own, so any times are represented exactly. An
intersection is a conjunction of words and its size a count of bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 64
SLOTS = 64 * WORDS


def packed(bars: DataFrame, step: int) -> DataFrame:
    """(symbol, phase, block, words) of the times of each symbol; repeated bars count once."""
    slot = F.floor(F.col("time") / step)
    rows = bars.filter(F.col("symbol").isNotNull() & F.col("time").isNotNull())
    rows = rows.select("symbol", (F.col("time") - slot * step).alias("phase"), F.floor(slot / SLOTS).alias("block"), F.pmod(slot, F.lit(SLOTS)).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    word = F.floor(F.col("place") / 64)
    words = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(WORDS)]
    return rows.groupBy("symbol", "phase", "block").agg(F.array(*words).alias("words"))


def common(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def together(sets: DataFrame) -> DataFrame:
    """(phase, block, m): the symbols of a block with their words, in order; one of each symbol at most."""
    return sets.groupBy("phase", "block").agg(F.sort_array(F.collect_list(F.struct("symbol", "words"))).alias("m"))


def overlaps(sets: DataFrame) -> DataFrame:
    """(one, two, common_times) of every two symbols with a common time. Pairs meet block by block, as many
    numbers as pairs, and not time by time."""

    def partners(a: Column, i: Column) -> Column:
        later = F.slice("m", i + 2, F.size("m"))
        return F.transform(later, lambda b: F.struct(a["symbol"].alias("one"), b["symbol"].alias("two"), common(a["words"], b["words"]).alias("n")))

    pairs = together(sets).select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.*").filter("n > 0")
    return pairs.groupBy("one", "two").agg(F.sum("n").cast("long").alias("common_times"))


def times(sets: DataFrame, step: int) -> DataFrame:
    """sets as rows again: (symbol, time)."""
    rows = sets.select("symbol", "phase", "block", F.posexplode("words").alias("k", "w")).filter("w <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("w"), i).bitwiseAND(F.lit(1)) == 1)
    rows = rows.select("symbol", "phase", "block", "k", F.explode(bits).alias("i"))
    slot = F.col("block") * SLOTS + F.col("k") * 64 + F.col("i")
    return rows.select("symbol", (slot * step + F.col("phase")).cast("long").alias("time"))


def missing(sets: DataFrame, step: int) -> DataFrame:
    """(symbol, time) of the times that some symbol has and this one has not."""
    every = sets.agg(F.collect_set("symbol").alias("every"))  # one row: the names of all symbols
    zero = F.array_repeat(F.lit(0).cast("long"), WORDS)
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))
    whole = together(sets).withColumn("whole", F.aggregate("m", zero, lambda s, x: both(s, x["words"])))
    left = lambda x: F.zip_with("whole", x["words"], lambda w, v: w.bitwiseAND(F.bitwise_not(v)))
    short = F.transform("m", lambda x: F.struct(x["symbol"].alias("symbol"), left(x).alias("words")))
    absent = F.array_except("every", F.transform("m", lambda x: x["symbol"]))
    absent = F.transform(absent, lambda s: F.struct(s.alias("symbol"), F.col("whole").alias("words")))
    rows = whole.join(F.broadcast(every)).select("phase", "block", F.explode(F.concat(short, absent)).alias("s"))
    return times(rows.select("s.symbol", "phase", "block", "s.words"), step)


def aligned_group(sets: DataFrame, core: list[str], least: int) -> DataFrame:
    """(symbol, common_times) of the symbols that share `least` times or more with all of `core`."""
    meets = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))
    inside = [F.first(F.when(F.col("symbol") == c, F.col("words")), ignorenulls=True) for c in core]
    kernel = sets.filter(F.col("symbol").isin(core)).groupBy(F.col("phase").alias("c_phase"), F.col("block").alias("c_block"))
    kernel = kernel.agg(reduce(meets, inside).alias("kernel")).filter("kernel IS NOT NULL")
    both = sets.join(kernel, (F.col("phase") == F.col("c_phase")) & (F.col("block") == F.col("c_block")))
    counts = both.groupBy("symbol").agg(F.sum(common(F.col("words"), F.col("kernel"))).cast("long").alias("common_times"))
    return counts.filter(F.col("common_times") >= least)
