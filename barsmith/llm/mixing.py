"""Mixing sources to target weights by capped water-filling.

The targets come from one sorted pass over the sources: with caps c = epochs * size and
weights w, sources fill up in order of c / w, and the water level is the remaining words over
the remaining weight at the first source that does not fill up. That is the fixed point of
clamping and resharing. Documents are then taken in a seeded order: every document as often as
the whole part of target / size says, and once more from the front of the order until the
target is met; the document at the edge is taken in part. The order is split by hash prefix,
so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, stored, text_or_empty

MAX_EPOCHS = 3
SEED = "mix-1"
#: A plan of so many sources is broadcast, about 100 bytes each; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, text_col: str = "text") -> Column:
    """Words of a text: runs of other than white space."""
    text = text_or_empty(text_col)
    bare = F.btrim(text, F.lit(WS_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WS + "+", -1))).cast("long")


def summed_before(rows: DataFrame, order: list[Column], sums: tuple[str, ...], name: str) -> DataFrame:
    """rows with, for each column of `sums`, the sum over all rows that come before in the order, as
    b_ and the column's name. The rows are sorted by range, so each partition is a part of the order:
    each is summed up on its own and only a row a partition goes through one window."""
    placed = stored(rows.orderBy(*order).withColumn("w_part", F.spark_partition_id()), name)
    parts = placed.groupBy("w_part").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy("w_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("w_part").alias("p_part"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"p_{c}") for c in sums])
    own = Window.partitionBy("w_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = placed.join(F.broadcast(parts), F.col("w_part") == F.col("p_part"))  # a row a partition
    both = both.withColumns({f"b_{c}": F.col(f"p_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums})
    return both.drop("w_part", "p_part", *[f"p_{c}" for c in sums])


def water_filling(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources: (source, source_size long), each source once. Adds weight (1, 2, 3 repeating in
    code-point order, null last) and target double. However many sources there are, no task holds
    them all."""
    by_name = [F.col("source").asc_nulls_last()]
    s = summed_before(sources.withColumn("one", F.lit(1).cast("long")), by_name, ("one",), "mix-order")
    s = s.withColumn("weight", F.col("b_one") % 3 + 1).withColumn("cap", F.col("source_size") * max_epochs).drop("one", "b_one")
    s = summed_before(s, [(F.col("cap") / F.col("weight")).asc(), *by_name], ("cap", "weight"), "mix-fill")
    whole = s.agg(F.sum("source_size").alias("t_size"), F.sum("weight").alias("t_weight"))
    s = s.join(F.broadcast(whole)).withColumn("level", (F.col("t_size") - F.col("b_cap")) / (F.col("t_weight") - F.col("b_weight")))
    # the first source in the order of filling that does not fill up has the level; sources tied there share it
    level = s.filter(F.col("cap") >= F.col("level") * F.col("weight"))
    level = level.agg(F.min_by("level", F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")).alias("w_level"))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("w_level"))
    s = s.join(F.broadcast(level))  # one row
    return s.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


#: Documents of a source that one task puts in order, about.
EDGE_ROWS = 4096


def mix(
    docs: DataFrame,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    hash_digits: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document doc_id, source, size, source_size, target and taken (words, repeats counted) and,
    with `keep`, a struct `row` of the columns of docs named, whatever their names.

    A null text has size 0; a null source is a source of its own, the last; repeated rows
    are documents each; equal ids are told apart by size; null ids by a hash of the text; an empty
    table gives an empty result. taken never exceeds max_epochs * size, and the taken words of a
    source are its target rounded down. hash_digits hexadecimal digits of the document's seeded hash
    split each source into groups; only the group at the edge is ordered. Without it there are so
    many that a group has about EDGE_ROWS documents at most. The result does not depend on them.
    """
    row = [F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row")] if keep else []
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text_or_empty())))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        sized(docs).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), name)).alias("h"),
        *row,
    )
    rows = stored(rows, "mix-sizes")
    if hash_digits is None:
        most = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        hash_digits = 1
        while hash_digits < 32 and most > EDGE_ROWS * 16**hash_digits:
            hash_digits += 1
    rows = rows.withColumn("b", F.substring("h", 1, hash_digits))
    groups = stored(rows.groupBy("source", "b").agg(F.sum("size").alias("b_size")), "mix-groups")
    plan = water_filling(groups.groupBy("source").agg(F.sum("b_size").alias("source_size")), max_epochs)
    words = F.floor("target")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0))
    plan = stored(plan.withColumn("extra", words - F.col("whole") * F.col("source_size")), "mix-plan")
    small = plan.count() <= BROADCAST_SOURCES
    with_plan = F.broadcast(plan) if small else plan
    at = Window.partitionBy("g_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    g = groups.withColumnRenamed("source", "g_source").withColumn("b_before", F.coalesce(F.sum("b_size").over(at), F.lit(0)))
    edge = g.join(with_plan, F.col("g_source").eqNullSafe(F.col("source")))
    edge = edge.filter((F.col("b_before") < F.col("extra")) & (F.col("b_before") + F.col("b_size") > F.col("extra")))
    edge = edge.select(F.col("g_source").alias("e_source"), F.col("b").alias("e_b"), F.col("b_before").alias("e_before"))
    # one edge at most for each source, so the bound of the plan holds for the edges too
    plan = plan.join(edge, plan["source"].eqNullSafe(F.col("e_source")), "left")
    # all groups below the edge are taken once more, all above are not; without an edge group
    # the extra words end at a group's border, which the same comparison of sums decides
    border = g.join(with_plan, F.col("g_source").eqNullSafe(F.col("source"))).filter(
        F.col("b_before") + F.col("b_size") <= F.col("extra")
    )
    border = border.groupBy(F.col("g_source").alias("l_source")).agg(F.max("b").alias("last_b"))
    plan = plan.join(border, plan["source"].eqNullSafe(F.col("l_source")), "left")
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", "extra", "e_b", "e_before", "last_b")
    plan = stored(plan, "mix-edges")
    df = rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("p_source")))
    inside = df.filter(F.col("b") == F.col("e_b"))
    order = Window.partitionBy("source", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("e_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("before")))
    inside = inside.withColumn("more", part).drop("before")
    outside = df.filter(~F.col("b").eqNullSafe(F.col("e_b")))
    outside = outside.withColumn("more", F.when(F.col("b") <= F.col("last_b"), F.col("size")).otherwise(F.lit(0)))
    out = outside.unionByName(inside)
    taken = F.col("whole") * F.col("size") + F.col("more")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if keep else []))


def report(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
