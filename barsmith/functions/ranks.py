"""Exact ranks and quantiles of groups of any size.

Rows are sorted by range of (group, value), so a large group is spread over many tasks and equal values
stay together. Each range is ranked on its own; how many rows of a group earlier ranges hold, a row for
each range and group, is added. No aggregate ever holds the values of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.sources.storage import stored

PART, BEFORE, COUNT = "rank_part", "rank_before", "rank_count"


def ranged(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """df sorted by range, with the range (rank_part), the rows of the group in earlier ranges
    (rank_before) and in all (rank_count). Null values come first."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *group, value).withColumn(PART, F.spark_partition_id())
    dealt = stored(dealt, "ranks")
    counts = dealt.groupBy(*group, PART).agg(F.count(F.lit(1)).alias("rank_own"))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rank_own").over(earlier), F.lit(0)).alias(BEFORE)
    counts = counts.select(*group, PART, before, F.sum("rank_own").over(Window.partitionBy(*group)).alias(COUNT))
    return dealt.join(counts, [*group, PART])


def ranked(df: DataFrame, group: list[str], value: str, rank: str) -> DataFrame:
    """df with the rank of value in its group from 1; equal values share the mean of their ranks."""
    columns = df.columns
    here = Window.partitionBy(*group, PART).orderBy(value)
    ties = Window.partitionBy(*group, PART, value)
    mean = F.col(BEFORE) + F.rank().over(here) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return ranged(df, group, value).select(*columns, mean.alias(rank))


def quantiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """A row for each group with the quantiles named, interpolated linearly between neighbours."""
    here = Window.partitionBy(*group, PART).orderBy(value)
    rows = ranged(df.filter(F.col(value).isNotNull()), group, value)
    rows = rows.withColumn("rank_place", F.col(BEFORE) + F.row_number().over(here) - 1)
    spot = lambda q: F.lit(float(q)) * (F.col(COUNT) - 1)
    low = {n: F.floor(spot(q)) for n, q in at.items()}
    near = [F.col("rank_place").between(k, k + 1) for k in low.values()]
    hit = near[0]
    for other in near[1:]:
        hit = hit | other
    rows = rows.filter(hit)  # two rows a quantile at most
    ends = [F.max(F.when(F.col("rank_place") == low[n] + k, F.col(value))).alias(f"{n}_{k}") for n in at for k in (0, 1)]
    found = rows.groupBy(*group).agg(F.first(COUNT).alias(COUNT), *ends)
    # equal neighbours give their own value to the last digit
    between = lambda n, q: F.col(f"{n}_0") + (spot(q) - low[n]) * (F.coalesce(f"{n}_1", f"{n}_0") - F.col(f"{n}_0"))
    return found.select(*group, *[between(n, q).alias(n) for n, q in at.items()])
