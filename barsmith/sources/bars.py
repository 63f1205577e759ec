"""Bar panels: scans, bucketing, deduplication, alignment and the bar index.

A bar is (symbol, time in Unix seconds UTC, open, high, low, close, volume). Buckets are cut
from zone-less timestamps by date arithmetic, so the session's time zone never moves a bar.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COLUMNS = ("symbol", "time", "open", "high", "low", "close", "volume")
MIN_BARS = 300
#: The nine timeframes with their seconds, and how file names call them.
TIMEFRAMES = {
    "M1": 60, "M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400, "W1": 604800, "MN1": 2592000,
}
ALIASES = {
    "M1": "m1 1m 1min min1".split(),
    "M5": "m5 5m 5min min5".split(),
    "M15": "m15 15m 15min min15".split(),
    "M30": "m30 30m 30min min30".split(),
    "H1": "h1 1h 60m 60min min60 60".split(),
    "H4": "h4 4h 240m 240min min240 240".split(),
    "D1": "d1 1d day daily 1440m 1440min".split(),
    "W1": "w1 1w week weekly".split(),
    "MN1": "mn1 1mo 1mon month monthly".split(),
}


def day_seconds(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400


def hour_seconds(ts: Column) -> Column:
    return day_seconds(ts) + F.hour(ts) * 3600


def second_of(ts: Column) -> Column:
    return hour_seconds(ts) + F.minute(ts) * 60 + F.floor(F.second(ts))


def week_seconds(ts: Column) -> Column:
    """Monday of the week; 1970-01-01 was a Thursday."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (F.floor((day + 3) / 7) * 7 - 3).cast("long") * 86400


def bucketed(df: DataFrame, symbol: str, time: Column, price: Column, volume: Column, order: list[str]) -> DataFrame:
    """Bars from ticks in one partial-and-final aggregation; `order` breaks ties for open and close."""
    rows = df.select(F.col(symbol).alias("symbol"), time.alias("time"), price.alias("p"), volume.alias("v"), F.struct(*order).alias("k"))
    return rows.groupBy("symbol", "time").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("v").cast("double").alias("volume"),
    )


def deduplicated(bars: DataFrame, keep: str = "last", order: str = "ingest") -> DataFrame:
    """One bar for each (symbol, time): the first or last by `order`, or the one of most volume."""
    by = {"first": [F.col(order)], "last": [F.col(order).desc()], "max_volume": [F.col("volume").desc(), F.col(order)]}[keep]
    n = F.row_number().over(W.partitionBy("symbol", "time").orderBy(*by))
    return bars.withColumn("_n", n).filter("_n = 1").drop("_n")


def enough(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    """Symbols with at least so many bars."""
    counts = bars.groupBy("symbol").count().filter(F.col("count") >= least).select("symbol")
    return bars.join(counts, "symbol", "left_semi")


def permitted(bars: DataFrame, allow: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Bars of the symbols that are allowed (all, if none is named) and not excluded."""
    allow, exclude = list(allow), list(exclude)
    if allow:
        bars = bars.filter(F.col("symbol").isin(allow))
    return bars.filter(~F.col("symbol").isin(exclude)) if exclude else bars


#: Costs of a change of position, for each class of symbols.
COSTS = {"forex": 0.00015, "metals": 0.00020, "index": 0.00030}


def class_of(symbol: Column) -> Column:
    """The class that a symbol's name tells."""
    metal = F.rlike(symbol, F.lit("^XA[UG]"))
    index = F.contains(symbol, F.lit(".cash")) | F.rlike(symbol, F.lit("^(US|JP)"))
    return F.when(metal, "metals").when(index, "index").otherwise("forex")


def with_costs(bars: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Adds the market's name of each symbol (its own, if the map has none), its class and its cost."""
    market = F.col("symbol")
    if names:
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        market = F.coalesce(F.try_element_at(known, F.col("symbol")), market)
    bars = bars.withColumn("market", market).withColumn("class", class_of(F.col("market")))
    return bars.withColumn("cost", F.try_element_at(F.create_map(*[F.lit(x) for pair in COSTS.items() for x in pair]), F.col("class")))


def fresh(bars: DataFrame, seen: DataFrame) -> DataFrame:
    """Bars that are later than the last one seen of their symbol; seen: (symbol, time), any number of rows."""
    last = seen.groupBy(F.col("symbol").alias("_s")).agg(F.max("time").alias("_last"))
    late = bars.join(last, F.col("symbol") == F.col("_s"), "left").filter(F.col("_last").isNull() | (F.col("time") > F.col("_last")))
    return late.select(*bars.columns)


def indexed(bars: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("symbol").orderBy("time")) - 1
    return bars.select("symbol", place.cast("long").alias("bar_idx"), *COLUMNS[1:])


def common_times(bars: DataFrame) -> DataFrame:
    """Times at which every symbol has a bar: a count, not a join for each symbol."""
    n = bars.agg(F.countDistinct("symbol").alias("n_symbols"))
    times = bars.groupBy("time").agg(F.count(F.lit(1)).alias("n"))
    return times.join(F.broadcast(n), F.col("n") == F.col("n_symbols")).select("time")  # one row


def aligned(bars: DataFrame) -> DataFrame:
    """Bars at common times, with their index."""
    return indexed(bars.join(common_times(bars), "time", "left_semi"))


def filled(bars: DataFrame, groups: int = 16) -> DataFrame:
    """Bars at all times of any symbol: the last known values, zeros before the first bar. Times and
    symbols meet in groups of symbols, so neither side is sent to every task."""
    group = F.pmod(F.xxhash64("symbol"), F.lit(groups)).alias("_g")
    symbols = bars.select("symbol").distinct().select("symbol", group)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    times = bars.select("time").distinct().select("time", each.alias("_g"))
    rows = times.join(symbols, "_g").select("symbol", "time").join(bars, ["symbol", "time"], "left")
    so_far = W.partitionBy("symbol").orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    values = [F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0.0)).alias(c) for c in COLUMNS[2:]]
    return indexed(rows.select("symbol", "time", *values))


def aligned_or_filled(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    """Common times if there are enough of them, else all times with the last values."""
    return aligned(bars) if common_times(bars).count() >= least else filled(bars)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Bars from Parquet files named {symbol}_{timeframe}.parquet: the volume's two names, times
    in thousands of seconds repaired, the last of equal times kept. A file whose name says no symbol
    or timeframe is an error, as its bars would mix with those of other files."""
    df = spark.read.parquet(path)
    volume = next(c for c in ("tick_volume", "volume") if c in df.columns)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    named = lambda c: F.coalesce(c, F.raise_error(F.concat(F.lit("no symbol and timeframe in the file name "), name)).cast("string"))
    df = df.select(
        named(parsed_symbol(name)).alias("symbol"),
        named(parsed_timeframe(name)).alias("timeframe"),
        F.col("time").cast("long").alias("time"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col(volume).cast("double").alias("volume"),
        F.monotonically_increasing_id().alias("ingest"),
    )
    top = F.max("time").over(W.partitionBy("symbol", "timeframe"))
    df = df.withColumn("time", F.when(top < 10_000_000, F.col("time") * 1000).otherwise(F.col("time")))
    n = F.row_number().over(W.partitionBy("symbol", "timeframe", "time").orderBy(F.desc("ingest")))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n", "ingest")


_STEM = r"^(.+)_([^_]+?)(?:\.parquet)?$"


def parsed_symbol(name: Column) -> Column:
    """What stands before the last underscore of a file name with a known timeframe."""
    symbol = F.trim(F.regexp_extract(name, _STEM, 1))
    return F.when(parsed_timeframe(name).isNotNull() & (symbol != ""), symbol)


def parsed_timeframe(name: Column) -> Column:
    alias = F.lower(F.replace(F.trim(F.regexp_extract(name, _STEM, 2)), F.lit("-"), F.lit("")))
    known = [F.when(alias.isin(a), F.lit(t)) for t, a in ALIASES.items()]
    return F.coalesce(*known)


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Incremental cache: only bars later than a symbol's last are added; old ones win ties."""
    return old.unionByName(fresh(new.select(*old.columns), old))


def continuous(contracts: DataFrame, symbol: str) -> DataFrame:
    """One series of several contracts: the most traded bar at each time."""
    best = F.row_number().over(W.partitionBy("time").orderBy(F.desc("volume"), "symbol"))
    return contracts.withColumn("_n", best).filter("_n = 1").drop("_n").withColumn("symbol", F.lit(symbol))


# Panels over the star schema's tables.

LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_days(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """Unaligned daily bars of each return flag."""
    df = _table(spark, sf_dir, "lineitem")
    df = df.filter(F.col("l_returnflag") == only) if only else df
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bucketed(df, "l_returnflag", day_seconds(F.col("l_shipdate")), price, F.col("l_quantity"), LI_ORDER)


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return bucketed(df, "event_type", hour_seconds(F.col("ts")), F.col("value"), F.lit(1), ["ts", "event_id"])


def order_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    return bucketed(df, "o_orderpriority", week_seconds(F.col("o_orderdate")), F.col("o_totalprice"), F.lit(1), ["o_orderdate", "o_orderkey"])


def day_panel(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    return aligned(lineitem_days(spark, sf_dir, only))


def supplier_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a supplier as a bar: many symbols, for measuring."""
    df = _table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_shipdate", *LI_ORDER)) - 1
    symbol = F.col("l_suppkey").cast("string").alias("symbol")
    values = [price.alias(c) for c in ("open", "high", "low", "close")]
    return df.select(symbol, place.cast("long").alias("bar_idx"), day_seconds(F.col("l_shipdate")).alias("time"), *values, F.col("l_quantity").alias("volume"))
