"""Market connectors: a source gives bars for (symbol, timeframe, n); closed bars only.

Network sources are not part of this library. `register` takes any callable that returns rows
of (time, open, high, low, close, volume); `read` turns what it gives into bars with the usual
repairs: milliseconds and nanoseconds to seconds, forming bars and empty volumes dropped. `Cache`
keeps bars as a table by symbol and timeframe, `download` fills it from a paged history and
goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import TIMEFRAMES, fresh

SOURCES: dict[str, Callable[[str, str, int], Iterable[tuple]]] = {}
ROW = "time long, open double, high double, low double, close double, volume double"


def register(kind: str, fetch: Callable[[str, str, int], Iterable[tuple]]) -> None:
    SOURCES[kind] = fetch


def seconds(time: Column) -> Column:
    """Unix seconds of seconds, milliseconds, microseconds or nanoseconds."""
    for power, least in ((9, 10**17), (6, 10**14), (3, 10**11)):
        time = F.when(F.abs(time) >= least, F.floor(time / 10**power)).otherwise(time)
    return time.cast("long")


def closed(bars: DataFrame, timeframe: str, now: Column, with_volume: bool = False) -> DataFrame:
    """Without the forming bar and bars from the future; on demand without bars that saw no trade."""
    out = bars.filter(F.col("time") + TIMEFRAMES[timeframe] <= now)
    return out.filter("volume > 0") if with_volume else out


def read(spark: SparkSession, kind: str, symbol: str, timeframe: str, n: int, now: Column) -> DataFrame:
    rows = spark.createDataFrame(list(SOURCES[kind](symbol, timeframe, n)), ROW)
    bars = rows.withColumn("time", seconds(F.col("time"))).withColumn("symbol", F.lit(symbol))
    last = bars.groupBy("time").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "symbol"), "volume").alias("b"))
    return closed(last.select("time", "b.*"), timeframe, now).orderBy(F.desc("time")).limit(n).orderBy("time")


def instrument_id(name: Column) -> Column:
    """An exchange's instrument id: upper case, with a dash before the quote currency."""
    bare = F.regexp_replace(F.upper(F.trim(name)), "[/_ ]", "-")
    return F.when(F.contains(bare, F.lit("-")), bare).otherwise(F.regexp_replace(bare, "(USDT|USDC|USD|BTC)$", "-$1"))


def market_of(code: Column) -> Column:
    """Exchange of a six-digit code by its first digits."""
    return F.when(F.rlike(code, F.lit("^[569]")), "SH").when(F.rlike(code, F.lit("^[0123]")), "SZ").when(F.rlike(code, F.lit("^[48]")), "BJ")


def server_offset(last_tick: Column, now: Column) -> Column:
    """Whole hours, in seconds, by which a server's clock is ahead."""
    return (F.floor((last_tick - now) / 3600 + 0.5) * 3600).cast("long")


def without_offset(bars: DataFrame, offset: Column | int) -> DataFrame:
    """Bars with a server's times taken back to UTC."""
    return bars.withColumn("time", (F.col("time") - offset).cast("long"))


def probed(candidates: Iterable[str], fetch: Callable[[str], list[tuple]], known: str | None = None) -> tuple[str, list[tuple]] | None:
    """The first exchange that gives bars, the one that did last time first; errors count as none."""
    for exchange in ([known] if known else []) + [c for c in candidates if c != known]:
        try:
            rows = fetch(exchange)
        except (OSError, ValueError, KeyError):
            continue
        if rows:
            return exchange, rows
    return None


def paged(page: Callable[[object], list[tuple]], limit: int = 100, most: int | None = None) -> Iterable[list[tuple]]:
    """Pages of a history, newest first: page(after) gives rows older than `after`. It ends with a
    short or empty page, with enough rows, or when a page does not get older twice."""
    after, rows, stuck = None, 0, 0
    while most is None or rows < most:
        batch = page(after)
        if not batch:
            return
        yield batch if most is None else batch[: most - rows]
        rows += len(batch)
        stuck = stuck + 1 if after is not None and batch[-1][0] == after else 0
        if len(batch) < limit or stuck >= 2:
            return
        after = batch[-1][0]


class Cache:
    """Bars kept at `folder` by symbol and timeframe, in batches that are only ever added."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, what: str, schema: str) -> DataFrame:
        """A table of the cache, empty before its first batch."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def bars(self, symbol: str, timeframe: str) -> DataFrame:
        """What is kept, without a source; of equal times the bar of the most volume."""
        kept = self._read("bars", f"{ROW}, symbol string, timeframe string")
        kept = kept.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
        best = kept.groupBy("time").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "volume").alias("b"))
        return best.select(F.lit(symbol).alias("symbol"), "time", "b.*")

    def add(self, rows: Iterable[tuple], symbol: str, timeframe: str) -> None:
        bars = self.spark.createDataFrame(list(rows), ROW).withColumn("time", seconds(F.col("time")))
        bars = bars.withColumns({"symbol": F.lit(symbol), "timeframe": F.lit(timeframe)})
        bars.write.mode("append").partitionBy("symbol", "timeframe").parquet(f"{self.folder}/bars")

    def get(self, kind: str | None, symbol: str, timeframe: str, n: int = 200, whole: int = 50_000) -> DataFrame:
        """The cache first: what a source has beyond the last kept bar is added, all of it if nothing
        is kept; without a source the cache alone."""
        kept = self.bars(symbol, timeframe)
        if kind is not None:
            first = kept.isEmpty()
            rows = list(SOURCES[kind](symbol, timeframe, whole if first else n))
            if rows and not first:
                given = self.spark.createDataFrame(rows, ROW).withColumn("time", seconds(F.col("time"))).withColumn("symbol", F.lit(symbol))
                rows = fresh(given, kept).select("time", "open", "high", "low", "close", "volume").collect()  # n at most
            if rows:
                self.add(rows, symbol, timeframe)
        return self.bars(symbol, timeframe)

    def listed(self) -> DataFrame:
        """Symbols and timeframes with their number of bars and last time."""
        kept = self._read("bars", f"{ROW}, symbol string, timeframe string")
        return kept.groupBy("symbol", "timeframe").agg(F.countDistinct("time").alias("bars"), F.max("time").alias("last_time"))

    def done(self) -> set[tuple[str, str]]:
        """The manifest: histories that were downloaded to their end."""
        return {(r["symbol"], r["timeframe"]) for r in self._read("manifest", "symbol string, timeframe string, pages int").collect()}

    def download(self, page: Callable[[object], list[tuple]], symbol: str, timeframe: str, limit: int = 100, most: int | None = None, pages_each: int = 50) -> bool:
        """A paged history, some pages to a batch so that the driver holds no more; False if the
        manifest has it already. Pages that a stopped download wrote do no harm: equal bars are one."""
        if (symbol, timeframe) in self.done():
            return False
        held: list[tuple] = []
        pages = 0
        for pages, batch in enumerate(paged(page, limit, most), 1):
            held += batch
            if pages % pages_each == 0:
                self.add(held, symbol, timeframe)
                held = []
        if held:
            self.add(held, symbol, timeframe)
        if pages:
            row = self.spark.createDataFrame([(symbol, timeframe, pages)], "symbol string, timeframe string, pages int")
            row.write.mode("append").parquet(f"{self.folder}/manifest")
        return pages > 0
