"""Paged histories as a Spark data source: executors fetch the pages, batch or streaming.

A feed knows its symbols, how far a symbol's history goes, and how to fetch one page of it. The source
cuts each symbol's time into ranges, one partition each, so any number of bars is read in parallel and no
row passes the driver; a lost task fetches its range again. As a stream, an offset is a time for each
symbol and a batch the bars between two of them, so a query that was cut off goes on from its checkpoint
and sees each bar once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ROW = "symbol string, time long, open double, high double, low double, close double, volume double"
#: Bars that one partition fetches, about, and bars of a page.
PART_BARS, PAGE_BARS = 50_000, 1000


class Feed(Protocol):
    """What a market has to offer. Objects are pickled to the executors, so they hold settings only."""

    def symbols(self) -> list[str]: ...

    def span(self, symbol: str) -> tuple[int, int] | None:
        """The times of the first and the last closed bar, or None if there is none."""

    def page(self, symbol: str, since: int, until: int, limit: int) -> list[tuple]:
        """The first `limit` bars (time, open, high, low, close, volume) with since <= time < until, by time."""


class Range(InputPartition):
    def __init__(self, symbol: str, since: int, until: int):
        super().__init__((symbol, since, until))
        self.symbol, self.since, self.until = symbol, since, until


def ranges(symbol: str, since: int, until: int, seconds: int) -> list[Range]:
    """[since, until) cut at multiples of `seconds`, so that a range is the same in every plan."""
    cuts = [since, *range((since // seconds + 1) * seconds, until, seconds), until]
    return [Range(symbol, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def fetched(feed: Feed, part: Range, limit: int, tries: int) -> Iterator[tuple]:
    """All bars of a range, a page in memory at a time. A page that fails is asked for again; one that
    brings nothing new ends the range, and bars outside of it or out of order are an error."""
    since = part.since
    while since < part.until:
        for left in reversed(range(tries)):
            try:
                page = feed.page(part.symbol, since, part.until, limit)
                break
            except OSError:
                if not left:
                    raise
        for row in page:
            if not since <= row[0] < part.until:
                raise ValueError(f"{part.symbol}: a bar at {row[0]} in the page of {since} to {part.until}")
            since = row[0] + 1
            yield (part.symbol, int(row[0]), *map(float, row[1:]))
        if len(page) < limit:
            return


class _Batch(DataSourceReader):
    def __init__(self, feed: Feed, options: dict):
        self.feed, self.options = feed, options

    def partitions(self) -> list[InputPartition]:
        out = []
        wanted = self.options["symbols"]
        for symbol in wanted.split(",") if wanted else self.feed.symbols():
            if span := self.feed.span(symbol):
                since, until = max(span[0], self.options["since"]), min(span[1] + 1, self.options["until"])
                out += ranges(symbol, since, until, self.options["bar"] * self.options["partBars"])
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return fetched(self.feed, partition, self.options["pageBars"], self.options["tries"])


class _Stream(DataSourceStreamReader):
    """Offsets: the end (exclusive) of what was read of each symbol."""

    def __init__(self, feed: Feed, options: dict):
        self.feed, self.options = feed, options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for symbol in self.feed.symbols():
            if span := self.feed.span(symbol):
                out[symbol] = span[1] + 1
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for symbol, until in sorted(end.items()):
            span = self.feed.span(symbol)
            since = start.get(symbol, span[0] if span else until)
            out += ranges(symbol, since, until, self.options["bar"] * self.options["partBars"])
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return fetched(self.feed, partition, self.options["pageBars"], self.options["tries"])

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, kind: str, feed: Feed) -> None:
    """Makes a feed readable as spark.read.format(kind) and spark.readStream.format(kind). Options: symbols
    (comma-joined, all without it), since and until (seconds), bar (seconds between bars, a hint for the
    size of partitions), partBars, pageBars and tries."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return ROW

        def _settings(self) -> dict:
            got = {k.lower(): v for k, v in self.options.items()}
            whole = {"since": -(2**62), "until": 2**62, "bar": 60, "partBars": PART_BARS, "pageBars": PAGE_BARS, "tries": 3}
            return {"symbols": got.get("symbols", ""), **{k: int(got.get(k.lower(), v)) for k, v in whole.items()}}

        def reader(self, schema) -> DataSourceReader:
            return _Batch(feed, self._settings())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(feed, self._settings())

    spark.dataSource.register(Paged)
