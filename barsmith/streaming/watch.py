"""Watched symbols as running state: forming bars, direction, history, polls and the age of cached bars.

One processor keeps, for each symbol, the bars that are still forming, the closes of the last bars, the
last direction and when each task is due. Nothing is decided when ticks come in: a timer at the end of a
bar fires once the watermark is there, and then the bar closes, the direction is taken and due tasks poll.
So the events follow from the ticks alone, however they are split into micro-batches. State is bounded: as
many forming bars as lateness allows, HISTORY closes and a number for each task.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .live import HISTORY, drained

EVENTS = "symbol string, time long, open double, high double, low double, close double, volume double, direction string, flipped boolean, history long, mean_close double, due long, fetched boolean"
_BAR = "first_us long, first_id long, open double, high double, low double, last_us long, last_id long, close double, volume double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(a: tuple, b: tuple) -> tuple:
    """Two parts of one bar as one; the order of ticks is (time, id)."""
    first, last = min(a, b, key=lambda x: x[:2]), max(a, b, key=lambda x: x[5:7])
    return (*first[:3], max(a[3], b[3]), min(a[4], b[4]), *last[5:8], a[8] + b[8])


class Watch(StatefulProcessor):
    """width: seconds of a bar; cadences: seconds between the polls of each task that reads the symbol;
    keep: seconds for which fetched bars serve again; low, high: closes up to and from which the
    direction is short and long."""

    def __init__(self, width: int, cadences: tuple[int, ...], keep: int, low: float = 45.0, high: float = 55.0):
        self.width, self.cadences, self.keep, self.low, self.high = width, cadences, keep, low, high

    def init(self, handle) -> None:
        self.handle = handle
        self.forming = handle.getMapState("forming", "start long", _BAR)
        self.past = handle.getListState("past", "close double")
        self.task = handle.getValueState("task", "direction string, due array<long>, fetched long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for frame in rows:
            frame = frame.sort_values(["us", "event_id"])
            for start, part in frame.groupby(frame["us"] // 1_000_000 // self.width * self.width):
                a, b, v = part.iloc[0], part.iloc[-1], part["value"]
                bar = (int(a.us), int(a.event_id), float(a.value), float(v.max()), float(v.min()), int(b.us), int(b.event_id), float(b.value), float(len(part)))
                at = (int(start),)
                if self.forming.containsKey(at):
                    bar = merged(tuple(self.forming.getValue(at)), bar)
                else:
                    self.handle.registerTimer((int(start) + self.width) * 1000)
                self.forming.updateValue(at, bar)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        at = (end - self.width,)
        bar = self.forming.getValue(at)
        self.forming.removeKey(at)
        close = bar[7]
        direction = "LONG" if close >= self.high else "SHORT" if close <= self.low else "FLAT"
        was, due, fetched = self.task.get() if self.task.exists() else (None, [end] * len(self.cadences), None)
        past = [x[0] for x in self.past.get()][-HISTORY + 1 :] + [close]
        self.past.put([(x,) for x in past])
        polled = [end >= d for d in due]
        due = [end + c if p else d for d, c, p in zip(due, self.cadences, polled, strict=True)]
        fresh = any(polled) and (fetched is None or end - fetched >= self.keep)
        self.task.update((direction, due, end if fresh else fetched))
        row = (key[0], at[0], bar[2], bar[3], bar[4], close, bar[8], direction, was is not None and was != direction, len(past), sum(past) / len(past), sum(polled), fresh)
        yield pd.DataFrame([row], columns=[c.split()[0] for c in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def watched(ticks: DataFrame, width: int, cadences: tuple[int, ...], keep: int, late: str = "0 seconds") -> DataFrame:
    """An event for each closed bar of each symbol. ticks: event_type, ts (an instant), event_id, value; ticks
    without a time, symbol or value tell nothing, and those later than `late` are dropped."""
    rows = ticks.filter(F.col("ts").isNotNull() & F.col("event_type").isNotNull() & F.col("value").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.col("event_type").alias("symbol"), "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("symbol").transformWithStateInPandas(Watch(width, cadences, keep), EVENTS, "append", "eventTime")


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Typed state needs this store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def events(spark: SparkSession, ticks: DataFrame, width: int, cadences: tuple[int, ...], keep: int) -> DataFrame:
    """All events that a stream of ticks has given so far."""
    with rocks(spark):
        return drained(spark, watched(ticks, width, cadences, keep), "watch")
