"""Paged histories read by executors, and as a stream that resumes."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barsmith.sources import paged

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


class Minutes:
    """A made-up market: a bar a minute with gaps; how far it goes stands in a file, as time passes."""

    def __init__(self, clock: str, starts: dict[str, int]):
        self.clock, self.starts = clock, starts

    def symbols(self):
        return list(self.starts)

    def span(self, symbol):
        with open(self.clock) as f:
            now = json.load(f)
        first = self.starts[symbol]
        return (first, now // 60 * 60) if now >= first else None

    def page(self, symbol, since, until, limit):
        at = max(self.starts[symbol], -(-since // 60) * 60)
        out = []
        while at < until and len(out) < limit:
            if at % 4200:  # a gap
                out.append((at, 1.0, 2.0, 0.5, float(at % 97), 1.0))
            at += 60
        return out


def times(first, last):
    return {t for t in range(first, last + 1, 60) if t % 4200}


@pytest.fixture
def market(spark, tmp_path):
    clock = tmp_path / "clock"
    clock.write_text("600000")
    paged.register(spark, "minutes", Minutes(str(clock), {"A": 0, "B": 300_000, "C": 900_000}))
    return clock


def test_batches_are_read_in_parallel(spark, market):
    market.write_text(str(60 * 500_000))
    df = spark.read.format("minutes").option("partBars", 100_000).option("pageBars", 20_000).load()
    at = df.withColumn("p", F.spark_partition_id()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("parts"), F.countDistinct("time").alias("times"))
    got = {r["symbol"]: r for r in at.collect()}
    for s, first in (("A", 0), ("B", 300_000), ("C", 900_000)):
        assert got[s]["n"] == got[s]["times"] == len(times(first, 60 * 500_000)) and got[s]["parts"] >= 5
    assert sum(r["n"] for r in got.values()) > 1_400_000
    some = spark.read.format("minutes").option("symbols", "B").option("since", 310_000).option("until", 320_000).option("pageBars", 7).load()
    assert {r["time"] for r in some.collect()} == {t for t in times(300_000, 400_000) if 310_000 <= t < 320_000}
    assert spark.read.format("minutes").option("symbols", "C").option("until", 5).load().count() == 0


def test_streams_resume(spark, market, tmp_path):
    def drain():
        stream = spark.readStream.format("minutes").option("partBars", 1000).option("pageBars", 300).load()
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        out.trigger(once=True).start().awaitTermination()
        return [(r["symbol"], r["time"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    for now in (600_000, 720_123, 960_000):  # each is a new query over the same checkpoint
        market.write_text(str(now))
        got = drain()
        want = {(s, t) for s, first in (("A", 0), ("B", 300_000), ("C", 900_000)) for t in times(first, now)}
        assert len(got) == len(set(got)) and set(got) == want


def test_pages_that_fail_or_lie():
    class Feed(Minutes):
        def __init__(self, failures):
            super().__init__("", {"A": 0})
            self.failures = failures

        def page(self, *args):
            if self.failures:
                self.failures -= 1
                raise OSError("no answer")
            return super().page(*args)

    part = paged.Range("A", 60, 6000)
    assert len(list(paged.fetched(Feed(2), part, 10, 3))) == len(times(60, 5999))
    with pytest.raises(OSError):
        list(paged.fetched(Feed(3), part, 10, 3))

    class Lies(Minutes):
        def page(self, symbol, since, until, limit):
            return [(5, 1.0, 1.0, 1.0, 1.0, 1.0)] * limit

    with pytest.raises(ValueError):
        list(paged.fetched(Lies("", {"A": 0}), part, 10, 3))
    assert [(r.since, r.until) for r in paged.ranges("A", 5, 25, 10)] == [(5, 10), (10, 20), (20, 25)] and paged.ranges("A", 5, 5, 10) == []
