"""File names, cached and paged histories, server clocks, polls and reconciliation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barsmith.functions import times
from barsmith.plans import risk
from barsmith.sources import bars, connectors

#: All names of timeframes that file names use.
NAMES = {
    "M1": "m1 1m 1min min1", "M5": "m5 5m 5min min5", "M15": "m15 15m 15min min15", "M30": "m30 30m 30min min30",
    "H1": "h1 1h 60m 60min min60 60", "H4": "h4 4h 240m 240min min240 240", "D1": "d1 1d day daily 1440m 1440min",
    "W1": "w1 1w week weekly", "MN1": "mn1 1mo 1mon month monthly",
}


def test_every_file_name(spark):
    rows = [(f"S_{i}x_{a.upper() if i % 2 else a}.parquet", t, f"S_{i}x") for t, names in NAMES.items() for i, a in enumerate(names.split())]
    assert len(rows) == 43
    rows += [("US30.cash_H1.parquet", "H1", "US30.cash"), ("002008_min-60.parquet", "H1", "002008"), ("X_H1", "H1", "X")]
    rows += [("002008_xyz.parquet", None, None), ("plain.parquet", None, None), ("_H1.parquet", None, None), ("a_1hour.parquet", None, None)]
    df = spark.createDataFrame(rows, "name string, tf string, symbol string")
    got = df.select("*", bars.parsed_timeframe(F.col("name")).alias("a"), bars.parsed_symbol(F.col("name")).alias("b")).collect()
    assert [(r["name"], r["a"], r["b"]) for r in got] == [(r["name"], r["tf"], r["symbol"]) for r in got]


def test_unknown_names_are_errors(spark, tmp_path):
    one = spark.createDataFrame([(100, 1.0, 1.0, 1.0, 1.0, 5.0)], "time long, open double, high double, low double, close double, tick_volume double").coalesce(1)
    for name in ("AA_min60", "BB_nothing"):
        one.write.parquet(f"{tmp_path}/raw/{name}")
        part = next((tmp_path / "raw" / name).glob("*.parquet"))
        (tmp_path / "bars").mkdir(exist_ok=True)
        part.rename(tmp_path / "bars" / f"{name}.parquet")
    assert [tuple(r)[:2] for r in bars.from_files(spark, f"{tmp_path}/bars/AA_min60.parquet").collect()] == [("AA", "H1")]
    with pytest.raises(Exception, match="BB_nothing"):
        bars.from_files(spark, f"{tmp_path}/bars").collect()


def row(t, v=1.0):
    return (t, 1.0, 2.0, 0.5, 1.5, v)


def test_cache_takes_only_what_is_new(spark, tmp_path):
    cache, calls = connectors.Cache(spark, f"{tmp_path}/cache"), []
    have = [row(60 * i) for i in range(1, 6)]
    connectors.register("fake", lambda s, t, n: calls.append(n) or have[-n:])
    assert cache.get(None, "S", "M1").count() == 0 and cache.listed().count() == 0
    assert cache.get("fake", "S", "M1").count() == 5
    have += [row(360), row(420)]
    assert {r["time"] for r in cache.get("fake", "S", "M1", n=3).collect()} == {60 * i for i in range(1, 8)}
    assert calls == [50_000, 3]
    assert cache.get(None, "S", "M1").count() == 7 and cache.bars("S", "H1").count() == 0
    assert [tuple(r) for r in cache.listed().collect()] == [("S", "M1", 7, 420)]


def test_paged_history(spark, tmp_path):
    def page(after, n=250):
        times_ = [t for t in range(n, 0, -1) if after is None or 1000 * 10**9 + 60_000 * t < after][:100]
        return [row(1000 * 10**9 + 60_000 * t) for t in times_]

    assert [len(b) for b in connectors.paged(page)] == [100, 100, 50]
    assert sum(len(b) for b in connectors.paged(page, most=120)) == 120
    assert len(list(connectors.paged(lambda after: [row(7)] * 100))) == 3  # a page that never gets older
    cache = connectors.Cache(spark, f"{tmp_path}/history")
    assert cache.download(page, "C", "M1", pages_each=2) and not cache.download(page, "C", "M1")
    got = cache.bars("C", "M1")
    assert got.count() == 250 and got.agg(F.min("time")).first()[0] == 10**9 + 60  # milliseconds become seconds
    assert cache.done() == {("C", "M1")}


def test_server_clock_and_probe(spark):
    df = spark.createDataFrame([(10_000 + 3 * 3600 + 40, 10_000), (9_000, 10_000), (10_000 - 7200, 10_000)], "tick long, now long")
    assert [r[0] for r in df.select(connectors.server_offset(F.col("tick"), F.col("now"))).collect()] == [10_800, 0, -7200]

    def fetch(exchange):
        if exchange == "broken":
            raise OSError
        return [row(1)] if exchange == "good" else []

    assert connectors.probed(["empty", "broken", "good"], fetch) == ("good", [row(1)])
    assert connectors.probed(["empty"], fetch, known="good")[0] == "good"
    assert connectors.probed(["empty", "broken"], fetch) is None


def test_polls(spark):
    one = spark.range(1)
    at = lambda c: one.select(c).first()[0]
    assert at(times.next_poll(F.lit(100), F.lit(130), 60)) == 160 and at(times.next_poll(F.lit(100), F.lit(500), 60)) == 510
    assert at(times.still_good(F.lit(100), F.lit(140), F.lit(60))) and not at(times.still_good(F.lit(100), F.lit(149), F.lit(60)))
    assert at(times.still_good(F.lit(100), F.lit(109), F.lit(1)))


def reconcile(rows, most):
    """One round as the account's loop goes through it."""
    open_, out = sum(h != 0 for _, h, _ in rows), []
    for symbol, held, target in sorted(rows):
        side = "LONG" if target > 0 else "SHORT"
        if held == target:
            out.append((symbol, "HOLD"))
        elif held == 0 and open_ >= most:
            out.append((symbol, "SKIP"))
        elif held == 0:
            open_ += 1
            out.append((symbol, f"OPEN_{side}"))
        elif target == 0:
            open_ -= 1
            out.append((symbol, "CLOSE"))
        else:
            out.append((symbol, f"REVERSE_TO_{side}"))
    return out


def test_reconciliation(spark):
    rng = random.Random(3)
    for most in (1, 2, 5):
        rows = [(f"S{i:02}", rng.choice((-1, 0, 1)), rng.choice((-1, 0, 1))) for i in range(20)]
        got = risk.reconciled(spark.createDataFrame(rows, "symbol string, held int, target int"), most).collect()
        assert [tuple(r) for r in got] == reconcile(rows, most)


def test_lookups(spark):
    df = spark.createDataFrame([("A",), ("XAGUSD",), ("JP225",), ("EURUSD",)], "symbol string")
    got = {r["symbol"]: (r["market"], r["class"], r["cost"]) for r in bars.with_costs(df, {"A": "US30.cash"}).collect()}
    assert got == {"A": ("US30.cash", "index", 0.0003), "XAGUSD": ("XAGUSD", "metals", 0.0002), "JP225": ("JP225", "index", 0.0003), "EURUSD": ("EURUSD", "forex", 0.00015)}
    assert bars.permitted(df, (), ("A",)).count() == 3 and bars.permitted(df, ("A", "JP225"), ("A",)).count() == 1
