"""Panels, files, connectors and artifacts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from barsmith.sources import artifacts, bars, connectors

BAR = "symbol string, time long, open double, high double, low double, close double, volume double"


def make(spark, rows):
    return spark.createDataFrame([(s, t, p, p, p, p, v) for s, t, p, v in rows], BAR)


def test_alignment_by_common_times(spark):
    df = make(spark, [("A", 1, 1.0, 1.0), ("A", 2, 2.0, 1.0), ("A", 3, 3.0, 1.0), ("B", 2, 5.0, 1.0), ("B", 3, 6.0, 1.0), ("B", 9, 7.0, 1.0)])
    got = {(r["symbol"], r["bar_idx"], r["time"]) for r in bars.aligned(df).collect()}
    assert got == {("A", 0, 2), ("A", 1, 3), ("B", 0, 2), ("B", 1, 3)}


def test_alignment_by_last_values(spark):
    df = make(spark, [("A", 1, 1.0, 1.0), ("A", 3, 3.0, 2.0), ("B", 2, 5.0, 3.0)])
    got = {(r["symbol"], r["time"]): (r["close"], r["volume"]) for r in bars.filled(df).collect()}
    assert got == {("A", 1): (1, 1), ("A", 2): (1, 1), ("A", 3): (3, 2), ("B", 1): (0, 0), ("B", 2): (5, 3), ("B", 3): (5, 3)}
    assert bars.aligned_or_filled(df, least=1).count() == 6
    assert bars.aligned(df).count() == 0


@pytest.mark.parametrize("keep, price", [("first", 1.0), ("last", 3.0), ("max_volume", 2.0)])
def test_dedup_policies(spark, keep, price):
    df = make(spark, [("A", 1, 1.0, 5.0), ("A", 1, 2.0, 9.0), ("A", 1, 3.0, 5.0)]).withColumn("ingest", F.col("close"))
    assert [r["close"] for r in bars.deduplicated(df, keep).collect()] == [price]


def test_least_bars_append_and_continuous(spark):
    df = make(spark, [("A", t, 1.0, 1.0) for t in range(5)] + [("B", 1, 1.0, 1.0)])
    assert {r["symbol"] for r in bars.enough(df, 5).collect()} == {"A"}
    new = make(spark, [("A", 4, 9.0, 1.0), ("A", 5, 9.0, 1.0), ("C", 0, 9.0, 1.0)])
    got = {(r["symbol"], r["time"], r["close"]) for r in bars.appended(df, new).filter("symbol <> 'B'").collect()}
    assert got == {("A", t, 1.0) for t in range(5)} | {("A", 5, 9.0), ("C", 0, 9.0)}
    two = make(spark, [("m1", 1, 1.0, 5.0), ("m2", 1, 2.0, 7.0), ("m2", 2, 3.0, 1.0)])
    assert [(r["symbol"], r["close"]) for r in bars.continuous(two, "main").orderBy("time").collect()] == [("main", 2.0), ("main", 3.0)]


NAMES = {
    "AAPL_H1.parquet": ("AAPL", "H1"), "US30.cash_H1": ("US30.cash", "H1"), "002008_60min": ("002008", "H1"), "BTC_USDT_1h": ("BTC_USDT", "H1"),
    "600519_5min": ("600519", "M5"), "000001_1d": ("000001", "D1"), "bar_m30": ("bar", "M30"), "002008_xyz": (None, None), "nothing": (None, None),
}


def test_file_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = df.select("name", bars.parsed_symbol(F.col("name")), bars.parsed_timeframe(F.col("name"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == NAMES


def test_files(spark, tmp_path):
    import pandas as pd

    one = pd.DataFrame({"time": [1700000, 1700003, 1700003], "open": [1.0, 2, 3], "high": [1.0, 2, 3], "low": [1.0, 2, 3], "close": [1.0, 2, 3], "tick_volume": [1, 2, 3]})
    one.to_parquet(tmp_path / "EURUSD_H1.parquet")
    got = bars.from_files(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r["symbol"], r["timeframe"], r["time"], r["close"]) for r in got] == [("EURUSD", "H1", 1700000000, 1.0), ("EURUSD", "H1", 1700003000, 3.0)]
    out = spark.createDataFrame(got)
    artifacts.write_bars(out, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).filter("symbol = 'EURUSD'").count() == 2


def test_artifacts(spark, tmp_path):
    whole = {"vocab_version": "v1", "symbol": "A", "formula": [1, 2, 70], "best_score": 0.5, "mode": "ftmo"}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    (tmp_path / "b.json").write_text("[3, 4]")
    got = {r["symbol"]: r["formula"] for r in artifacts.read_strategies(spark, str(tmp_path)).collect()}
    assert got == {"A": [1, 2, 70], None: [3, 4]}


def test_connector(spark):
    connectors.register("memory", lambda s, t, n: [(1_700_000_000_000 + 3_600_000 * i, 1.0, 1.0, 1.0, float(i), 1.0) for i in range(5)])
    got = connectors.read(spark, "memory", "A", "H1", 3, F.lit(1_700_000_000 + 3600 * 4)).collect()
    assert [r["close"] for r in got] == [1.0, 2.0, 3.0]  # the forming bar is left out
    ids = spark.createDataFrame([("btcusdt",), ("eth/usdt",), ("SOL-USDT-SWAP",)], "n string").select(connectors.instrument_id(F.col("n"))).collect()
    assert [r[0] for r in ids] == ["BTC-USDT", "ETH-USDT", "SOL-USDT-SWAP"]
    codes = spark.createDataFrame([("600519",), ("000001",), ("830799",)], "c string").select(connectors.market_of(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["SH", "SZ", "BJ"]


def test_zone_does_not_move_bars(spark, sf):
    want = bars.lineitem_days(spark, sf).agg(F.sum("time"), F.count("time")).first()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert bars.lineitem_days(spark, sf).agg(F.sum("time"), F.count("time")).first() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
