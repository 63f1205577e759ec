"""The second language, times, subsets, streams over several batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barsmith.functions import times
from barsmith.functions.algebra import Engine
from barsmith.plans import evaluate, prefix, search
from barsmith.streaming import live


def test_times(spark):
    moments = [0, 1_700_000_000 // 60 * 60, 4_102_444_800]
    rows = spark.createDataFrame([(m,) for m in moments], "t long")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = rows.select("t", times.text(F.col("t")), times.parsed(times.text(F.col("t"), times.EAST))).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [(r[0], r[1], r[2]) for r in got] == [(m, dt.datetime.fromtimestamp(m, dt.UTC).strftime("%Y-%m-%d %H:%M"), m) for m in moments]
    texts = spark.createDataFrame([("2026-07-15 15:00",), ("2026-07-15 15:00:30",), ("2026-07-15",), ("15.7.2026",), ("2026-13-40",)], "s string")
    base = int(dt.datetime(2026, 7, 15, tzinfo=dt.timezone(dt.timedelta(hours=8))).timestamp())
    assert [r[0] for r in texts.select(times.parsed(F.col("s"))).collect()] == [base + 54_000, base + 54_030, base, 0, 0]


@pytest.mark.parametrize("now, want", [(3500, 3600), (3601, 7200), (7199, 7200), (7200, 10_800), (10_801, None), (50_000, None)])
def test_next_close(spark, now, want):
    got = spark.range(1).select(times.next_close(F.lit(0), 3600, F.lit(now))).first()[0]
    assert got == want


def test_names(spark):
    got = spark.range(1).select(times.safe_name(F.lit("US30.cash / H1")), times.plain_text(F.lit("\x1b[31mred\x1b[0m"))).first()
    assert tuple(got) == ("US30.cash_H1", "red")


def test_prefix_programs(spark):
    rows = [("A", i, i, 1.0 + i % 5, 6.0, 1.0, 1.0 + i % 5, 10.0 + i % 3) for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, time long, open double, high double, low double, close double, volume double")
    b = Engine(df)
    assert prefix.compiled(b, "ADD RET".split()) is None and prefix.compiled(b, "RET RET".split()) is None
    out = b.frame(v=prefix.compiled(b, "SUB RET5 RET5".split()), w=prefix.compiled(b, ["VOL_CHG"])).orderBy("bar_idx").collect()
    assert all(r["v"] == 0 for r in out) and all(abs(r["w"]) <= 5 for r in out)
    assert prefix.infix("ADD RET5 MUL VOL_CHG NEG TREND".split()) == "(RET5 + (VOL_CHG * NEG(TREND)))"


def test_active_subset():
    rows = [{"name": n, "score": s, "status": st} for n, s, st in (("a", 0.2, "retained"), ("b", 0.9, "retained"), ("c", 0.8, "pruned"), ("d", float("-inf"), "retained"))]
    assert evaluate.active_subset(rows) == ["b", "a", "d"]
    assert evaluate.active_subset(rows, 0.5) == ["b"] and evaluate.active_subset(rows, most=2) == ["b", "a"]


def test_champion_gate(spark):
    df = spark.createDataFrame([(1.0, 0.6, 0.2), (1.0, 0.4, 0.2), (1.0, 0.9, 0.01)], "a double, b double, c double")
    assert [r[0] for r in df.select(search.gated(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False]


def test_stream_keeps_state_across_batches(spark, tmp_path):
    """Two files are two micro-batches: the flip between them is seen, the forming bar is not."""
    def part(n, rows):
        df = spark.createDataFrame([(i, dt.datetime(2024, 1, d, h), 1, "x", v, "") for i, d, h, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"raw{n}"))
        source = next((tmp_path / f"raw{n}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        source.rename(tmp_path / "in" / f"{n}.parquet")

    part(0, [(1, 1, 1, 60.0), (2, 1, 5, 70.0), (3, 2, 1, 80.0)])
    part(1, [(4, 2, 3, 10.0), (5, 3, 1, 50.0), (6, 1, 23, 99.0)])
    ticks = live.ticks(spark, str(tmp_path / "in"), "*.parquet")
    flips = {(r["event_id"], r["was"], r["dir"]) for r in live.drained(spark, live.flips(ticks), "t-flips").collect()}
    assert flips == {(4, "LONG", "SHORT"), (5, "SHORT", "FLAT")}
    bars = {r["time"] // 86400 - 19723: (r["open"], r["close"], r["volume"]) for r in live.drained(spark, live.closed_bars(ticks), "t-bars").collect()}
    # the late tick still meets its bar, which comes out with the second batch; the forming day does not
    assert bars == {0: (60.0, 99.0, 3.0), 1: (80.0, 10.0, 2.0)}
