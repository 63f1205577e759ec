"""Watched symbols against a plain loop over closed bars, however the ticks are split into batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from barsmith.streaming import live, watch

SCHEMA = live.EVENT
WIDTH, CADENCES, KEEP = 600, (1200, 3000), 1500


def ticks(n=700, seed=1):
    rng, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 5, 40, 90, 400, 2500]) * 1_000_000 + rng.randrange(3)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=at)
        out.append((i, ts, 1, rng.choice(["A", "B"]), float(rng.randrange(30, 70)), None))
    return out


def plain(rows):
    micros = lambda ts: (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    end = max(micros(ts) for _, ts, *_ in rows)
    bars: dict = {}
    for i, ts, _, symbol, value, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        bars.setdefault((symbol, micros(ts) // 1_000_000 // WIDTH * WIDTH), []).append(value)
    out, state = [], {}
    for (symbol, start), v in sorted(bars.items(), key=lambda x: x[0][1]):
        now = start + WIDTH
        if now * 1_000_000 > end // 1000 * 1000:  # watermarks are milliseconds
            continue
        was, past, due, got = state.get(symbol, (None, [], [now] * 2, None))
        direction = "LONG" if v[-1] >= 55 else "SHORT" if v[-1] <= 45 else "FLAT"
        past = [*past, v[-1]][-live.HISTORY :]
        polled = [now >= d for d in due]
        fresh = any(polled) and (got is None or now - got >= KEEP)
        state[symbol] = direction, past, [now + c if p else d for d, c, p in zip(due, CADENCES, polled)], now if fresh else got
        out.append((symbol, start, v[0], max(v), min(v), v[-1], float(len(v)), direction, was is not None and was != direction, len(past), sum(past) / len(past), sum(polled), fresh))
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [3, 100, 101, 350, 600], list(range(60, 700, 90))])
def test_events_do_not_depend_on_batches(spark, tmp_path, cuts):
    rows = ticks()
    random.Random(len(cuts)).shuffle(part := list(range(len(rows))))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        inside = [rows[i] for i in part if a <= i < b]  # in any order within a batch
        spark.createDataFrame(inside, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in-{k}"))
        (next((tmp_path / f"in-{k}").glob("*.parquet"))).rename(tmp_path / f"batch-{k:03}.parquet")
    stream = live.ticks(spark, str(tmp_path), "batch-*.parquet")
    got = sorted(tuple(r) for r in watch.events(spark, stream, WIDTH, CADENCES, KEEP).collect())
    want = plain(rows)
    assert [g[:10] + g[11:] for g in got] == [w[:10] + w[11:] for w in want] and len(want) > 200
    assert [g[10] for g in got] == pytest.approx([w[10] for w in want])
    assert max(g[9] for g in got) == live.HISTORY and any(g[8] for g in got) and not all(g[12] for g in got)


def test_ticks_that_tell_nothing(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, day, 1, "A", 60.0, None), (2, None, 1, "A", 1.0, None), (3, day, 1, None, 1.0, None), (4, day, 1, "A", None, None), (None, day, 1, "A", 40.0, None)]
    rows += [(5, day + dt.timedelta(hours=1), 1, "A", 50.0, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = watch.events(spark, live.ticks(spark, str(tmp_path / "in"), "*.parquet"), WIDTH, CADENCES, KEEP).collect()
    # a tick without an id comes first at its time; the last bar is still forming
    assert [(r["open"], r["close"], r["volume"], r["direction"]) for r in got] == [(40.0, 60.0, 2.0, "LONG")]


def test_merged_parts_of_a_bar():
    a, b = (5, 1, 3.0, 9.0, 2.0, 7, 2, 4.0, 3.0), (1, 9, 8.0, 8.0, 1.0, 6, 3, 5.0, 2.0)
    assert watch.merged(a, b) == watch.merged(b, a) == (1, 9, 8.0, 9.0, 1.0, 7, 2, 4.0, 5.0)
