"""Time sets as bits against Python sets."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from barsmith.plans import timesets


@pytest.mark.parametrize("step", [1, 3600])
def test_against_sets(spark, step):
    rng = random.Random(step)
    grid = [rng.randrange(-9000, 9000) * step for _ in range(900)]
    own = {s: {t + (17 if step > 20 and rng.random() < 0.1 else 0) for t in rng.sample(grid, n)} for s, n in (("A", 500), ("B", 700), ("C", 300), ("D", 3), ("E", 850))}
    own["F"] = {10**9 * step + 5}
    rows = [(s, t) for s, ts in own.items() for t in ts] + [("A", next(iter(own["A"])))] * 3 + [("A", None), (None, 4)]
    sets = timesets.packed(spark.createDataFrame(rows, "symbol string, time long").repartition(5), step).cache()
    assert {(r["symbol"], r["time"]) for r in timesets.times(sets, step).collect()} == {(s, t) for s, ts in own.items() for t in ts}
    got = {(r["one"], r["two"]): r["common_times"] for r in timesets.overlaps(sets).collect()}
    assert got == {(a, b): n for a, b in combinations(sorted(own), 2) if (n := len(own[a] & own[b]))}
    every = set().union(*own.values())
    left = [(r["symbol"], r["time"]) for r in timesets.missing(sets, step).collect()]
    assert len(left) == len(set(left)) and set(left) == {(s, t) for s, ts in own.items() for t in every - ts}
    kernel = own["B"] & own["E"]
    assert {r["symbol"]: r["common_times"] for r in timesets.aligned_group(sets, ["B", "E"], 100).collect()} == {s: n for s, ts in own.items() if (n := len(ts & kernel)) >= 100}
    assert timesets.aligned_group(sets, ["B", "Z"], 1).count() == 0
    none = timesets.packed(spark.createDataFrame([], "symbol string, time long"), step)
    assert timesets.overlaps(none).count() == timesets.missing(none, step).count() == 0
