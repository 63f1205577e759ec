"""The factor pool against a plain one, and the search that learns."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barsmith.functions.algebra import Engine
from barsmith.plans import catalog, evolve, formulas, pool, search
from barsmith.sources import bars

PANEL = "symbol string, bar_idx long, time long, open double, high double, low double, close double, volume double"


def plain_pool(batches, size):
    """batches: lists of (formula, values, score). Members as (formula, round, raw, score)."""
    members = []
    for k, batch in enumerate(batches):
        before = list(members)
        for formula, x, raw in batch:
            near = [abs(np.corrcoef(x, v)[0, 1]) for _, _, _, _, v in before if min(x.std(), v.std()) >= 1e-4]
            members.append((formula, k, raw, raw * 0.8 if any(c > 0.85 for c in near) else raw, x))
        members = sorted(members, key=lambda m: (-m[3], m[1], m[0]))[:size]
    return members


@pytest.mark.parametrize("size", [4, 25])
def test_pool_against_a_plain_one(spark, tmp_path, size):
    rng, batches, frames = np.random.default_rng(2), [], []
    base = rng.normal(size=(3, 200))
    for k in range(4):
        batch = []
        for i in range(6):
            mixed = base[i % 3] * rng.choice([0, 1, 4]) + rng.normal(size=200) if i else np.zeros(200) + k
            batch.append((f"f{k}_{i}", mixed, float(np.round(rng.normal(), 1))))
        batches.append(batch)
        rows = [("AB"[t % 2], t // 2, *[float(x[t]) for _, x, _ in batch]) for t in range(200)]
        wide = spark.createDataFrame(rows, "symbol string, bar_idx long, " + ", ".join(f"x{i} double" for i in range(6)))
        frames.append((wide, spark.createDataFrame([(f, f"x{i}", s) for i, (f, _, s) in enumerate(batch)], "formula string, column string, score double")))
    kept = pool.FactorPool(spark, str(tmp_path / "pool"), size)
    for k, (wide, found) in enumerate(frames):
        if k == 2:  # another session goes on
            kept = pool.FactorPool(spark, str(tmp_path / "pool"), size)
            assert kept.round == 1
        kept.update(wide.repartition(3), found)
    want = plain_pool(batches, size)
    got = [(r["formula"], r["round"], r["raw"], r["score"]) for r in kept.members().collect()]
    assert sorted(got) == sorted((f, k, raw, score) for f, k, raw, score, _ in want)
    # the stored correlations are those of the members, old pairs included
    names = {r["column"]: r["formula"] for r in kept.members().collect()}
    values = {f: x for f, *_, x in want}
    pairs = {(names[r["one"]], names[r["two"]]): r["correlation"] for r in kept.pairs().collect()}
    assert len(pairs) == len(want) * (len(want) - 1) // 2
    for (a, b), c in pairs.items():
        flat = min(values[a].std(), values[b].std()) < 1e-4
        assert c == pytest.approx(0.0 if flat else abs(np.corrcoef(values[a], values[b])[0, 1]), abs=1e-9)


def test_breeding():
    parents = search.sampled(20, seed=4)
    names = parents[0].split()
    for start, end in evolve.spans(names):
        assert formulas.executable(names[start:end])
    young = evolve.bred(parents, 60, "1")
    assert young == evolve.bred(parents, 60, "1") != evolve.bred(parents, 60, "2") and len(young) == len(set(young)) == 60
    assert all(formulas.executable(f.split()) and not formulas.violations(f.split()) and len(f.split()) <= formulas.MAX_LENGTH for f in young)
    tokens = {t for p in parents for t in p.split()}
    assert np.mean([all(t in tokens for t in f.split()) for f in young]) > 0.3  # much of it is inherited
    assert evolve.bred([], 5, "1") == []


@pytest.fixture(scope="module")
def panel(spark):
    """Returns that a formula can foresee: closes swing around a slow mean."""
    rng, rows = np.random.default_rng(9), []
    for symbol in "ABC":
        gap, level = 0.0, 0.0
        for i in range(240):
            gap = 0.8 * gap + rng.normal(0, 0.01)
            level += rng.normal(0, 0.001)
            c = 50 * np.exp(level + gap)
            c = float(c)
            rows.append((symbol, i, 86400 * i, c, c * 1.002, c * 0.998, c, float(100 + rng.integers(50))))
    return spark.createDataFrame(rows, PANEL).cache()


def test_search_learns_and_resumes(spark, panel, tmp_path):
    rounds, count = 3, 6
    run = evolve.Search(spark, str(tmp_path / "one"), lambda: Engine(panel), pool_size=6)
    run.run(2, count)
    again = evolve.Search(spark, str(tmp_path / "one"), lambda: Engine(panel), pool_size=6)
    assert again.round == 1 and again.pool.round == 1
    rows = again.run(rounds, count).collect()
    assert len(rows) == rounds * count == len({r["formula"] for r in rows})  # nothing is scored twice
    assert {r["round"] for r in rows} == set(range(rounds))
    blind = search.scores(Engine(panel), search.sampled(rounds * count, seed=77)).collect()
    best = lambda found: np.mean(sorted((r["raw"] if "raw" in r else r["score"] for r in found), reverse=True)[:5])
    assert best([r.asDict() for r in rows]) > best([r.asDict() for r in blind])
    assert again.elite(3).collect()[0]["score"] == max(r["score"] for r in rows if r["status"] == "ok")


def test_canonical_programs_are_scored_once():
    rng = random.Random(1)
    one = search.sampled(1, 5)[0].split()
    doubled = formulas.simplified([*one, "NEG", "NEG"])
    assert doubled == one
    assert all(formulas.simplified(m) == m for m in (formulas.simplified(evolve.mutated(rng, one)) for _ in range(50)))


def engines(monkeypatch):
    """What a query of the catalog gives its batches, kept from running; and how often it asks for the ticks."""
    real, asked, seen = bars.lineitem_days, [], []
    monkeypatch.setattr(bars, "lineitem_days", lambda *a, **k: (asked.append(a), real(*a, **k))[1])
    monkeypatch.setattr(search, "looped", lambda engine, tries: seen.extend(engine() for _ in tries))
    monkeypatch.setattr(catalog, "Engine", lambda panel: (seen.append(Engine(panel)), seen[-1])[1])
    monkeypatch.setattr(search, "columns", lambda b, tries: {f"x{i}": b.plain(b.close) for i in range(len(tries))} | {"y": b.plain(b.open)})
    return asked, seen


@pytest.mark.parametrize("name", ["search_loop", "search_pool"])
def test_batches_read_bars_that_are_written(spark, sf, monkeypatch, name):
    """The ticks are read once for all batches, and the bars are those of the panel."""
    asked, seen = engines(monkeypatch)
    want = sorted(map(tuple, bars.day_panel(spark, sf).collect()))
    asked.clear()
    catalog.QUERIES[name](spark, sf)
    assert len(asked) == 1 and len(seen) >= search.ROUNDS
    for b in seen[:: len(seen) - 1]:
        assert not any("lineitem" in f for f in b.panel.inputFiles())
        assert sorted(map(tuple, b.panel.collect())) == want
