"""Folders of strategy artifacts scanned in a few plans, against one plan for each of them."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.functions.algebra import Engine
from barsmith.plans import artifacts, formulas, reports, search
from barsmith.sources.artifacts import read_strategies

PANEL = "symbol string, bar_idx long, time long, open double, high double, low double, close double, volume double, cost double"


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(6), []
    for symbol, n, cost in (("A", 130, 0.0002), ("B", 90, 0.0003)):
        c = 20 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        rows += [(symbol, i, 60 * i, *[float(x) for x in (c[i], c[i] * 1.01, c[i] * 0.99, c[i])], float(100 + i % 9), cost) for i in range(n)]
    return spark.createDataFrame(rows, PANEL).cache()


def figures(rows):
    return rows.groupBy("program", "symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("pnl").alias("total_return"))


def test_scan_of_a_folder(spark, panel, tmp_path):
    names, v = search.sampled(14, seed=12), formulas.VOCABULARY
    good = [("AB"[i % 2], v.encode(n.split())) for i, n in enumerate(names)]
    for i, (symbol, formula) in enumerate(good):
        (tmp_path / f"good{i:02}.json").write_text(json.dumps({"formula": formula, "symbol": symbol, "vocab_version": v.version}))
    again = {"formula": good[0][1], "symbol": good[0][0]}  # the same program once more, without a version
    bad = {
        "again": again, "version": again | {"vocab_version": "vold"}, "token": again | {"formula": [0, 999]}, "none": {"symbol": "A"},
        "symbol": again | {"symbol": "Z"}, "stack": again | {"formula": v.encode(["ADD"])},
    }
    for name, value in bad.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    table = read_strategies(spark, str(tmp_path))
    got = artifacts.scan(table, panel, figures, width=5).collect()
    assert len(got) == len(good) + len(bad)
    reasons = sorted(r["status"] for r in got if r["status"] != "ok")
    assert reasons == sorted(["made with vocabulary vold", "unknown token", "no formula", "unknown symbol", "not executable"])
    assert all((r["n_bars"] is None) == (r["status"] != "ok") for r in got)
    found = {(tuple(r["formula"]), r["symbol"]): (r["n_bars"], r["total_return"]) for r in got if r["status"] == "ok"}
    assert set(found) == {(tuple(f), s) for s, f in good}
    for symbol, cost in (("A", 0.0002), ("B", 0.0003)):
        own = [f for s, f in good if s == symbol]
        b = Engine(panel.filter(F.col("symbol") == symbol))  # the symbol alone
        out = b.frame(**{f"x{i}": reports.profit(b, formulas.compiled(b, [v.names[t] for t in f]), cost)["pnl"] for i, f in enumerate(own)})
        sums = out.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(len(own))]).first()
        for i, f in enumerate(own):
            assert found[tuple(f), symbol] == (sums["n"], pytest.approx(sums[f"x{i}"], abs=1e-9))


def test_waves_and_nothing_to_scan(spark, panel):
    programs = [(k, k % 3) for k in range(11)]
    cut = artifacts.waves(programs, 4)
    assert [len(w) for w in cut] == [4, 4, 3] and sorted(p for w in cut for p in w) == programs
    schema = "formula array<int>, symbol string, vocab_version string"
    none = artifacts.scan(spark.createDataFrame([([], "A", None)], schema), panel, figures)
    assert [(r["status"], r["n_bars"]) for r in none.collect()] == [("no formula", None)]
    assert artifacts.scan(spark.createDataFrame([], schema), panel, figures).count() == 0
