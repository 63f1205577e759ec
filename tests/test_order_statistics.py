"""Rank correlation and mutual information against pandas and numpy, with ties and constant candidates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.plans import evaluate


@pytest.fixture(scope="module")
def wide(spark):
    rng, rows = np.random.default_rng(3), []
    names = [f"f_{n.lower()}" for n in evaluate.NAMES]
    for symbol, n in (("A", 150), ("B", 90)):
        x = rng.normal(size=(n, len(names)))
        x[:, 1], x[:, 2] = 0.5, rng.integers(0, 3, n)  # a constant and one that is all ties
        y = np.round(x[:, 0] * 0.3 + rng.normal(size=n), 1)
        rows += [(symbol, t, float(n), float(y[t]), *map(float, x[t])) for t in range(n)]
    schema = "symbol string, bar_idx long, bars double, y double, " + ", ".join(f"{c} double" for c in names)
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def test_information(wide):
    data = wide.filter(F.col("bar_idx") < F.col("bars") - 2).toPandas()
    got = {r["name"]: r for r in evaluate.information(wide).collect()}
    assert len(got) == len(evaluate.NAMES) - 1 and evaluate.NAMES[1] not in got
    for name in (evaluate.NAMES[0], evaluate.NAMES[2], evaluate.NAMES[-1]):
        parts = [(d[f"f_{name.lower()}"], d["y"]) for _, d in data.groupby("symbol")]
        ic, rank = ([f(x).corr(f(y)) for x, y in parts] for f in (lambda v: v, lambda v: v.rank()))
        assert got[name]["ic"] == pytest.approx(np.mean(ic)) and got[name]["rank_ic"] == pytest.approx(np.mean(rank))
        assert got[name]["ir"] == pytest.approx(np.mean(ic) / (np.std(ic) + 1e-10))


def test_mutual_information(wide):
    data = wide.filter(F.col("bar_idx") < F.col("bars") - 2).toPandas()
    cand = evaluate.candidates(wide)
    once = {r["name"]: r["mi"] for r in evaluate.mutual_information(cand, evaluate.target(wide)).collect()}
    each = {r["name"]: r["mi"] for r in evaluate.mutual_information(cand).collect()}
    assert once == pytest.approx(each)
    k = min(20, max(5, int(np.sqrt(len(data)))))
    for name in (evaluate.NAMES[0], evaluate.NAMES[1], evaluate.NAMES[2]):
        cells = []
        for v in (data[f"f_{name.lower()}"].to_numpy(), data["y"].to_numpy()):
            edges = np.unique(np.quantile(v, np.arange(k + 1) / k))[1:-1]
            cells.append(np.searchsorted(edges, v, side="right"))
        joint = np.zeros((k + 1, k + 1))
        np.add.at(joint, tuple(cells), 1 / len(data))
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        want = (joint[joint > 0] * np.log(joint[joint > 0] / outer[joint > 0])).sum()
        assert once[name] == pytest.approx(max(want, 0.0), abs=1e-9)
    assert evaluate.mutual_information(cand.filter("false")).count() == 0
