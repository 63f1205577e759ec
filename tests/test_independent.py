"""Operators, features and reports against definitions written out here in plain Python and numpy, which
share no code with the builders that make the queries and their SQL."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.functions.algebra import Engine
from barsmith.functions.features import FEATURES
from barsmith.operators.formula_ops import OPERATORS
from barsmith.plans import evaluate, reports, search

BARS = 64


@pytest.fixture(scope="module")
def market():
    """Three symbols: a walk, one with ties and flat stretches, one that falls and jumps."""
    rng = random.Random(5)
    out = {}
    for k, name in enumerate("ABC"):
        rows, close = [], 50.0 + 10 * k
        for t in range(BARS):
            before = close
            step = rng.gauss(0, 1) if k != 1 else rng.choice([0, 0, 0, 1, -1])
            close = max(1.0, close + step + (25 if k == 2 and t == 40 else -0.3 * (k == 2)))
            high, low = max(before, close) + rng.choice([0, 0.5]), min(before, close) - rng.choice([0, 0.5])
            rows.append((name, t, 86400 * t, before, high, low, close, float(rng.randrange(1, 9) * 100 * (t % 13 != 5))))
        out[name] = rows
    return out


@pytest.fixture(scope="module")
def panel(spark, market):
    rows = [r for own in market.values() for r in own]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, time long, open double, high double, low double, close double, volume double").repartition(3)


def padded(x, t, d):
    """The last d values up to t, zeros before the first."""
    return [x[i] if i >= 0 else 0.0 for i in range(t - d + 1, t + 1)]


def mean(w):
    return sum(w) / len(w)


def moment(w, p):
    return mean([(v - mean(w)) ** p for v in w])


def std(w):
    return math.sqrt(moment(w, 2))


def cov(a, b):
    return mean([(x - mean(a)) * (y - mean(b)) for x, y in zip(a, b, strict=True)])


def quantile(w, q):
    s, at = sorted(w), q * (len(w) - 1)
    lo = int(at)
    return s[lo] + (s[min(lo + 1, len(w) - 1)] - s[lo]) * (at - lo)


def windowed(d, f):
    return lambda x: [f(padded(x, t, d)) for t in range(len(x))]


def recursive(span):
    def run(x):
        out = [x[0]]
        for v in x[1:]:
            out.append(2 / (span + 1) * v + (1 - 2 / (span + 1)) * out[-1])
        return out

    return run


def each(f):
    return lambda *xs: [f(*v) for v in zip(*xs, strict=True)]


def jump(x):
    out = []
    for t in range(len(x)):
        w = x[: t + 1]
        spread = math.sqrt(max(mean([v * v for v in w]) - mean(w) ** 2, 1e-12)) + 1e-6
        out.append(0.0 if t < 5 else math.tanh((x[t] - mean(w)) / spread - 1.5))
    return out


def corr10(x, y):
    out = []
    for t in range(len(x)):
        a, b = padded(x, t, 10), padded(y, t, 10)
        out.append(0.0 if std(a) < 1e-6 or std(b) < 1e-6 else cov(a, b) / (std(a) * std(b) + 1e-8))
    return out


def winsorize(x):
    out = []
    for t, v in enumerate(x):
        w = padded(x, t, 20)
        lo, hi = quantile(w, 0.05), quantile(w, 0.95)
        out.append(v if hi - lo < 1e-9 else min(max(v, lo), hi))
    return out


def sign(v):
    return (v > 0) - (v < 0)


def square(v):
    return max(min(sign(v) * v * v, 1e9), -1e9)


def clean_div(x, y):
    return x / (y + 1e-6)


def below(d):
    return windowed(d, lambda w: sum(v < w[-1] for v in w) / d)


def zscore(d):
    return windowed(d, lambda w: (w[-1] - mean(w)) / (std(w) + 1e-9) if std(w) >= 1e-9 else 0.0)


PLAIN = {
    "ADD": each(lambda x, y: x + y),
    "SUB": each(lambda x, y: x - y),
    "MUL": each(lambda x, y: x * y),
    "DIV": each(clean_div),
    "NEG": each(lambda x: -x),
    "ABS": each(abs),
    "SIGN": each(sign),
    "GATE": each(lambda c, x, y: x if c > 0 else y),
    "JUMP": jump,
    "DECAY": windowed(3, lambda w: (w[2] + 0.8 * w[1] + 0.6 * w[0]) / 2.4),
    "DELAY1": windowed(2, lambda w: w[0]),
    "MAX3": windowed(3, max),
    **{f"TS_MEAN_{d}": windowed(d, mean) for d in (5, 10, 20)},
    **{f"TS_STD_{d}": windowed(d, lambda w: std(w) + 1e-6) for d in (5, 10, 20)},
    **{f"TS_RANK_{d}": below(d) for d in (5, 10, 20)},
    "TS_CORR_10": corr10,
    "MOMENTUM_5": windowed(20, lambda w: mean(w[-5:]) - mean(w)),
    "MOMENTUM_10": windowed(20, lambda w: mean(w[-10:]) - mean(w)),
    "TS_MAX_10": windowed(10, max),
    "TS_MIN_10": windowed(10, min),
    "WMA": windowed(3, lambda w: (3 * w[2] + 2 * w[1] + w[0]) / 6),
    "DELAY4": windowed(5, lambda w: w[0]),
    "EMA_5": recursive(5),
    "EMA_20": recursive(20),
    "TS_QUANTILE_10": below(10),
    "TS_SKEW_10": windowed(10, lambda w: moment(w, 3) / (std(w) + 1e-6) ** 3),
    "TS_MIN_20": windowed(20, min),
    "TS_MAX_20": windowed(20, max),
    "DELTA": lambda x: [0.0] + [b - a for a, b in zip(x, x[1:], strict=False)],
    "TS_ARG_MAX_5": windowed(5, lambda w: w.index(max(w)) / 4),
    "TS_ARG_MIN_5": windowed(5, lambda w: w.index(min(w)) / 4),
    "DECAY_LINEAR_5": windowed(5, lambda w: sum((i + 1) * v for i, v in enumerate(w)) / 15),
    "SCALE": lambda x: [v / (sum(map(abs, x[: t + 1])) + 1e-6) for t, v in enumerate(x)],
    "COVARIANCE_10": lambda x, y: [cov(padded(x, t, 10), padded(y, t, 10)) for t in range(len(x))],
    "PRODUCT_5": windowed(5, lambda w: math.expm1(min(max(sum(math.log1p(max(v, -0.999)) for v in w), -10), 10))),
    "SIGNED_POWER_2": each(square),
    "TS_DECAY_EXP_5": windowed(5, lambda w: sum(v * 0.5 ** (i + 1) for i, v in enumerate(w)) / sum(0.5 ** (i + 1) for i in range(5))),
    "DELTA_5": lambda x: [0.0] * 5 + [b - a for a, b in zip(x, x[5:], strict=False)],
    **{f"TS_SUM_{d}": windowed(d, sum) for d in (5, 10, 20)},
    "MIN": each(min),
    "MAX": each(max),
    "POWER": each(square),
    "SIGNED_LOG": each(lambda v: sign(v) * math.log1p(abs(v))),
    "SQRT": each(lambda v: sign(v) * math.sqrt(abs(v))),
    "TS_ZSCORE_10": zscore(10),
    "TS_ZSCORE_20": zscore(20),
    "WINSORIZE": winsorize,
    "CLIP": each(lambda v: max(min(v, 3), -3)),
    "SIGMOID": each(lambda v: 2 / (1 + math.exp(-v)) - 1),
    "TANH_SQUASH": each(math.tanh),
    "IF_GT": each(lambda c, x, y: x if c > 0 else y),
    "GT": each(lambda x, y: float(x > y)),
    "LT": each(lambda x, y: float(x < y)),
    "AND": each(lambda x, y: float(x > 0 and y > 0)),
    "OR": each(lambda x, y: float(x > 0 or y > 0)),
}
ACROSS = {
    "CS_RANK": lambda col: [sorted(range(3), key=lambda k: (col[k], k)).index(i) / 2 for i in range(3)],
    "CS_SCALE": lambda col: [0.5 if max(col) - min(col) < 1e-9 else (v - min(col)) / (max(col) - min(col)) for v in col],
    "CS_NEUTRALIZE": lambda col: [v - mean(col) for v in col],
}


def test_every_operator(panel, market):
    """All operators at once, on the bar's change, its volume and its range."""
    assert set(PLAIN) | set(ACROSS) == set(OPERATORS)
    b = Engine(panel)
    args = [(b.close - b.open), b.volume / 1000.0, b.high - b.low]
    order = {1: [args[0]], 2: args[:2], 3: args}
    df = b.frame(**{f"v_{n}": op.build(b, *order[op.arity]) for n, op in OPERATORS.items()})
    got = {(r["symbol"], r["bar_idx"]): r for r in df.collect()}
    inputs = {s: ([r[6] - r[3] for r in rows], [r[7] / 1000 for r in rows], [r[4] - r[5] for r in rows]) for s, rows in market.items()}
    for name, op in OPERATORS.items():
        for s in market:
            want = PLAIN[name](*inputs[s][: op.arity]) if name in PLAIN else [ACROSS[name]([inputs[k][0][t] for k in "ABC"])["ABC".index(s)] for t in range(BARS)]
            have = [got[s, t][f"v_{name}"] for t in range(BARS)]
            assert np.allclose(have, want, rtol=1e-7, atol=1e-7), (name, s, [(t, h, w) for t, (h, w) in enumerate(zip(have, want, strict=True)) if abs(h - w) > 1e-7][:3])


def test_profit_and_reports(spark, panel, market):
    """Profit, rolling Sharpe, export, folds and the quality of turnover from their definitions."""
    b = Engine(panel)
    pnl = b.frame(**reports.profit(b, b.close - b.open)).cache()
    rows = {s: [r for r in sorted(pnl.filter(F.col("symbol") == s).collect(), key=lambda r: r["bar_idx"])] for s in "ABC"}
    want = {}
    for s, own in market.items():
        raw = [math.tanh(r[6] - r[3]) for r in own]
        pos = [0.0 if abs(v) < 0.05 else v for v in raw]
        target = [math.log(own[t + 2][3] / own[t + 1][3]) if t < BARS - 2 else 0.0 for t in range(BARS)]
        want[s] = [pos[t] * target[t] - abs(pos[t] - (pos[t - 1] if t else 0.0)) * 0.0003 for t in range(BARS)]
        assert np.allclose([r["pnl"] for r in rows[s]], want[s], atol=1e-12)
    rolling = {(r["symbol"], r["bar_idx"]): r["rolling_sharpe"] for r in reports.REPORTS["stat_rolling_sharpe"].run(spark, pnl).collect()}
    for s in "ABC":  # shorter than the window: the last bar alone has a value
        value = float(np.clip(np.mean(want[s]) / np.std(want[s]) * math.sqrt(252), -20, 20))
        assert [rolling[s, t] for t in range(BARS - 1)] == [None] * (BARS - 1) and abs(rolling[s, BARS - 1] - value) < 1e-5
    for s, r in {r["symbol"]: r for r in reports.REPORTS["stat_bars_per_year"].run(spark, pnl).collect()}.items():
        assert r["ppy"] == round(BARS / ((BARS - 1) * 86400 / (365.25 * 86400)))
    got = reports.REPORTS["score_turnover_quality"].run(spark, pnl).first()
    runs = []
    for s in "ABC":
        before = 0
        for r in rows[s]:
            now = sign(r["position"])
            if now and now == before:
                runs[-1] += 1
            elif now:
                runs.append(1)
            before = now
    ratio = len(runs) / (3 * BARS / 12)
    score = math.exp(-0.5 * math.log2(ratio) ** 2) if 0.5 <= ratio <= 2 else 0.5 - (ratio - 2) / 6 * 1.5 if 2 < ratio <= 8 else None
    bonus = min(0.3, math.log(max(mean(runs), 1)) / math.log(30) * 0.3)
    assert got["n_runs"] == len(runs) and score is not None and abs(got["quality"] - score - bonus) < 2e-6


@pytest.mark.parametrize("bars", [30, 1500, 1501, 2496, 4000])
def test_export_takes_evenly_spaced_bars(spark, bars):
    pnl = spark.range(bars).selectExpr("'A' AS symbol", "id AS bar_idx", "id AS time", "cast(id % 7 - 3 AS double) AS pnl")
    out = reports.REPORTS["stat_equity_export"].run(spark, pnl.unionAll(pnl.selectExpr("'B'", "bar_idx", "time", "pnl * 3"))).collect()
    places = np.unique(np.linspace(0, bars - 1, 1500).astype(int)) if bars > 1500 else np.arange(bars)
    value = np.cumsum(np.arange(bars) % 7 - 3.0)
    for series, times in (("A", 1), ("B", 3), ("portfolio", 2)):
        own = sorted((r["bar_idx"], r["equity"]) for r in out if r["series"] == series)
        assert [t for t, _ in own] == places.tolist()
        assert np.allclose([e for _, e in own], value[places] * times, atol=1e-5)


def test_features_from_their_definitions(panel, market):
    """Raw features that a few lines of numpy define."""

    def prev(x, k):
        return np.r_[x[:k], x[:-k]] if k else x

    def roll(x, d, f):
        return np.array([f(padded(x.tolist(), t, d)) for t in range(len(x))])

    def plain(o, h, lo, c, v):
        ret = np.log(c / prev(c, 1))
        return {
            "RET": ret,
            "RET5": np.log(c / prev(c, 5)),
            "RET20": np.log(c / prev(c, 20)),
            "HL_RANGE": (h - lo) / (c + 1e-9),
        }

    names = [n for n in ("RET", "RET5", "RET20", "HL_RANGE") if n in FEATURES]
    b = Engine(panel)
    df = b.frame(**{f"v_{n}": FEATURES[n].build(b, False) for n in names})
    got = {(r["symbol"], r["bar_idx"]): r for r in df.collect()}
    for s, own in market.items():
        o, h, lo, c, v = (np.array([r[i] for r in own]) for i in range(3, 8))
        for n, want in plain(o, h, lo, c, v).items():
            have = np.array([got[s, t][f"v_{n}"] for t in range(BARS)])
            assert np.allclose(have, want, atol=1e-6), (n, s)


def test_evaluation_against_numpy(spark, monkeypatch):
    """Correlations, degenerate candidates, scores and pruning of a few made-up candidates."""
    rng = np.random.default_rng(1)
    n = 300
    base = rng.normal(size=n)
    cols = {"AA": base, "BB": base + 0.01 * rng.normal(size=n), "CC": rng.normal(size=n), "DD": np.zeros(n), "EE": -base}
    monkeypatch.setattr(evaluate, "NAMES", tuple(cols))
    y = 0.5 * base + rng.normal(size=n)
    rows = [("S" if t < n // 2 else "T", t % (n // 2), float(y[t]), float(n // 2 + evaluate.HORIZON), *[float(x[t]) for x in cols.values()]) for t in range(n)]
    wide = spark.createDataFrame(rows, "symbol string, bar_idx long, y double, bars double, " + ", ".join(f"f_{k.lower()} double" for k in cols))
    got = {(r["one"], r["two"]): r["correlation"] for r in evaluate.correlations(wide).collect()}
    for i, a in enumerate(cols):
        for c in list(cols)[i + 1 :]:
            want = 0.0 if "DD" in (a, c) else abs(np.corrcoef(cols[a], cols[c])[0, 1])
            assert abs(got[a, c] - want) < 1e-9
    cand = evaluate.candidates(wide)
    ranks = spark.sql(f"WITH {evaluate.RANKED} SELECT name, rank_ic FROM ev".replace("{pnl}", "{cand}"), cand=cand)
    flat = evaluate.EVALUATIONS["eval_degenerate"].run(spark, cand).select("name", "degenerate")
    scores = {r["name"]: r["score"] for r in evaluate.scored(flat, ranks, evaluate.mutual_information(cand)).collect()}
    assert scores["DD"] is None and scores["CC"] == 0.0 and set(scores) == set(cols)
    kept = {r["name"]: r for r in evaluate.pruned(scores, {frozenset(k): v for k, v in got.items()}, 0.9)}
    best = min(("AA", "BB", "EE"), key=lambda k: (-scores[k], k))
    assert kept[best]["status"] == kept["CC"]["status"] == kept["DD"]["status"] == "retained"
    assert all(kept[k]["status"] == "pruned" and kept[k]["pruned_in_favor_of"] == best for k in ("AA", "BB", "EE") if scores[best] - scores[k] > 0.01)


def test_long_symbols_stream_in_pieces(spark):
    """A symbol of many batches gives what the whole series gives, for every grouped function."""
    n = 30_000
    x = np.random.default_rng(2).normal(size=n).cumsum()
    rows = spark.createDataFrame([("L", t, float(v)) for t, v in enumerate(x)] + [("S", t, float(x[t])) for t in range(90)], "symbol string, bar_idx long, close double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        b = Engine(rows)
        out = b.frame(ema=b.ema(b.close, 20), fema=b.fema(b.close, 12), rn=b.rn(b.close)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = {"L": x, "S": x[:90]}
    for s, v in whole.items():
        own = sorted((r["bar_idx"], r["ema"], r["fema"], r["rn"]) for r in out if r["symbol"] == s)
        assert np.allclose([r[1] for r in own], recursive(20)(v.tolist()), atol=1e-9)
        w = math.ceil(math.log(1e-6) / math.log(1 - 2 / 13))
        if len(v) >= 2 * w:
            weights = 2 / 13 * (1 - 2 / 13) ** np.arange(w)
            fema = np.convolve(np.r_[np.full(w - 1, v[0]), v], weights, "valid")
        else:
            fema = recursive(12)(v.tolist())
        assert np.allclose([r[2] for r in own], fema, atol=1e-9)
        for t in (0, 198, 199, 200, 701, 1399, 1400, 25_000, n - 1):
            if t < len(v):
                part = v[max(t - 199, 0) : t + 1]
                med = np.sort(part)[(200 - 1) // 2] if t >= 199 else None
                want = 0.0 if med is None else float(np.clip((v[t] - med) / (np.sort(np.abs(part - med))[99] + 1e-6), -5, 5))
                assert abs(own[t][3] - want) < 1e-9


def test_search_pool_and_draws(spark):
    tries = search.batches(2, 3, 5)
    assert [len(b) for b in tries] == [3, 3] and len({t for b in tries for t in b}) == 6
    assert tries == search.batches(2, 3, 5)
    pool = spark.createDataFrame([(f"f{i}", "ok", float(i)) for i in range(40)], "formula string, status string, score double")
    weight = search.replay_weight(F.col("score") / 10, F.lit(0))
    one, two = ([r["formula"] for r in search.drawn(pool, 5, weight, s).collect()] for s in (1, 2))
    assert one == [r["formula"] for r in search.drawn(pool.repartition(3), 5, weight, 1).collect()] and one != two
    often = [r["score"] for s in range(30) for r in search.drawn(pool, 5, weight, s).collect()]
    assert sum(often) / len(often) > 25  # better formulas come more often
