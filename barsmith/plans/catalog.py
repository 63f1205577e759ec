"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions.algebra import Engine, X
from barsmith.functions import times
from barsmith.functions.features import FEATURES
from barsmith.functions.features import ret as B_ret
from barsmith.operators.formula_ops import OPERATORS
from barsmith.plans import artifacts, evaluate, evolve, formulas, pool, prefix, quality, reports, risk, search, timesets
from barsmith.sources import bars as B
from barsmith.sources.storage import shared_path, stored
from barsmith.sql import panels as P
from barsmith.sql.duck import Duck
from barsmith.streaming import live, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str | Callable[[], str]] = {}


def rounded(name: str, value: Column | None = None) -> Column:
    """A value to six places. The step up is at .53 and not at .5 of the last place: prices
    often lie at exact ties, where two engines that add in another order would part."""
    value = F.col(name) if value is None else value
    return (F.floor(value * 1e6 + 0.47) / F.lit(1e6)).alias(name)


def sql_rounded(name: str, value: str | None = None) -> str:
    return f"floor(({value or name}) * 1e6 + 0.47) / 1e6::DOUBLE AS {name}"


def panel_query(name: str, build: Callable, only: str | None = None, out: tuple[str, ...] = ("value",)) -> None:
    """A query of expressions over the daily panel; build(engine) gives an X or a dict of them."""

    def made(b) -> dict[str, X]:
        x = build(b)
        return x if isinstance(x, dict) else {"value": x}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = Engine(B.day_panel(spark, sf_dir, only))
        return b.frame(**made(b)).select("symbol", "bar_idx", *map(rounded, out))

    def text() -> str:
        b = Duck(P.day_panel(only))
        return b.query("symbol, bar_idx, " + ", ".join(map(sql_rounded, out)), **made(b))

    QUERIES[name], SQL[name] = run, text


def operands(b, arity: int) -> list[X]:
    """Close; close and volume; body of the bar, close and volume."""
    return {1: [b.close], 2: [b.close, b.volume], 3: [b.close - b.open, b.close, b.volume]}[arity]


#: Operators that flatten a price level take the bar's change instead.
CENTRED = ("SIGMOID", "TANH_SQUASH", "CLIP", "PRODUCT_5", "SIGN", "ABS", "SQRT", "SIGNED_LOG", "SIGNED_POWER_2", "POWER", "AND", "OR", "NEG", "COVARIANCE_10")


def _operator(op):
    def build(b):
        args = operands(b, op.arity)
        if op.name in CENTRED:
            args = [(b.close - b.open) / b.open, *args[1:]]
        return op.build(b, *args)

    return build


for _op in OPERATORS.values():
    panel_query(f"op_{_op.name}", _operator(_op))
for _n in ("CS_RANK", "CS_SCALE", "CS_NEUTRALIZE"):
    panel_query(f"op_{_n}_n1", _operator(OPERATORS[_n]), only="A")


def _feature(f):
    return lambda b: {"raw": f.build(b, False), "value": f.build(b, True)}


for _f in FEATURES.values():
    panel_query(f"feat_{_f.name}", _feature(_f), out=("raw", "value"))


def pnl_of(b) -> dict[str, X]:
    return reports.profit(b, reports.slice_factor(b))


def report_query(name: str, rep: reports.Report, only: str | None = None) -> None:
    """A report over the profit of the standard factor."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = Engine(B.day_panel(spark, sf_dir, only))
        return rep.run(spark, b.frame(**pnl_of(b)))

    def text() -> str:
        b = Duck(P.day_panel(only))
        with_ = f"WITH {b.ctes(**pnl_of(b))}"
        return f"{with_}, {rep.ctes} {rep.select}".replace(",  SELECT", " SELECT").replace("{pnl}", "out")

    QUERIES[name], SQL[name] = run, text


for _r in reports.REPORTS.values():
    report_query(_r.name, _r)


def score_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation score of every walk-forward fold; the profit is found once."""
    b = Engine(B.day_panel(spark, sf_dir))
    pnl = stored(b.frame(**pnl_of(b)), "pnl")
    parts = [r.run(spark, pnl) for r in reports.FOLD_SLICES]
    return functools.reduce(DataFrame.unionByName, parts)


def _fold_sql() -> str:
    b = Duck(P.day_panel())
    each = " UNION ALL ".join(f"SELECT * FROM ({r.text('out')})" for r in reports.FOLD_SLICES)
    return f"WITH {b.ctes(**pnl_of(b))} {each}"


QUERIES["score_fold"], SQL["score_fold"] = score_fold, _fold_sql
for _n in ("score_components", "score_modes", "score_evaluate", "stat_slice"):
    report_query(f"{_n}_n1", reports.REPORTS[_n], only="A")


# ---- formulas and their normalisation


def _formula(text: str):
    def build(b):
        x = formulas.compiled(b, text.split())
        return {"factor": x, "value": formulas.normalised(b, x)}

    return build


for _n, _text in formulas.PUBLISHED.items():
    panel_query(f"formula_{_n}", _formula(_text), out=("factor", "value"))
panel_query("norm_cross", lambda b: formulas.normalised(b, B_ret(b)))
panel_query("norm_rolling", lambda b: formulas.normalised(b, B_ret(b)), only="A")
panel_query("norm_constant", lambda b: formulas.normalised(b, b.let(b.rmax(b.close * 0.0, 10))), only="A")


def formula_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of every step of a formula, in one pass."""
    b = Engine(B.day_panel(spark, sf_dir))
    df = b.frame(**_steps(b))
    kinds = ", ".join(f"'{i}', s{i}" for i in range(8))
    rows = df.selectExpr(f"stack(8, {kinds}) AS (step, v)").groupBy("step")
    return rows.agg(rounded("mean", F.avg("v")), rounded("std", F.stddev_pop("v")))


def _steps(b) -> dict[str, X]:
    names, stack, out = formulas.PUBLISHED["forex_v2"].split(), [], {}
    for i, name in enumerate(names):
        if name in FEATURES:
            x = b.let(FEATURES[name].build(b))
        else:
            arity = OPERATORS[name].arity
            args, stack = stack[len(stack) - arity :], stack[: len(stack) - arity]
            x = b.let(OPERATORS[name].build(b, *args))
        stack.append(x)
        out[f"s{i}"] = x
    return out


def _trace_sql() -> str:
    b = Duck(P.day_panel())
    each = " UNION ALL ".join(f"SELECT '{i}' AS step, {sql_rounded('mean', f'avg(s{i})')}, {sql_rounded('std', f'stddev_pop(s{i})')} FROM out" for i in range(8))
    return f"WITH {b.ctes(**_steps(b))} {each}"


QUERIES["formula_trace"], SQL["formula_trace"] = formula_trace, _trace_sql

# ---- evaluation of candidates


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the panel, found once however often a query reads them."""
    b = Engine(B.day_panel(spark, sf_dir))
    wide = b.frame(**evaluate.columns(b)).select("symbol", "bar_idx", "y", "bars", *[f"f_{n.lower()}" for n in evaluate.NAMES])
    return stored(wide, "evaluation")


def _candidate_ctes() -> str:
    b = Duck(P.day_panel())
    return f"{b.ctes(**evaluate.columns(b))}, {evaluate.candidates_sql()}"


def evaluation_query(rep: reports.Report) -> None:
    QUERIES[rep.name] = lambda spark, sf_dir: rep.run(spark, evaluate.candidates(_wide(spark, sf_dir)))
    more = f", {rep.ctes}" if rep.ctes else ""
    SQL[rep.name] = lambda: f"WITH {_candidate_ctes()}{more} {rep.select}".replace("{pnl}", "cand")


for _r in evaluate.EVALUATIONS.values():
    evaluation_query(_r)


def eval_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.information(_wide(spark, sf_dir)).select("name", rounded("ic"), rounded("rank_ic"), rounded("ir"))


def eval_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    return evaluate.mutual_information(evaluate.candidates(wide), evaluate.target(wide)).select("name", rounded("mi"))


def eval_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.correlations(_wide(spark, sf_dir)).select("one", "two", rounded("correlation"))


def _scores(spark: SparkSession, wide: DataFrame) -> DataFrame:
    cand = evaluate.candidates(wide)
    flat = evaluate.EVALUATIONS["eval_degenerate"].run(spark, cand).select("name", "degenerate")
    ranks = evaluate.information(wide).select("name", "rank_ic")
    return evaluate.scored(flat, ranks, evaluate.mutual_information(cand, evaluate.target(wide)))


def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, _wide(spark, sf_dir)).select("name", rounded("score"))


def _pruned(spark: SparkSession, wide: DataFrame) -> list[dict]:
    """Pairs of names meet on the driver, never bars."""
    scores = {r["name"]: r["score"] for r in _scores(spark, wide).collect()}
    pairs = {frozenset((r["one"], r["two"])): r["correlation"] for r in evaluate.correlations(wide).collect()}
    return evaluate.pruned(scores, pairs, evaluate.THRESHOLD)


PRUNED = "name string, score double, status string, pruned_in_favor_of string"


def eval_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pruned(spark, _wide(spark, sf_dir))
    return spark.createDataFrame([tuple(r.values()) for r in rows], PRUNED).withColumn("score", rounded("score"))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report on every candidate: measures, score, whether it stays and what leaving it out
    would cost, and its place in the short list."""
    wide = _wide(spark, sf_dir)
    cand, rows = evaluate.candidates(wide), _pruned(spark, wide)
    top = evaluate.active_subset(rows, most=evaluate.TOP)
    listed = spark.createDataFrame([(*r.values(), top.index(r["name"]) + 1 if r["name"] in top else None) for r in rows], f"{PRUNED}, place int")
    out = listed.withColumn("score", rounded("score"))
    out = out.join(evaluate.information(wide).select("name", rounded("ic"), rounded("rank_ic"), rounded("ir")), "name", "left")
    out = out.join(evaluate.EVALUATIONS["eval_ablation"].run(spark, cand), "name", "left")
    mi = evaluate.mutual_information(cand, evaluate.target(wide)).select("name", rounded("mi"))
    return out.join(mi, "name", "left")


QUERIES |= {f.__name__: f for f in (eval_ic, eval_mutual_information, eval_correlations, eval_score, eval_prune, eval_report)}


def _evaluation_sql(select: str, *ctes: str) -> str:
    """SQL over the candidates; a recursion needs its keyword in front of all."""
    more = "".join(f", {c}" for c in ctes).replace("{pnl}", "cand")
    return f"WITH RECURSIVE {_candidate_ctes()}{more} {select}"


_TO_SCORE = (evaluate.mutual_information_sql(), evaluate.RANKED, evaluate.SCORED_SQL)
_TO_PRUNE = (*_TO_SCORE, evaluate.CORRELATIONS_SQL, evaluate.PRUNED_SQL)
SQL["eval_mutual_information"] = lambda: _evaluation_sql(f"SELECT name, {sql_rounded('mi')} FROM mi", evaluate.mutual_information_sql())
SQL["eval_correlations"] = lambda: _evaluation_sql(f"SELECT one, two, {sql_rounded('correlation')} FROM cr", evaluate.CORRELATIONS_SQL)
SQL["eval_score"] = lambda: _evaluation_sql(f"SELECT name, {sql_rounded('score')} FROM sc", *_TO_SCORE)
SQL["eval_prune"] = lambda: _evaluation_sql(f"SELECT name, {sql_rounded('score')}, status, pruned_in_favor_of FROM pr", *_TO_PRUNE)
_ABLATION = evaluate.EVALUATIONS["eval_ablation"]
SQL["eval_report"] = lambda: _evaluation_sql(
    f"""SELECT name, {sql_rounded("pr.score", "pr.score").replace("AS pr.score", "AS score")}, status, pruned_in_favor_of, CASE WHEN place <= {evaluate.TOP} THEN place::INTEGER END AS place,
    ic, rank_ic, ir, marginal, drop_it, {sql_rounded("mi")}
    FROM pr LEFT JOIN (SELECT name, row_number() OVER (ORDER BY coalesce(score, '-Infinity'::DOUBLE) DESC, name) AS place FROM pr WHERE status = 'retained') USING (name)
    LEFT JOIN (SELECT name, {reports.r6("ic", "ic")}, {reports.r6("rank_ic", "rank_ic")}, {reports.r6("ir", "ir")} FROM ev) USING (name)
    LEFT JOIN ({_ABLATION.select}) USING (name) LEFT JOIN mi USING (name)""",
    *_TO_PRUNE, _ABLATION.ctes,
)

# ---- raw bars: panels and checks

RAW = {"days": (B.lineitem_days, P.lineitem_days), "hours": (B.event_hours, P.event_hours), "weeks": (B.order_weeks, P.order_weeks)}
BAR = "symbol, time, open, high, low, close, volume"


def raw_query(name: str, source: str, run: Callable, select: str, ctes: str = "") -> None:
    frame, text = RAW[source]
    QUERIES[name] = lambda spark, sf_dir: run(frame(spark, sf_dir))
    SQL[name] = lambda: f"WITH {text()}{', ' + ctes if ctes else ''} {select}"


for _s in RAW:
    raw_query(f"panel_bars_{_s}", _s, lambda bars: bars.select(*B.COLUMNS), f"SELECT {BAR} FROM raw")
    raw_query(f"panel_aligned_{_s}", _s, B.aligned, f"SELECT symbol, bar_idx, {BAR[8:]} FROM bars", P.ALIGNED)
raw_query("panel_filled", "hours", B.filled, "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_idx, time, open, high, low, close, volume FROM ff", P.FILLED)
raw_query("panel_min_bars", "weeks", lambda bars: B.enough(bars, 345), f"SELECT {BAR} FROM raw WHERE symbol IN (SELECT symbol FROM raw GROUP BY symbol HAVING count(*) >= 345)")
raw_query(
    "panel_appended", "days",
    lambda bars: B.appended(bars.filter("time < 800000000"), bars),
    f"SELECT {BAR} FROM raw WHERE time < 800000000 UNION ALL SELECT {BAR} FROM raw r WHERE time > (SELECT coalesce(max(time), -1) FROM raw m WHERE m.time < 800000000 AND m.symbol = r.symbol)",
)
raw_query("panel_continuous", "days", lambda bars: B.continuous(bars, "ALL"), "SELECT 'ALL' AS symbol, time, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY time ORDER BY volume DESC, symbol) AS n FROM raw) WHERE n = 1")
for _k, _o in (("first", "symbol"), ("last", "symbol DESC"), ("max_volume", "volume DESC, symbol")):
    raw_query(
        f"panel_dedup_{_k}", "days",
        lambda bars, k=_k: B.deduplicated(bars.withColumns({"ingest": F.col("symbol"), "symbol": F.lit("ALL")}), k).select(*B.COLUMNS),
        f"SELECT 'ALL' AS symbol, time, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY time ORDER BY {_o}) AS n FROM raw) WHERE n = 1",
    )


def check_query(rep: reports.Report, source: str) -> None:
    frame, text = RAW[source]
    QUERIES[rep.name] = lambda spark, sf_dir: rep.run(spark, frame(spark, sf_dir))
    more = f", {rep.ctes}" if rep.ctes else ""
    SQL[rep.name] = lambda: f"WITH {text()}{more} {rep.select}".replace("{pnl}", "raw")


for _r in quality.CHECKS.values():
    check_query(_r, "hours" if _r.name == "dq_sessions" else "days")


#: Seconds between the slots of the time sets: the tables of these checks have daily bars.
STEP = 86_400
#: Of the query: symbols that share so many days with both of these.
CORE, ALIGNED = ["A", "N"], 2400


def _timesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timesets.packed(B.lineitem_days(spark, sf_dir), STEP)


def dq_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timesets.overlaps(_timesets(spark, sf_dir))


def dq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timesets.missing(stored(_timesets(spark, sf_dir), "time-sets"), STEP)


def dq_aligned_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that can join a core of two without losing more than a few of its bars."""
    return timesets.aligned_group(stored(_timesets(spark, sf_dir), "time-sets"), CORE, ALIGNED)


QUERIES |= {f.__name__: f for f in (dq_overlap, dq_missing, dq_aligned_group)}
SQL["dq_aligned_group"] = lambda: f"""WITH {P.lineitem_days()}, kn AS (SELECT time FROM raw WHERE symbol IN ('{"', '".join(CORE)}') GROUP BY time HAVING count(DISTINCT symbol) = {len(CORE)})
  SELECT symbol, count(DISTINCT time) AS common_times FROM raw WHERE time IN (SELECT time FROM kn) GROUP BY symbol HAVING count(DISTINCT time) >= {ALIGNED}"""


def dq_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of each symbol at each timeframe."""
    parts = [f(spark, sf_dir).select("symbol", F.lit(s).alias("tf")) for s, (f, _) in RAW.items()]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("symbol").pivot("tf", list(RAW)).count().na.fill(0)


QUERIES["dq_matrix"] = dq_matrix
SQL["dq_matrix"] = lambda: "WITH " + ", ".join(text().replace("raw AS", f"{s}_ AS") for s, (_, text) in RAW.items()) + " SELECT symbol, " + ", ".join(
    f"count(CASE WHEN tf = '{s}' THEN 1 END) AS {s}" for s in RAW
) + " FROM (" + " UNION ALL ".join(f"SELECT symbol, '{s}' AS tf FROM {s}_" for s in RAW) + ") GROUP BY symbol"

# ---- sizes, signals, monitoring, streams

for _r in risk.RISKS.values():
    report_query(_r.name, _r)
QUERIES["live_portfolio_sync"] = lambda spark, sf_dir: risk.SYNC.run(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"))
SQL["live_portfolio_sync"] = risk.SYNC.text("orders")


def stream_closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(spark, live.closed_bars(live.ticks(spark, sf_dir)), "closed-bars")


def stream_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(spark, live.flips(live.ticks(spark, sf_dir)), "flips")


QUERIES |= {"stream_closed_bars": stream_closed_bars, "stream_flips": stream_flips}
SQL["stream_closed_bars"] = (
    "WITH " + P.bars("event_type", "epoch(date_trunc('day', ts))", "value", "1", "row(ts, event_id)", "events")
    + f" SELECT {BAR} FROM raw WHERE time + 86400 <= (SELECT epoch(max(ts)) FROM events)"
)
SQL["stream_flips"] = """WITH d AS (SELECT event_type AS symbol, ts, event_id, CASE WHEN value >= 55 THEN 'LONG' WHEN value <= 45 THEN 'SHORT' ELSE 'FLAT' END AS dir FROM events),
  f AS (SELECT *, lag(dir) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS was FROM d) SELECT symbol, event_id, was, dir FROM f WHERE was <> dir"""

def live_next_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each symbol's forming daily bar closes, half a day after the last bar of any."""
    last = B.lineitem_days(spark, sf_dir).groupBy("symbol").agg(F.max("time").alias("last_open"))
    now = last.agg((F.max("last_open") + 129_600).alias("now"))
    return last.join(F.broadcast(now)).select("symbol", "last_open", times.next_close(F.col("last_open"), 86_400, F.col("now")).alias("next_close"))  # now is one row


def fn_time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = B.event_hours(spark, sf_dir).select("symbol", "time")
    local = times.text(F.col("time"), times.EAST)
    return bars.select("symbol", "time", times.text(F.col("time")).alias("utc"), local.alias("local"), times.parsed(local).alias("back"))


QUERIES |= {"live_next_close": live_next_close, "fn_time_text": fn_time_text}
SQL["live_next_close"] = lambda: f"""WITH {P.lineitem_days()}, la AS (SELECT symbol, max(time) AS t FROM raw GROUP BY symbol), nw AS (SELECT max(t) + 129600 AS now FROM la)
  SELECT symbol, t AS last_open, CASE WHEN t + 86400 > now THEN t + 86400 WHEN now - t - 86400 <= 172800 AND n - t - 86400 <= 172800 THEN n END AS next_close
  FROM (SELECT *, (SELECT min(t + 86400 * k) FROM range(2, 10) r(k) WHERE t + 86400 * k > now) AS n FROM la, nw)"""
SQL["fn_time_text"] = lambda: f"""WITH {P.event_hours()} SELECT symbol, time, strftime(make_timestamp(time * 1000000), '%Y-%m-%d %H:%M') AS utc,
  strftime(make_timestamp((time + 28800) * 1000000), '%Y-%m-%d %H:%M') AS local, time AS back FROM raw"""


def live_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Engine(B.day_panel(spark, sf_dir))
    return risk.reconciled(risk.WANTED.run(spark, b.frame(**pnl_of(b))))


def _reconcile_sql() -> str:
    b = Duck(P.day_panel())
    ctes = f"{b.ctes(**pnl_of(b))}, {risk.WANTED.ctes}".replace("{pnl}", "out")
    return f"WITH RECURSIVE {ctes}, {risk.reconciled_sql(risk.WANTED.select)} SELECT symbol, action FROM rr WHERE k > 0"


QUERIES["live_reconcile"], SQL["live_reconcile"] = live_reconcile, _reconcile_sql
URGENT = ("1-URGENT", "2-HIGH", "3-MEDIUM")
MARKETS = {"A": "XAUUSD", "N": "US30.cash"}
raw_query("panel_permitted", "weeks", lambda bars: B.permitted(bars, URGENT, ("2-HIGH",)).select(*B.COLUMNS), f"SELECT {BAR} FROM raw WHERE symbol IN {URGENT} AND symbol <> '2-HIGH'")
raw_query(
    "panel_costs", "days", lambda bars: B.with_costs(bars, MARKETS).select("symbol", "time", "market", "class", "cost"),
    """SELECT symbol, time, market, class, CASE class WHEN 'metals' THEN 0.0002::DOUBLE WHEN 'index' THEN 0.0003::DOUBLE ELSE 0.00015::DOUBLE END AS cost FROM
    (SELECT *, CASE WHEN market LIKE 'XAU%' OR market LIKE 'XAG%' THEN 'metals' WHEN market LIKE '%.cash%' OR market LIKE 'US%' OR market LIKE 'JP%' THEN 'index' ELSE 'forex' END AS class FROM
    (SELECT *, CASE symbol WHEN 'A' THEN 'XAUUSD' WHEN 'N' THEN 'US30.cash' ELSE symbol END AS market FROM raw))""",
)
raw_query(
    "live_new_bars", "hours", lambda bars: B.fresh(bars, bars.filter("time % 36000 = 0")).select(*B.COLUMNS),
    f"SELECT {BAR} FROM raw r WHERE time > (SELECT coalesce(max(time), -1) FROM raw m WHERE m.time % 36000 = 0 AND m.symbol = r.symbol)",
)


#: Seconds of a watched bar, between the polls of two tasks that share a symbol, and that bars serve again.
WATCH = 3600, (7200, 18_000), 5760


def live_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens at the close of each watched bar: direction, history, due polls, fetches."""
    return watch.events(spark, live.ticks(spark, sf_dir), *WATCH).withColumn("mean_close", rounded("mean_close"))


def _polls_sql() -> str:
    width, (one, two), keep = WATCH
    return f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, ts, event_id, value, floor(epoch(ts) / {width})::BIGINT * {width} AS time FROM events),
  b AS (SELECT symbol, time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM e GROUP BY symbol, time),
  c AS (SELECT *, CASE WHEN close >= 55 THEN 'LONG' WHEN close <= 45 THEN 'SHORT' ELSE 'FLAT' END AS direction, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k
    FROM b WHERE time + {width} <= (SELECT epoch(max(ts)) FROM events)),
  d AS (SELECT *, coalesce(lag(direction) OVER w <> direction, false) AS flipped, least(k, {live.HISTORY}) AS history, avg(close) OVER (w ROWS BETWEEN {live.HISTORY - 1} PRECEDING AND CURRENT ROW) AS mean_close
    FROM c WINDOW w AS (PARTITION BY symbol ORDER BY time)),
  p(symbol, k, due, fetched, one, two, got) AS (SELECT symbol, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, 0::BIGINT, -1000000000::BIGINT FROM c GROUP BY symbol
    UNION ALL SELECT symbol, k, (a + b)::BIGINT, f, CASE WHEN a = 1 THEN now + {one} ELSE one END, CASE WHEN b = 1 THEN now + {two} ELSE two END, CASE WHEN f THEN now ELSE got END
    FROM (SELECT *, a + b > 0 AND now - got >= {keep} AS f FROM (SELECT c.symbol, c.k, c.time + {width} AS now, one, two, got, CASE WHEN c.time + {width} >= one THEN 1 ELSE 0 END AS a,
      CASE WHEN c.time + {width} >= two THEN 1 ELSE 0 END AS b FROM p JOIN c ON c.symbol = p.symbol AND c.k = p.k + 1)))
  SELECT symbol, time, open, high, low, close, volume, direction, flipped, history, {sql_rounded("mean_close")}, due, fetched FROM d JOIN p USING (symbol, k)"""


QUERIES["live_polls"], SQL["live_polls"] = live_polls, _polls_sql

#: Strategies as artifacts name them: a published formula and the symbol that it is for.
STRATEGIES = [(text, "ANR"[i % 3]) for i, text in enumerate(formulas.PUBLISHED.values())]
SCANNED = """SELECT formula, symbol, n_bars, {annual}, {total}, {sharpe}, {drawdown}, CASE WHEN ann > 0 THEN 1 ELSE 0 END AS valid FROM ag"""


def _scan(table: str) -> str:
    """Figures of each strategy over (formula, symbol, bar_idx, pnl)."""
    along = "PARTITION BY formula, symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    picked = SCANNED.format(annual=reports.r6("ann", "annual"), total=reports.r6("total", "total_return"), sharpe=reports.r6("sharpe", "sharpe"), drawdown=reports.r6("mdd", "max_drawdown"))
    year = reports.n(reports.PPY)
    return f"""sq AS (SELECT *, sum(pnl) OVER ({along}) AS cum FROM {table}), sk AS (SELECT *, max(cum) OVER ({along}) - cum AS down FROM sq),
  ag AS (SELECT formula, symbol, count(*) AS n_bars, avg(pnl) * {year} AS ann, sum(pnl) AS total, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt({year}) AS sharpe, max(down) AS mdd FROM sk GROUP BY formula, symbol)
  {picked}"""


def _solo(b, symbol: str) -> dict[str, X]:
    """Profits of the strategies of one symbol, alone and at its class's cost."""
    cost = B.COSTS[{"A": "metals", "N": "index"}.get(symbol, "forex")]
    own = [i for i, (_, s) in enumerate(STRATEGIES) if s == symbol]
    return {f"p{i}": reports.profit(b, formulas.compiled(b, STRATEGIES[i][0].split()), cost)["pnl"] for i in own}


def _figures(rows: DataFrame) -> DataFrame:
    found = rows.sparkSession.sql(f"WITH {_scan('{long}')}", long=rows.withColumnRenamed("program", "formula"))
    return found.withColumnRenamed("formula", "program")


def scan_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy on its own symbol alone, all in one plan."""
    names = [(text, formulas.VOCABULARY.encode(text.split()), symbol, formulas.VOCABULARY.version) for text, symbol in STRATEGIES]
    own = spark.createDataFrame(names, "name string, formula array<int>, symbol string, vocab_version string")
    panel = B.indexed(B.lineitem_days(spark, sf_dir))
    panel = panel.join(B.with_costs(panel.select("symbol").distinct(), MARKETS).select("symbol", "cost"), "symbol")
    found = artifacts.scan(own, panel, _figures)
    return found.drop("formula").withColumnRenamed("name", "formula").select("formula", "symbol", "n_bars", "annual", "total_return", "sharpe", "max_drawdown", "valid")


def _scan_sql() -> str:
    each = []
    for symbol in sorted({s for _, s in STRATEGIES}):
        b = Duck(P.day_panel(symbol))
        cols = _solo(b, symbol)
        long = " UNION ALL ".join(f"SELECT symbol, bar_idx, '{STRATEGIES[int(c[1:])][0]}' AS formula, {c} AS pnl FROM out" for c in cols)
        each.append(f"SELECT * FROM (WITH {b.ctes(**cols)} {long})")
    return f"WITH lo AS ({' UNION ALL '.join(each)}), {_scan('lo')}"


QUERIES["scan_factors"], SQL["scan_factors"] = scan_factors, _scan_sql


def ensemble(b) -> dict[str, X]:
    """Two formulas whose squashed values are averaged."""
    one = b.let(formulas.compiled(b, "RET5 TS_ZSCORE_20".split()))
    two = b.let(formulas.compiled(b, "RSI14 DELTA".split()))
    mean = b.let((b.tanh(one) + b.tanh(two)) / 2.0)
    return {"value": b.where(b.abs(mean) < reports.DEAD_BAND, 0.0, mean)}


panel_query("live_ensemble", ensemble)

# ---- the second language

PREFIX = ("ADD RET5 MUL VOL_CHG TREND", "STD20 DELTA5 V_RET", "DIV MA20 RET ABS TREND", "SUB SIGN RET NEG TS_RANK20 RET5")
for _i, _text in enumerate(PREFIX):
    panel_query(f"prefix_{_i}", lambda b, t=_text: prefix.compiled(b, t.split()))

# ---- search


def search_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of a search, written once: batches and the levels of their plans read bars, not the ticks.
    The ticks are read once, as the alignment asks three times for the bars that are written first."""
    return stored(B.aligned(stored(B.lineitem_days(spark, sf_dir), "search-bars")), "search-panel")


def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.scores(Engine(search_panel(spark, sf_dir)), search.POOL)


def search_elite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.elite(search_scores(spark, sf_dir), 3)


def _resembling() -> list[int]:
    """Places of the pool's formulas that can run, but the candidate's own."""
    return [i for i, text in enumerate(search.POOL) if i and formulas.executable(text.split())]


def search_pool_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which formulas of the pool a candidate resembles too much, on the training bars."""
    b, others = Engine(search_panel(spark, sf_dir)), _resembling()
    wide = b.frame(**search.columns(b, search.POOL), bars=b.bars()).filter("bar_idx < floor(bars * 8e-1)")
    each = [F.abs(F.corr("x0", f"x{i}")).alias(f"x{i}") for i in others]
    kinds = ", ".join(f"'{search.POOL[i]}', x{i}" for i in others)
    long = wide.agg(*each).selectExpr(f"stack({len(others)}, {kinds}) AS (formula, c)")
    return long.select("formula", rounded("correlation", F.col("c")), F.when(F.col("c") > 0.85, 0.8).otherwise(1.0).alias("factor"))


def _pool_sql() -> str:
    b = Duck(P.day_panel())
    cols = {**search.columns(b, search.POOL), "bars": b.bars()}
    ctes = b.ctes(**cols)
    each = " UNION ALL ".join(f"SELECT '{search.POOL[i]}' AS formula, abs(corr(x0, x{i})) AS c FROM out WHERE bar_idx < floor(bars * 0.8)" for i in _resembling())
    return f"WITH {ctes}, pc AS ({each}) SELECT formula, {sql_rounded('correlation', 'c')}, CASE WHEN c > 0.85 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM pc"


def search_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool after several batches of sampled formulas, each scored in one job."""
    panel = search_panel(spark, sf_dir)
    return search.looped(lambda: Engine(panel), search.batches())


#: Members of the pool of the query, few enough that batches push each other out.
POOL_SIZE = 5
#: Rounds and programs of the learning search of the query.
EVOLVED = 3, 5


def search_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor pool after several batches, each held to the members that it met."""
    kept, panel = pool.FactorPool(spark, shared_path(spark, "factor-pool"), POOL_SIZE), search_panel(spark, sf_dir)
    for batch in search.batches():
        b = Engine(panel)
        wide = stored(b.frame(**search.columns(b, batch), bars=b.bars()), "search-batch")
        place = spark.createDataFrame([(f, f"x{i}") for i, f in enumerate(batch)], "formula string, column string")
        good = search.scored(wide, batch).filter("status = 'ok'").join(place, "formula")
        kept.update(wide.filter("bar_idx < floor(bars * 8e-1)"), good)
    return kept.members().select("formula", "round", "raw", rounded("score"))


def search_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every formula of a learning search, by round, with what the pool left of its score."""
    panel = search_panel(spark, sf_dir)
    run = evolve.Search(spark, shared_path(spark, "search"), lambda: Engine(panel))
    return run.run(*EVOLVED)


QUERIES |= {"search_pool": search_pool, "search_evolved": search_evolved}
SQL["search_pool"] = lambda: f"SELECT formula, round::INTEGER AS round, raw, {sql_rounded('score')} FROM ({pool.members_sql(Duck(P.day_panel()), search.batches(), POOL_SIZE)})"
QUERIES["search_loop"] = search_loop
SQL["search_loop"] = lambda: f"SELECT formula, status, score FROM ({search.scores_sql(Duck(P.day_panel()), [t for batch in search.batches() for t in batch])}) WHERE status = 'ok' ORDER BY score DESC, formula LIMIT {search.ELITE}"
QUERIES["search_pool_penalty"], SQL["search_pool_penalty"] = search_pool_penalty, _pool_sql
QUERIES |= {"search_scores": search_scores, "search_elite": search_elite}
SQL["search_scores"] = lambda: search.scores_sql(Duck(P.day_panel()), search.POOL)
SQL["search_elite"] = lambda: f"SELECT formula, status, score FROM ({search.scores_sql(Duck(P.day_panel()), search.POOL)}) WHERE status = 'ok' ORDER BY score DESC, formula LIMIT 3"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {n: s if isinstance(s, str) else s() for n, s in SQL.items()}
