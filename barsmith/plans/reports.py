"""Positions, profit, statistics, trades and scores of a factor.

`profit` turns a factor into the per-bar table `pnl` (symbol, bar_idx, time, open, factor,
target, position, turnover, pnl). Everything else is SQL over it: one aggregation for each
symbol, or window functions along (symbol, bar_idx), which Spark runs on the exchange that
the panel already has. `Report` holds such a text; `run` applies it to a DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from barsmith.functions.algebra import BLOCK_BARS, X
from barsmith.functions.features import ret
from barsmith.operators.formula_ops import OPERATORS

COST = 0.0003
DEAD_BAND = 0.05
PPY = 252.0


def profit(b, factor: X, cost: float = COST, band: float = DEAD_BAND) -> dict[str, X]:
    """Columns of `pnl`: the target is the log return from the next open to the one after it, a
    position is the squashed factor outside the dead band, and turnover costs."""
    factor = b.plain(factor)
    one, two = b.lead(b.open, 1), b.lead(b.open, 2)
    target = b.let(b.ln(two / one))  # 0 for the last two bars, which have no second open
    raw = b.tanh(factor)
    position = b.let(_column(b.where(b.abs(raw) < band, 0.0, raw)))
    turnover = b.let(b.abs(position - b.lag(position, 1)))
    return {"factor": factor, "target": target, "position": position, "turnover": turnover, "pnl": position * target - turnover * cost}


def _column(x: X) -> X:
    return replace(x, win=True)


def slice_factor(b) -> X:
    """The factor of the standard reports: 20-bar z-score of the 5-bar return."""
    return OPERATORS["TS_ZSCORE_20"].build(b, ret(b, 5))


@dataclass(frozen=True)
class Report:
    name: str
    select: str
    ctes: str = ""

    def text(self, table: str) -> str:
        with_ = f"WITH {self.ctes} " if self.ctes else ""
        return (with_ + self.select).replace("{pnl}", table)

    def run(self, spark: SparkSession, pnl: DataFrame) -> DataFrame:
        return spark.sql(self.text("{pnl}"), pnl=pnl)


REPORTS: dict[str, Report] = {}


def report(name: str, select: str, ctes: str = "") -> None:
    REPORTS[name] = Report(name, select, ctes)


def r6(expr: str, name: str) -> str:
    return f"floor(({expr}) * 1e6 + 4.7e-1) / 1e6 AS {name}"


def n(v: float) -> str:
    """A double literal in either dialect."""
    return format(v, ".17e")


YEAR = n(365.25 * 86400)
ALONG = "PARTITION BY symbol ORDER BY bar_idx"
SO_FAR = f"{ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
LOSS = "stddev_pop(CASE WHEN pnl < 0 THEN pnl END)"


def clip(expr: str, low: float, high: float) -> str:
    return f"greatest(least({expr}, {n(high)}), {n(low)})"


def sortino1(x: str = "pnl", ppy: str = n(PPY), bound: float = 20.0) -> str:
    """Downside deviation no less than a fifth of the deviation."""
    full = f"greatest(stddev_pop({x}), 1e-8)"
    down = f"greatest(coalesce(stddev_pop(CASE WHEN {x} < 0 THEN {x} END), 0e0), greatest({full} * 2e-1, 1e-8))"
    return clip(f"avg({x}) / {down} * sqrt({ppy})", -bound, bound)


# ---- statistics for each symbol

report(
    "stat_slice",
    f"""SELECT symbol, count(*) AS n_bars, {r6("sum(pnl)", "total_return")},
    {r6(f"CASE WHEN stddev_pop(pnl) < 1e-10 THEN 0e0 ELSE avg(pnl) / stddev_pop(pnl) * sqrt({n(PPY)}) END", "sharpe")} FROM {{pnl}} GROUP BY symbol""",
)
PPY_CTE = f"""years AS (SELECT symbol, least(greatest(round(count(*) / ((max(time) - min(time)) / {YEAR})), 1e1), 6e5) AS ppy
  FROM {{pnl}} GROUP BY symbol HAVING max(time) > min(time))"""
report("stat_bars_per_year", "SELECT symbol, cast(ppy AS bigint) AS ppy, cast((SELECT max(ppy) FROM yr WHERE place = floor(n_years / 2e0) + 1) AS bigint) AS median_ppy FROM years", PPY_CTE + ", yr AS (SELECT ppy, row_number() OVER (ORDER BY ppy, symbol) AS place, count(*) OVER (PARTITION BY 1) AS n_years FROM years)")
report("stat_annual_return", f"SELECT symbol, {r6(f'avg(pnl) * {n(PPY)}', 'annual')}, {r6('sum(pnl) / (count(*) / 6.24e3)', 'annual_alt')} FROM {{pnl}} GROUP BY symbol")
report(
    "stat_sharpe",
    f"""SELECT symbol, {r6(f"CASE WHEN stddev_pop(pnl) < 1e-10 THEN 0e0 ELSE avg(pnl) / stddev_pop(pnl) * sqrt({n(PPY)}) END", "plain")},
    {r6(f"avg(pnl) / (stddev_pop(pnl) + 1e-10) * sqrt({n(PPY)})", "eps10")}, {r6(f"avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt({n(PPY)})", "eps8")} FROM {{pnl}} GROUP BY symbol""",
)


def _ratio(floor: str) -> str:
    return f"avg(pnl) / greatest(coalesce({LOSS}, 0e0), {floor}) * sqrt({n(PPY)})"


report(
    "stat_sortino",
    f"""SELECT symbol, {r6(sortino1(), "training")},
    {r6(f"CASE WHEN count(CASE WHEN pnl < 0 THEN 1 END) = 0 THEN 0e0 ELSE {clip(_ratio('greatest(abs(avg(pnl)), 1e-8)'), -20, 20)} END", "trades")},
    {r6(_ratio("greatest(abs(avg(pnl)), 1e-10)"), "report")}, {r6(_ratio("greatest(2e-1 * stddev_pop(pnl), 1e-8)"), "audit")},
    {r6(_ratio("greatest(2e-1 * abs(avg(pnl)), 1e-10)"), "metals")} FROM {{pnl}} GROUP BY symbol""",
)
EQUITY = f"eq AS (SELECT symbol, bar_idx, time, pnl, sum(pnl) OVER ({SO_FAR}) AS cum FROM {{pnl}}), dd AS (SELECT *, max(cum) OVER ({SO_FAR}) - cum AS down FROM eq)"
report(
    "stat_drawdown",
    f"""SELECT symbol, {r6("max(down)", "max_drawdown")}, {r6(clip(f"avg(pnl) * {n(PPY)} / greatest(max(down), 1e-8)", -10, 10), "calmar")},
    {r6(f"CASE WHEN max(down) > 0 THEN avg(pnl) * {n(PPY)} / max(down) ELSE 0e0 END", "calmar_plain")},
    {r6(f"avg(pnl) * {n(PPY)} / (max(down) + 1e-10)", "calmar_eps")} FROM dd GROUP BY symbol""",
    EQUITY,
)


def flattened(table: str) -> str:
    """fd: the rows of a table with `down`, the drawdown of the path that runs through one symbol
    after the other. Running sums stay within a symbol; offsets and earlier peaks come from one
    row for each symbol, so no task orders all bars."""
    earlier = "ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""fl AS (SELECT *, sum(pnl) OVER ({SO_FAR}) AS own FROM {table}),
  ft AS (SELECT symbol, sum(pnl) AS total, max(own) AS top FROM fl GROUP BY symbol),
  fo AS (SELECT symbol, top, coalesce(sum(total) OVER ({earlier}), 0e0) AS base FROM ft),
  fp AS (SELECT symbol AS p_symbol, base, max(base + top) OVER ({earlier}) AS peak FROM fo),
  fd AS (SELECT fl.*, greatest(max(own) OVER ({SO_FAR}) + base, peak) - (base + own) AS down FROM fl JOIN fp ON symbol = p_symbol)"""


report("stat_flattened", f"SELECT count(*) AS n, {r6(sortino1(), 'sortino')}, {r6(clip(f'avg(pnl) * {n(PPY)} / greatest(max(down), 1e-8)', -10, 10), 'calmar')} FROM fd", flattened("{pnl}"))
def path(table: str) -> str:
    """pk: the rows of a table (bar_idx, p) with the running sum `cum`, its peak so far, the drawdown `down` and
    the number of all bars. Blocks of bars are summed up on their own; only a row a block goes through a
    window without a partition."""
    earlier, here = "ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "PARTITION BY blk ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""p0 AS (SELECT *, floor(bar_idx / {BLOCK_BARS}e0) AS blk FROM {table}),
  p1 AS (SELECT *, sum(p) OVER ({here}) AS own FROM p0),
  p2 AS (SELECT blk, sum(p) AS total, max(own) AS top, count(*) AS n FROM p1 GROUP BY blk),
  p3 AS (SELECT blk, top, coalesce(sum(total) OVER ({earlier}), 0e0) AS base, sum(n) OVER (PARTITION BY 1) AS bars FROM p2),
  p4 AS (SELECT blk AS p_blk, base, bars, max(base + top) OVER ({earlier}) AS top FROM p3),
  p5 AS (SELECT p1.*, base + own AS cum, greatest(max(own) OVER ({here}) + base, top) AS peak, bars FROM p1 JOIN p4 ON blk = p_blk),
  pk AS (SELECT *, peak - cum AS down FROM p5)"""


report(
    "stat_portfolio",
    f"""SELECT count(*) AS n_bars, {r6("sum(p)", "total_return")}, {r6(f"avg(p) / stddev_pop(p) * sqrt({n(PPY)})", "sharpe")}, {r6("max(peak - cum)", "max_drawdown")} FROM pk""",
    "pf AS (SELECT bar_idx, avg(pnl) AS p FROM {pnl} GROUP BY bar_idx), " + path("pf"),
)
report(
    "stat_tail_portfolio",
    f"SELECT cast(back AS bigint) AS back, {r6('avg(pnl)', 'pnl')} FROM tl WHERE back <= (SELECT min(bars) FROM tl) GROUP BY back",
    "tl AS (SELECT symbol, pnl, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) AS back, count(*) OVER (PARTITION BY symbol) AS bars FROM {pnl})",
)
IC = f"""nx AS (SELECT symbol, factor, lead(target) OVER ({ALONG}) AS y FROM {{pnl}}),
  ic AS (SELECT symbol, covar_pop(factor, y) / (stddev_pop(factor) * stddev_pop(y) + 1e-8) AS ic FROM nx WHERE y IS NOT NULL
    GROUP BY symbol HAVING count(*) >= 9 AND stddev_pop(factor) >= 1e-6 AND stddev_pop(y) >= 1e-6)"""
report("stat_ic", f"SELECT symbol, {r6('ic', 'ic')} FROM ic", IC)
report(
    "stat_ic_stability",
    f"""SELECT count(*) AS n_symbols, {r6("coalesce(avg(ic), 0e0)", "ic_mean")}, {r6("CASE WHEN count(*) >= 2 THEN avg(ic) / (stddev_pop(ic) + 1e-6) ELSE 0e0 END", "ic_stability")},
    {r6(clip("coalesce(avg(ic) / (stddev_pop(ic) + 1e-6), 0e0)", -3, 3), "stability_clipped")},
    CASE WHEN avg(ic) > 1e-2 THEN 1.15e0 WHEN avg(ic) < -1e-2 THEN 7.5e-1 ELSE 1e0 END AS gate FROM ic""",
    IC,
)
report(
    "stat_trade_estimate",
    "SELECT symbol, count(CASE WHEN abs(a - before) > 1e-1 THEN 1 END) AS n_trades, count(CASE WHEN abs(position - was) > 5e-1 THEN 1 END) AS n_flips FROM ch GROUP BY symbol",
    f"ch AS (SELECT symbol, position, abs(position) AS a, lag(abs(position)) OVER ({ALONG}) AS before, lag(position) OVER ({ALONG}) AS was FROM {{pnl}})",
)
report("stat_cost_stress", f"SELECT {r6(sortino1('s', bound=5.0), 'stressed')} FROM st", f"st AS (SELECT position * target - turnover * {n(2 * COST)} AS s FROM {{pnl}})")
report(
    "stat_cost_sweep",
    f"SELECT symbol, times, {r6('sum(s)', 'total_return')}, {r6(f'avg(s) / (stddev_pop(s) + 1e-8) * sqrt({n(PPY)})', 'sharpe')} FROM st GROUP BY symbol, times",
    f"""tm AS (SELECT 1 AS times UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 5),
    st AS (SELECT symbol, times, position * target - turnover * {n(COST)} * times AS s FROM {{pnl}}, tm)""",
)
ROLL = "PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 499 PRECEDING AND CURRENT ROW"
#: A series shorter than the window has the one value of its last bar.
ROLLING = f"CASE WHEN bar_idx >= least(500, bars) - 1 THEN CASE WHEN s < 1e-12 THEN 0e0 ELSE {clip(f'm / greatest(s, 1e-12) * sqrt({n(PPY)})', -20, 20)} END END"
report(
    "stat_rolling_sharpe",
    f"""SELECT symbol, bar_idx, {r6(ROLLING, "rolling_sharpe")} FROM ro""",
    f"ro AS (SELECT symbol, bar_idx, avg(pnl) OVER ({ROLL}) AS m, stddev_pop(pnl) OVER ({ROLL}) AS s, count(*) OVER (PARTITION BY symbol) AS bars FROM {{pnl}})",
)
ISLES = f"""ds AS (SELECT *, CASE WHEN position >= {n(DEAD_BAND)} THEN 1 WHEN position <= {n(-DEAD_BAND)} THEN -1 ELSE 0 END AS dir FROM {{pnl}}),
  dm AS (SELECT *, CASE WHEN lag(dir) OVER ({ALONG}) = dir THEN 0 ELSE 1 END AS fresh,
    coalesce(lead(time) OVER ({ALONG}), time) AS exec_time, coalesce(lead(open) OVER ({ALONG}), open) AS exec_price,
    max(bar_idx) OVER (PARTITION BY symbol) AS last_bar FROM ds),
  di AS (SELECT *, sum(fresh) OVER ({SO_FAR}) AS isle FROM dm),
  ig AS (SELECT symbol, isle, min(dir) AS direction, min(bar_idx) AS entry_bar, max(bar_idx) AS end_bar, min(last_bar) AS last_bar, sum(pnl) AS pnl FROM di GROUP BY symbol, isle),
  ix AS (SELECT *, CASE WHEN end_bar = last_bar THEN last_bar ELSE end_bar + 1 END AS exit_bar FROM ig WHERE direction <> 0),
  tr AS (SELECT ix.symbol, direction, entry_bar, a.exec_time AS entry_time, a.exec_price AS entry_price, exit_bar, z.exec_time AS exit_time, z.exec_price AS exit_price, ix.pnl,
    sum(ix.pnl) OVER (PARTITION BY ix.symbol ORDER BY entry_bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pnl
    FROM ix JOIN di a ON a.symbol = ix.symbol AND a.bar_idx = ix.entry_bar JOIN di z ON z.symbol = ix.symbol AND z.bar_idx = ix.exit_bar)"""
report(
    "trade_list",
    f"SELECT symbol, direction, entry_bar, entry_time, {r6('entry_price', 'entry_price')}, exit_bar, exit_time, {r6('exit_price', 'exit_price')}, {r6('pnl', 'pnl')}, {r6('cum_pnl', 'cum_pnl')} FROM tr",
    ISLES,
)
report(
    "trade_summary",
    f"""SELECT symbol, count(*) AS n_trades, {r6("count(CASE WHEN pnl > 0 THEN 1 END) / (count(*) * 1e0)", "win_rate")}, {r6("avg((exit_bar - entry_bar) * 1e0)", "avg_hold")},
    {r6("avg(CASE WHEN pnl > 0 THEN pnl END) / avg(CASE WHEN pnl < 0 THEN -pnl END)", "profit_loss_ratio")}, 0e0 AS max_drawdown FROM tr GROUP BY symbol""",
    ISLES,
)
report(
    "trade_top5",
    f"SELECT symbol, side, cast(place AS bigint) AS place, entry_bar, {r6('pnl', 'pnl')} FROM rk WHERE place <= 5",
    ISLES
    + """, rk AS (SELECT symbol, entry_bar, pnl, 'win' AS side, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, entry_bar) AS place FROM tr WHERE pnl > 0
    UNION ALL SELECT symbol, entry_bar, pnl, 'loss' AS side, row_number() OVER (PARTITION BY symbol ORDER BY pnl, entry_bar) AS place FROM tr WHERE pnl < 0)""",
)
report(
    "trade_profile",
    f"""SELECT symbol, {r6("sum(CASE WHEN pnl > 0 THEN pnl ELSE 0e0 END) / greatest(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0e0 END), 1e-10)", "profit_factor")},
    {r6("max(pnl)", "max_win")}, {r6("min(pnl)", "max_loss")}, count(CASE WHEN d > 0 THEN 1 END) AS n_long, count(CASE WHEN d < 0 THEN 1 END) AS n_short, count(CASE WHEN d = 0 THEN 1 END) AS n_flat FROM sg GROUP BY symbol""",
    f"""pc AS (SELECT *, CASE WHEN abs(position - lag(position) OVER ({ALONG})) > 1e-2 OR bar_idx = 0 THEN 1 ELSE 0 END AS moved FROM {{pnl}}),
    pi AS (SELECT *, sum(moved) OVER ({SO_FAR}) AS seg FROM pc),
    sg AS (SELECT symbol, seg, sum(pnl) AS pnl, sign(avg(position)) AS d FROM pi GROUP BY symbol, seg)""",
)
report(
    "stat_streaks",
    "SELECT symbol, coalesce(max(CASE WHEN bad = 1 THEN bars END), 0) AS max_consecutive_losses FROM sk GROUP BY symbol",
    f"""fl AS (SELECT symbol, bar_idx, CASE WHEN pnl < 0 THEN 1 ELSE 0 END AS bad FROM {{pnl}}),
    fm AS (SELECT *, CASE WHEN lag(bad) OVER ({ALONG}) = bad THEN 0 ELSE 1 END AS fresh FROM fl),
    fi AS (SELECT *, sum(fresh) OVER ({SO_FAR}) AS isle FROM fm),
    sk AS (SELECT symbol, isle, max(bad) AS bad, count(*) AS bars FROM fi GROUP BY symbol, isle)""",
)
report("stat_hold_runs", f"SELECT symbol, count(*) AS n_runs, {r6('avg((end_bar - entry_bar + 1) * 1e0)', 'avg_run')} FROM ix GROUP BY symbol", ISLES)
for _k, _name in ((2, "halves"), (3, "thirds"), (8, "eighths")):
    report(
        f"stat_{_name}",
        f"SELECT symbol, part, count(*) AS n_bars, {r6('sum(pnl)', 'total_return')}, {r6(f'avg(pnl) / (stddev_pop(pnl) + 1e-10) * sqrt({n(PPY)})', 'sharpe')} FROM pt GROUP BY symbol, part",
        f"sz AS (SELECT *, floor(count(*) OVER (PARTITION BY symbol) / {n(_k)}) AS size FROM {{pnl}}), pt AS (SELECT symbol, pnl, cast(least(floor(bar_idx / size), {_k - 1}e0) AS bigint) AS part FROM sz)",
    )
report("stat_yearly", f"SELECT symbol, cast(floor(bar_idx / 6.24e3) AS bigint) AS block, count(*) AS n_bars, {r6('sum(pnl)', 'total_return')} FROM {{pnl}} GROUP BY symbol, cast(floor(bar_idx / 6.24e3) AS bigint)")
DAILY = """dl AS (SELECT symbol, cast(floor(bar_idx / 2.4e1) AS bigint) AS day, sum(pnl) AS pnl, count(*) AS bars, max(abs(position)) AS held FROM {pnl} GROUP BY symbol, cast(floor(bar_idx / 2.4e1) AS bigint)),
  df AS (SELECT * FROM dl WHERE bars = 24)"""
report("stat_daily", f"SELECT symbol, day, {r6('pnl', 'pnl')} FROM df", DAILY)
report(
    "stat_prop_firm",
    f"""SELECT symbol, scale, {r6("min(p)", "max_daily_loss")}, count(CASE WHEN held > 0 THEN 1 END) AS trading_days,
    min(CASE WHEN cum >= 1e-1 THEN day END) AS target_day, count(CASE WHEN peak - cum > 1e-1 THEN 1 END) AS violations FROM pk GROUP BY symbol, scale""",
    DAILY
    + """, sc AS (SELECT 5e-1 AS scale UNION ALL SELECT 1e0 UNION ALL SELECT 2e0 UNION ALL SELECT 3e0),
    ps AS (SELECT symbol, scale, day, held, pnl * scale AS p FROM df, sc),
    pu AS (SELECT *, sum(p) OVER (PARTITION BY symbol, scale ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ps),
    pk AS (SELECT *, greatest(max(cum) OVER (PARTITION BY symbol, scale ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0) AS peak FROM pu)""",
)
PORT = f"pf AS (SELECT bar_idx, avg(pnl) AS p, avg(position * target - turnover * {n(2 * COST)}) AS p2 FROM {{pnl}} GROUP BY bar_idx), " + path("pf")
report(
    "stat_verdict",
    """SELECT CASE WHEN low_return = 1 OR deep = 2 THEN 'INVALID' WHEN low_sharpe + least(deep, 1) + one_sided + halves_differ + folds_lose + cost_loses > 0 THEN 'SUSPICIOUS' ELSE 'VALID' END AS verdict,
    low_return, low_sharpe, deep, one_sided, halves_differ, folds_lose, cost_loses FROM vd""",
    PORT
    + f""", sd AS (SELECT greatest(avg(CASE WHEN position > {n(DEAD_BAND)} THEN 1e0 ELSE 0e0 END), avg(CASE WHEN position < {n(-DEAD_BAND)} THEN 1e0 ELSE 0e0 END)) AS side FROM {{pnl}}),
    wf AS (SELECT floor(bar_idx / floor(bars / 4e0)) AS fold, avg(p) AS m FROM pk WHERE bar_idx >= floor(bars / 4e0) AND bar_idx < 4 * floor(bars / 4e0) GROUP BY floor(bar_idx / floor(bars / 4e0))),
    wc AS (SELECT CASE WHEN sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) < count(*) * 5e-1 THEN 1 ELSE 0 END AS folds_lose FROM wf),
    vd AS (SELECT CASE WHEN avg(p) * {n(PPY)} < 2e-2 THEN 1 ELSE 0 END AS low_return,
      CASE WHEN avg(p) / (stddev_pop(p) + 1e-8) * sqrt({n(PPY)}) < 5e-1 THEN 1 ELSE 0 END AS low_sharpe,
      CASE WHEN max(down) > 2e-1 THEN 2 WHEN max(down) > 1e-1 THEN 1 ELSE 0 END AS deep, max(CASE WHEN side > 8.5e-1 THEN 1 ELSE 0 END) AS one_sided,
      CASE WHEN avg(CASE WHEN bar_idx < floor(bars / 2e0) THEN p END) * avg(CASE WHEN bar_idx >= floor(bars / 2e0) THEN p END) < 0 THEN 1 ELSE 0 END AS halves_differ,
      max(folds_lose) AS folds_lose, CASE WHEN avg(p2) > 0 THEN 0 ELSE 1 END AS cost_loses FROM pk, sd, wc)""",
)
report(
    "stat_reversals",
    "SELECT symbol, count(CASE WHEN dir <> was THEN 1 END) AS n_reversals FROM rv GROUP BY symbol",
    f"rd AS (SELECT symbol, bar_idx, sign(position) AS dir FROM {{pnl}} WHERE position <> 0), rv AS (SELECT *, lag(dir) OVER ({ALONG}) AS was FROM rd)",
)
report("stat_positive_symbols", "SELECT count(*) AS n_symbols, count(CASE WHEN total > 0 THEN 1 END) AS n_positive FROM sp", "sp AS (SELECT symbol, sum(pnl) AS total FROM {pnl} GROUP BY symbol)")
MOST_POINTS = 1500
#: Bars j * (T - 1) / 1499, rounded down, of every symbol and of the portfolio; all bars of shorter series.
report(
    "stat_equity_export",
    f"""SELECT series, bar_idx, {r6("cum", "equity")}, {r6(ROLLING, "rolling_sharpe")} FROM sl
    WHERE bars <= {MOST_POINTS} OR bar_idx = bars - 1 OR bar_idx = floor(ceil(bar_idx / step) * step) OR bar_idx = floor((ceil(bar_idx / step) + 1) * step) OR bar_idx = floor((ceil(bar_idx / step) - 1) * step)""",
    f"""al AS (SELECT symbol AS series, bar_idx, pnl FROM {{pnl}} UNION ALL SELECT 'portfolio' AS series, bar_idx, avg(pnl) AS pnl FROM {{pnl}} GROUP BY bar_idx),
    sl AS (SELECT series, bar_idx, sum(pnl) OVER ({SO_FAR.replace("symbol", "series")}) AS cum, avg(pnl) OVER ({ROLL.replace("symbol", "series")}) AS m, stddev_pop(pnl) OVER ({ROLL.replace("symbol", "series")}) AS s,
      count(*) OVER (PARTITION BY series) AS bars, (count(*) OVER (PARTITION BY series) - 1) / 1.499e3 AS step FROM al)""",
)
report(
    "trade_actions",
    "SELECT symbol, bar_idx, CASE WHEN was = dir THEN 'HOLD' WHEN was = 0 THEN CASE WHEN dir > 0 THEN 'OPEN_LONG' ELSE 'OPEN_SHORT' END WHEN dir = 0 THEN 'CLOSE' WHEN dir > 0 THEN 'REVERSE_TO_LONG' ELSE 'REVERSE_TO_SHORT' END AS action FROM ac",
    ISLES.split(",\n  dm")[0] + f", ac AS (SELECT symbol, bar_idx, dir, coalesce(lag(dir) OVER ({ALONG}), 0) AS was FROM ds)",
)

# ---- scores

def turnover_quality(table: str, least: str = "1") -> str:
    """tq: one row with `quality`. A run is a stretch of one whole position; a position counts as whole from `least`
    on either side. One run in twelve bars is best, and long runs get a little on top."""
    return f"""tz AS (SELECT symbol, bar_idx, CASE WHEN position >= {least} THEN 1 WHEN position <= -{least} THEN -1 ELSE 0 END AS whole FROM {table}),
  tf AS (SELECT whole, CASE WHEN lag(whole) OVER ({ALONG}) = whole THEN 0 ELSE 1 END AS fresh FROM tz),
  tc AS (SELECT count(CASE WHEN whole <> 0 AND fresh = 1 THEN 1 END) AS n_runs, count(CASE WHEN whole <> 0 THEN 1 END) AS held, count(*) AS n_bars FROM tf),
  tr_ AS (SELECT n_runs, n_runs / greatest(n_bars / 1.2e1, 1e0) AS ratio, greatest(held / greatest(n_runs * 1e0, 1e0), 1e0) AS hold FROM tc),
  tq AS (SELECT n_runs, ratio, hold, CASE WHEN ratio <= 0 THEN -2e0 WHEN ratio < 5e-2 THEN -2e0 + ratio / 5e-2 WHEN ratio < 5e-1 THEN -1e0 + (ratio - 5e-2) / 4.5e-1
      WHEN ratio <= 2 THEN exp(-5e-1 * (ln(greatest(ratio, 1e-9)) / ln(2e0)) * (ln(greatest(ratio, 1e-9)) / ln(2e0))) WHEN ratio <= 8 THEN 5e-1 - (ratio - 2e0) / 6e0 * 1.5e0 ELSE -2e0 END
    + CASE WHEN n_runs > 0 THEN least(3e-1, ln(hold) / ln(3e1) * 3e-1) ELSE 0e0 END AS quality FROM tr_)"""


#: Positions of a sign alone, as a strategy that is always whole in or out would hold.
report("score_turnover_quality", f"SELECT n_runs, {r6('hold', 'hold')}, {r6('ratio', 'ratio')}, {r6('quality', 'quality')} FROM tq", turnover_quality("{pnl}", n(DEAD_BAND)))


def _score(where: str) -> str:
    """CTEs that score the bars of `where` (over bar_idx and bars): cmp has the components."""
    return f"""sb AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS bars FROM {{pnl}}), s AS (SELECT * FROM sb WHERE {where}),
  sp AS (SELECT *, lag(factor) OVER ({ALONG}) AS f0, lead(target) OVER ({ALONG}) AS y, lag(abs(position)) OVER ({ALONG}) AS a0,
    row_number() OVER ({ALONG}) AS rn, count(*) OVER (PARTITION BY symbol) AS n_bars FROM s),
  {flattened("sp")},
  sq AS (SELECT *,
    CASE WHEN rn <= floor(n_bars / 2e0) THEN pnl END AS h1, CASE WHEN rn > floor(n_bars / 2e0) THEN pnl END AS h2,
    position * target - CASE WHEN rn = 1 THEN abs(position) ELSE turnover END * {n(2 * COST)} AS stressed FROM fd),
  {turnover_quality("s")},
  ps AS (SELECT symbol, {sortino1()} AS sor, count(CASE WHEN abs(abs(position) - a0) > 1e-1 THEN 1 END) AS trades, max(n_bars) AS n_bars,
    CASE WHEN stddev_pop(CASE WHEN y IS NOT NULL THEN factor END) >= 1e-6 AND stddev_pop(y) >= 1e-6
      THEN covar_pop(factor, y) / (stddev_pop(CASE WHEN y IS NOT NULL THEN factor END) * stddev_pop(y) + 1e-8) END AS ic,
    CASE WHEN stddev_pop(f0) > 1e-6 AND stddev_pop(CASE WHEN f0 IS NOT NULL THEN factor END) > 1e-6
      THEN covar_pop(f0, factor) / (stddev_pop(f0) * stddev_pop(CASE WHEN f0 IS NOT NULL THEN factor END) + 1e-8) ELSE 0e0 END AS ac FROM sq GROUP BY symbol),
  pa AS (SELECT *, greatest(5e0, floor(n_bars / 1e2)) AS least_trades FROM ps),
  cs AS (SELECT count(*) AS n_sym, coalesce({clip("avg(ic) / (stddev_pop(ic) + 1e-6)", -3, 3)}, 0e0) AS ts_ic,
    avg({clip("1e0 - abs(ac) + CASE WHEN ac < 0 THEN 5e-1 ELSE 0e0 END", -1, 2)}) AS reversal,
    avg(CASE WHEN trades < least_trades THEN 1e0 ELSE 0e0 END) AS idle, min(sor) AS worst,
    avg(CASE WHEN trades >= least_trades THEN CASE WHEN sor > 0 THEN 1e0 ELSE 0e0 END END) AS good FROM pa),
  cm AS (SELECT avg(pnl) * {n(PPY)} AS ann, {sortino1()} AS sortino, {clip(f"avg(pnl) * {n(PPY)} / greatest(max(down), 1e-8)", -10, 10)} AS calmar,
    {sortino1("stressed", bound=5.0)} AS stress, avg(CASE WHEN position > {n(DEAD_BAND)} THEN 1e0 ELSE 0e0 END) AS long_share, avg(CASE WHEN position < {n(-DEAD_BAND)} THEN 1e0 ELSE 0e0 END) AS short_share,
    avg(CASE WHEN position > 0 THEN 1e0 ELSE 0e0 END) AS any_long, avg(CASE WHEN position < 0 THEN 1e0 ELSE 0e0 END) AS any_short,
    avg(abs(position)) AS exposure, avg(turnover) AS mean_turnover, {sortino1("h1")} AS s1, {sortino1("h2")} AS s2, min(n_bars) AS n_bars FROM sq),
  cmp AS (SELECT n_sym, ann, sortino, calmar, stress, ts_ic, reversal,
    CASE WHEN idle > 4e-1 THEN -3e0 WHEN worst < -2e0 THEN -2e0 WHEN good IS NULL THEN -3e0
      WHEN good < 6e-1 THEN (good - 6e-1) / 6e-1 ELSE (good - 6e-1) / 4e-1 + CASE WHEN good = 1e0 THEN 5e-1 ELSE 0e0 END END AS consistency,
    CASE WHEN greatest(long_share, short_share) > 8.5e-1 THEN -2e0 * (greatest(long_share, short_share) - 8.5e-1) / 1.5e-1
      WHEN greatest(long_share, short_share) > 7e-1 THEN -5e-1 * (greatest(long_share, short_share) - 7e-1) / 1.5e-1 ELSE 0e0 END AS beta,
    {clip("1e0 - 2e0 * (abs(any_long - 5e-1) + abs(any_short - 5e-1))", -1, 1)} AS symmetry,
    CASE WHEN exposure < 1e-1 THEN (exposure / 1e-1 - 1e0) * 2e0 ELSE 0e0 END AS sparse,
    CASE WHEN n_bars < 20 THEN 0e0 WHEN s1 > 0 AND s2 > 0 THEN 5e-1 WHEN s1 * s2 < 0 THEN -1e0 ELSE 0e0 END AS halves,
    -greatest(least((mean_turnover - 2e-1) * 3e0, 3e0), 0e0) AS turnover_penalty,
    quality AS turnover_quality FROM cm, cs, tq)"""


#: Weights of the objective: annual return, Sortino, Calmar, IC, consistency, cost stress,
#: turnover quality, reversal, symmetry; for one symbol and for several.
WEIGHTS = {
    ("standard", 1): (0.60, 0.15, 0.10, 0.10, 0, 0, 0.05, 0, 0),
    ("ftmo", 1): (0.80, 0.05, 0.10, 0.03, 0, 0, 0.02, 0, 0),
    ("forex", 1): (0.25, 0.05, 0.05, 0.25, 0, 0, 0.05, 0.20, 0.15),
    ("standard", 2): (0.60, 0.10, 0.05, 0.10, 0.05, 0.05, 0.05, 0, 0),
    ("ftmo", 2): (0.75, 0.05, 0.10, 0.02, 0.03, 0.02, 0.03, 0, 0),
    ("forex", 2): (0.60, 0.10, 0.05, 0.10, 0.05, 0.05, 0.05, 0, 0),
}
_PARTS = ("ann", "sortino", "calmar", "ts_ic", "consistency", "stress", "turnover_quality", "reversal", "symmetry")


def objective(mode: str) -> str:
    """The weighted score over cmp."""

    def weighed(k: int) -> str:
        return " + ".join(f"{n(w)} * {p}" for w, p in zip(WEIGHTS[mode, k], _PARTS, strict=True) if w)

    return f"(CASE WHEN n_sym = 1 THEN {weighed(1)} ELSE {weighed(2)} END + sparse + beta + halves)"


report("score_components", "SELECT n_sym, " + ", ".join(r6(c, c) for c in (*_PARTS, "beta", "sparse", "halves", "turnover_penalty")) + " FROM cmp", _score("true"))
report("score_modes", "SELECT " + ", ".join(r6(objective(m), m) for m in ("standard", "ftmo", "forex")) + " FROM cmp", _score("true"))


def gated(score: str, oos: str) -> str:
    return f"{score} * CASE WHEN {oos} <= 0 THEN greatest(1e-1, 5e-1 + {oos} * 4e-1) ELSE least(1.2e0, 1e0 + {oos} * 1e-1) END"


report(
    "score_evaluate",
    f"SELECT {r6(gated('(' + objective('ftmo') + ' + turnover_penalty)', 'oos'), 'score')}, {r6('mean_oos', 'mean_oos')} FROM cmp, oo",
    _score("bar_idx < floor(bars * 8e-1)") + f", oo AS (SELECT {sortino1()} AS oos, avg(pnl) AS mean_oos FROM sb WHERE bar_idx >= floor(bars * 8e-1))",
)


def folds(bars: int, n_folds: int = 5, gap: int = 20) -> list[dict[str, int]]:
    """Rolling walk-forward folds. A gap that does not fit is shared out of what whole folds
    leave over, which is less than one bar a fold: the gap then is 0."""
    whole = {"train_start": 0, "train_end": bars, "val_start": 0, "val_end": bars, "gap": 0}
    size = bars // n_folds
    if size < 2:
        return [whole]
    if size * n_folds + gap * (n_folds - 1) > bars:
        gap = max(0, (bars - size * n_folds) // n_folds)
    out = []
    for k in range(1, n_folds):
        start = k * size + gap
        end = min(start + size, bars)
        if start >= bars or end <= start:
            break
        out.append({"train_start": (k - 1) * size, "train_end": k * size, "val_start": start, "val_end": end, "gap": gap})
    return out or [whole]


report(
    "score_folds",
    f"""SELECT symbol, fold, count(CASE WHEN part = 'train' THEN 1 END) AS train_bars, count(CASE WHEN part = 'val' THEN 1 END) AS val_bars,
    {r6("sum(CASE WHEN part = 'train' THEN pnl ELSE 0e0 END)", "train_return")}, {r6("sum(CASE WHEN part = 'val' THEN pnl ELSE 0e0 END)", "val_return")} FROM fb GROUP BY symbol, fold""",
    """fn AS (SELECT *, floor(count(*) OVER (PARTITION BY symbol) / 5e0) AS size FROM {pnl}),
    fk AS (SELECT 1 AS fold UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4),
    fb AS (SELECT symbol, fold, pnl, CASE WHEN bar_idx < fold * size THEN 'train' ELSE 'val' END AS part FROM fn, fk WHERE bar_idx >= (fold - 1) * size AND bar_idx < (fold + 1) * size)""",
)


def fold_slice(fold: int, part: str) -> Report:
    """The score of a walk-forward fold on its training or validation bars: the objective with the turnover penalty
    on the former, gated by the fold's own Sortino on the latter."""
    start = fold - 1 if part == "train" else fold
    where = f"bar_idx >= {start} * floor(bars / 5e0) AND bar_idx < {start + 1} * floor(bars / 5e0)"
    score = f"{objective('ftmo')} + turnover_penalty" if part == "train" else gated(objective("ftmo"), "oos")
    own = f", oo AS (SELECT {sortino1()} AS oos FROM s)"
    return Report("score_fold", f"SELECT {fold} AS fold, '{part}' AS part, {r6(score, 'score')} FROM cmp, oo", _score(where) + own)


FOLD_SLICES = [fold_slice(k, part) for k in range(1, 5) for part in ("train", "val")]
