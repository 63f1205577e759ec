"""Sizes, live signals and position monitoring as reports over a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import ALONG, DEAD_BAND, SO_FAR, Report, n, r6

EQUITY, RISK, STEP, LEAST, MOST, TICK = 1e5, 0.01, 0.01, 0.01, 5.0, 1.0
STOP, TAKE, ARMED, DROP = -0.02, 0.04, 0.03, 0.015


def lots(wanted: str, floor: bool = False, least: float = LEAST) -> str:
    """Whole steps between the smallest and the largest size; halves go to even steps, and a
    size that is cut down below the smallest is none."""
    x = f"(({wanted}) / {n(STEP)})"
    if floor:
        y = f"floor({x} + 1e-9) * {n(STEP)}"
        return f"CASE WHEN {y} < {n(least)} THEN 0e0 ELSE least({y}, {n(MOST)}) END"
    even = f"(CASE WHEN {x} - floor({x}) = 5e-1 THEN 2e0 * floor({x} / 2e0 + 5e-1) ELSE floor({x} + 5e-1) END)"
    return f"greatest(least({even} * {n(STEP)}, {n(MOST)}), {n(least)})"


LAST = f"""lb AS (SELECT *, avg(high - low) OVER ({ALONG} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) AS back FROM {{pnl}}),
  la AS (SELECT * FROM lb WHERE back = 1)"""
RISKS = {
    "risk_lots": Report(
        "risk_lots",
        f"""SELECT symbol, {r6("atr", "atr")}, {r6(lots(f"{n(EQUITY * RISK)} / (atr * {n(TICK)})"), "lot_by_stop")},
    {r6(f"least({lots(f'{n(EQUITY * RISK)} / (atr * {n(TICK)})')}, 1e-1)", "lot_by_atr")}, {r6(lots(f"2e3 * least(abs(position), 1e0) / (atr * {n(TICK)})", True), "lot_by_volatility")} FROM la""",
        LAST,
    ),
    "live_signal": Report(
        "live_signal",
        f"""SELECT symbol, n_bars, CASE WHEN n_bars < 800 THEN 'INSUFFICIENT' WHEN signal >= {n(DEAD_BAND)} THEN 'LONG' WHEN signal <= {n(-DEAD_BAND)} THEN 'SHORT' ELSE 'FLAT' END AS direction, {r6("signal", "signal")}, time FROM lv""",
        LAST + ", lv AS (SELECT la.symbol, la.time, tanh(la.factor) AS signal, c.n_bars FROM la JOIN (SELECT symbol, count(*) AS n_bars FROM {pnl} GROUP BY symbol) c ON c.symbol = la.symbol)",
    ),
    "live_flips": Report(
        "live_flips",
        "SELECT symbol, bar_idx, time, was, dir FROM fl WHERE was <> dir",
        f"""dr AS (SELECT symbol, bar_idx, time, CASE WHEN position > 0 THEN 'LONG' WHEN position < 0 THEN 'SHORT' ELSE 'FLAT' END AS dir FROM {{pnl}}),
    fl AS (SELECT *, lag(dir) OVER ({ALONG}) AS was FROM dr)""",
    ),
    "live_monitor": Report(
        "live_monitor",
        "SELECT symbol, side, bar_idx, event FROM ev WHERE bar_idx <= coalesce(last_bar, bar_idx) AND event <> 'NONE'",
        f"""en AS (SELECT symbol, bar_idx, close, first_value(close) OVER ({ALONG}) AS entry, max(close) OVER ({SO_FAR}) AS top, min(close) OVER ({SO_FAR}) AS bottom FROM {{pnl}}),
    bs AS (SELECT symbol, bar_idx, 'BUY' AS side, close / entry - 1e0 AS profit, (top - close) / top AS back FROM en UNION ALL
      SELECT symbol, bar_idx, 'SELL' AS side, entry / close - 1e0 AS profit, (close - bottom) / bottom AS back FROM en),
    fp AS (SELECT *, min(CASE WHEN profit > {n(TAKE)} THEN bar_idx END) OVER (PARTITION BY symbol, side) AS first_take FROM bs),
    ef AS (SELECT symbol, side, bar_idx, CASE WHEN profit < {n(STOP)} THEN 'STOP' WHEN bar_idx = first_take THEN 'HALF' WHEN profit > {n(ARMED)} AND back > {n(DROP)} THEN 'TRAIL' ELSE 'NONE' END AS event FROM fp),
    ev AS (SELECT *, min(CASE WHEN event IN ('STOP', 'TRAIL') THEN bar_idx END) OVER (PARTITION BY symbol, side) AS last_bar FROM ef)""",
    ),
}
RISKS["live_risk_check"] = Report(
    "live_risk_check",
    f"""SELECT symbol, {r6("expected", "expected_lot")}, {r6("held", "live_lot")}, CASE WHEN expected > 0 THEN floor(held / expected * 1e6 + 4.7e-1) / 1e6 ELSE 0e0 END AS ratio,
    CASE WHEN expected > 0 AND held / expected > 1.35e0 THEN 'OVER' WHEN expected = 0 AND held > 0 THEN 'POSITION_WHILE_FLAT' ELSE 'OK' END AS alert FROM xp""",
    LAST
    # what is held is what the signal a month of bars earlier asked for, as an account that was not reconciled since has
    + f""", hd AS (SELECT symbol AS k, {lots(f"2e3 * least(abs(position), 1e0) / (atr * {n(TICK)})", True)} AS held FROM lb WHERE back = 21),
    xp AS (SELECT symbol, {lots(f"2e3 * least(abs(position), 1e0) / (atr * {n(TICK)})", True)} AS expected, held FROM la JOIN hd ON la.symbol = hd.k)""",
)
#: Bounds of the weight by Sharpe, and its exponent.
LEAST_WEIGHT, MOST_WEIGHT, EXPONENT = 0.5, 1.5, 0.5
RISKS["risk_sharpe_weight"] = Report(
    "risk_sharpe_weight",
    f"""SELECT symbol, {r6("sharpe", "sharpe")}, {r6(f"CASE WHEN ref <= 0 OR sharpe <= 0 THEN {n(LEAST_WEIGHT)} ELSE greatest(least(power(greatest(sharpe, 1e-12) / ref, {n(EXPONENT)}), {n(MOST_WEIGHT)}), {n(LEAST_WEIGHT)}) END", "weight")}
    FROM sp, (SELECT max(sharpe) AS ref FROM sp) rf""",
    "sp AS (SELECT symbol, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(2.52e2) AS sharpe FROM {pnl} GROUP BY symbol)",
)
#: A signal waits until its last bar has been open for half its time at least.
RISKS["live_pending"] = Report(
    "live_pending",
    "SELECT symbol, time, CASE WHEN n_bars < 800 THEN 'INSUFFICIENT' WHEN now - time < 86400 - 43200 THEN 'PENDING' ELSE 'READY' END AS state FROM la, (SELECT max(time) + 30000 AS now, min(n) AS n_bars FROM (SELECT symbol, max(time) AS time, count(*) AS n FROM {pnl} GROUP BY symbol) lt) nw",
    LAST,
)
RISKS["chart_bars"] = Report(
    "chart_bars",
    f"""SELECT symbol, bar_idx, time, {r6("open", "open")}, {r6("position", "position")}, {r6("equity", "equity")}, CASE WHEN dir = was THEN NULL WHEN dir > 0 THEN 'BUY' WHEN dir < 0 THEN 'SELL' ELSE 'EXIT' END AS marker FROM cm""",
    f"""cd AS (SELECT symbol, bar_idx, time, open, position, CASE WHEN position >= {n(DEAD_BAND)} THEN 1 WHEN position <= {n(-DEAD_BAND)} THEN -1 ELSE 0 END AS dir, sum(pnl) OVER ({SO_FAR}) AS equity FROM {{pnl}}),
    cm AS (SELECT *, coalesce(lag(dir) OVER ({ALONG}), 0) AS was FROM cd)""",
)
SYNC = Report(
    "live_portfolio_sync",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'REMOVE' WHEN a.k IS NULL THEN 'ADD' WHEN a.v <> b.v THEN 'UPDATE' ELSE 'KEEP' END AS action FROM lo a FULL OUTER JOIN re b ON a.k = b.k""",
    "lo AS (SELECT o_custkey AS k, count(*) AS v FROM {pnl} WHERE o_orderstatus = 'O' GROUP BY o_custkey), re AS (SELECT o_custkey AS k, count(*) AS v FROM {pnl} WHERE o_orderstatus <> 'O' GROUP BY o_custkey)",
)


#: What each symbol holds and should hold: the direction a month of bars ago and now.
WANTED = Report(
    "wanted",
    f"""SELECT symbol, max(CASE WHEN back = 21 THEN dir END) AS held, max(CASE WHEN back = 1 THEN dir END) AS target FROM wd WHERE back IN (1, 21) GROUP BY symbol""",
    f"wd AS (SELECT symbol, CASE WHEN position >= {n(DEAD_BAND)} THEN 1 WHEN position <= {n(-DEAD_BAND)} THEN -1 ELSE 0 END AS dir, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) AS back FROM {{pnl}})",
)
MOST_OPEN = 2


def reconciled(wanted: DataFrame, most_open: int = MOST_OPEN) -> DataFrame:
    """(symbol, action) of one round over an account's symbols in their order: what closes frees a place, and
    an opening beyond the bound is skipped. wanted: symbol, held, target; an account's symbols are few."""
    rows = F.sort_array(F.collect_list(F.struct("symbol", "held", "target")))
    held, target = (lambda x: x["held"]), (lambda x: x["target"])
    opens = lambda x: (held(x) == 0) & (target(x) != 0)
    start = F.struct(F.size(F.filter("rows", lambda x: x["held"] != 0)).alias("open"), F.array().cast("array<struct<symbol:string,action:string>>").alias("done"))

    def step(acc, x):
        side = F.when(target(x) > 0, "LONG").otherwise("SHORT")
        full = opens(x) & (acc["open"] >= most_open)
        action = (
            F.when(held(x) == target(x), F.lit("HOLD"))
            .when(full, F.lit("SKIP"))
            .when(held(x) == 0, F.concat(F.lit("OPEN_"), side))
            .when(target(x) == 0, F.lit("CLOSE"))
            .otherwise(F.concat(F.lit("REVERSE_TO_"), side))
        )
        moved = F.when(opens(x) & ~full, 1).when((held(x) != 0) & (target(x) == 0), -1).otherwise(0)
        return F.struct((acc["open"] + moved).alias("open"), F.concat(acc["done"], F.array(F.struct(x["symbol"].alias("symbol"), action.alias("action")))).alias("done"))

    done = wanted.agg(rows.alias("rows")).select(F.explode(F.aggregate("rows", start, step, lambda a: a["done"])).alias("d"))
    return done.select("d.symbol", "d.action")


def reconciled_sql(wanted: str, most_open: int = MOST_OPEN) -> str:
    """The same as a recursion along the symbols; wanted is a subquery."""
    return f"""rw AS (SELECT *, row_number() OVER (ORDER BY symbol) AS k FROM ({wanted})),
  rr(k, open, symbol, action) AS (SELECT 0::BIGINT, (SELECT count(*) FROM rw WHERE held <> 0), NULL::VARCHAR, NULL::VARCHAR
    UNION ALL SELECT rw.k, open + CASE WHEN held = 0 AND target <> 0 AND open < {most_open} THEN 1 WHEN held <> 0 AND target = 0 THEN -1 ELSE 0 END, rw.symbol,
      CASE WHEN held = target THEN 'HOLD' WHEN held = 0 AND open >= {most_open} THEN 'SKIP' WHEN held = 0 THEN 'OPEN_' || CASE WHEN target > 0 THEN 'LONG' ELSE 'SHORT' END
        WHEN target = 0 THEN 'CLOSE' ELSE 'REVERSE_TO_' || CASE WHEN target > 0 THEN 'LONG' ELSE 'SHORT' END END
    FROM rr JOIN rw ON rw.k = rr.k + 1)"""
