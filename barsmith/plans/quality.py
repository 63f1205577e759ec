"""Checks of raw bars: one conditional aggregation, and windows along each symbol."""

from __future__ import annotations

from .reports import Report, r6

STEP = "st AS (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY time) AS t0, lag(close) OVER (PARTITION BY symbol ORDER BY time) AS c0 FROM {pnl})"
BAD = "high < open OR high < close OR low > open OR low > close OR open < 0 OR high < 0 OR low < 0 OR close < 0"
CHECKS = {
    "dq_summary": Report(
        "dq_summary",
        """SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT time) AS duplicates, count(CASE WHEN time < t0 THEN 1 END) AS backwards,
    count(CASE WHEN high < open OR high < close THEN 1 END) AS high_low, count(CASE WHEN low > open OR low > close THEN 1 END) AS low_high,
    count(CASE WHEN open < 0 OR high < 0 OR low < 0 OR close < 0 THEN 1 END) AS negative, count(CASE WHEN volume = 0 THEN 1 END) AS no_volume,
    count(CASE WHEN time - t0 NOT IN (86400, 172800, 259200, 345600, 604800) THEN 1 END) AS odd_gaps,
    count(CASE WHEN c0 > 0 AND abs(close - c0) / c0 > 3e-1 THEN 1 END) AS jumps30, count(CASE WHEN c0 > 0 AND abs(close - c0) / c0 > 5e-1 THEN 1 END) AS jumps50 FROM st GROUP BY symbol""",
        STEP,
    ),
    "dq_anomalies": Report("dq_anomalies", f"SELECT symbol, time, open, high, low, close FROM {{pnl}} WHERE {BAD} OR volume = 0"),
    "dq_gaps": Report("dq_gaps", "SELECT symbol, cast(floor((time - t0) / 8.64e4) AS bigint) AS days, count(*) AS n FROM st WHERE t0 IS NOT NULL GROUP BY symbol, cast(floor((time - t0) / 8.64e4) AS bigint)", STEP),
    "dq_long_gaps": Report("dq_long_gaps", "SELECT symbol, t0 AS from_time, time AS to_time FROM st WHERE time - t0 > 259200", STEP),
    "dq_coverage": Report("dq_coverage", f"SELECT symbol, count(*) AS n_bars, min(time) AS first_time, max(time) AS last_time, {r6('(max(time) - min(time)) / 3.15576e7', 'years')}, CASE WHEN count(*) >= 300 THEN 1 ELSE 0 END AS enough FROM {{pnl}} GROUP BY symbol"),
    "dq_sessions": Report(
        "dq_sessions",
        "SELECT symbol, count(*) AS n_rows, count(CASE WHEN (h > 0 AND h < 9) OR (h >= 15 AND h < 21) THEN 1 END) AS outside FROM hr GROUP BY symbol",
        "hr AS (SELECT symbol, floor((time + 28800) / 3.6e3) - 24 * floor((time + 28800) / 8.64e4) AS h FROM {pnl})",
    ),
    # calendar years of the eastern zone, by dates alone, so that no session's zone matters
    "dq_years": Report(
        "dq_years",
        "SELECT symbol, year, count(*) AS n FROM yr GROUP BY symbol, year",
        "yr AS (SELECT symbol, cast(year(DATE '1970-01-01' + cast(floor((time + 28800) / 8.64e4) AS int)) AS bigint) AS year FROM {pnl})",
    ),
    # the saved bars lack some times, have some closes moved and some volumes lost
    "dq_compare": Report(
        "dq_compare",
        f"""SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.time, b.time) AS time, CASE WHEN b.time IS NULL THEN 'not saved' WHEN a.time IS NULL THEN 'not fresh' ELSE 'differs' END AS kind,
    {", ".join(f"CASE WHEN abs(a.{c} - b.{c}) > 1e-6 THEN 1 ELSE 0 END AS {c}_differs" for c in ("open", "high", "low", "close", "volume"))}
    FROM fresh a FULL OUTER JOIN saved b ON a.symbol = b.symbol AND a.time = b.time
    WHERE a.time IS NULL OR b.time IS NULL OR {" OR ".join(f"abs(a.{c} - b.{c}) > 1e-6" for c in ("open", "high", "low", "close", "volume"))}""",
        """fresh AS (SELECT * FROM {pnl} WHERE time % 1296000 <> 0), saved AS (SELECT symbol, time, open, high, low, close * (CASE WHEN time % 864000 = 0 THEN 1.01e0 ELSE 1e0 END) AS close,
    volume * (CASE WHEN time % 2592000 = 86400 THEN 0e0 ELSE 1e0 END) AS volume FROM {pnl} WHERE time % 1728000 <> 0)""",
    ),
    # only times that lack some symbol meet the symbols
    "dq_missing": Report(
        "dq_missing",
        "SELECT s.symbol, t.time FROM (SELECT DISTINCT symbol FROM {pnl}) s JOIN (SELECT time, count(DISTINCT symbol) AS n FROM {pnl} GROUP BY time) t ON t.n < (SELECT count(DISTINCT symbol) FROM {pnl}) LEFT JOIN {pnl} b ON b.symbol = s.symbol AND b.time = t.time WHERE b.time IS NULL",
    ),
    # the last bar's high and low stand for ask and bid
    "dq_spread_cost": Report(
        "dq_spread_cost",
        f"SELECT symbol, {r6('ask - bid', 'spread')}, {r6('(ask - bid) / ((ask + bid) / 2e0)', 'spread_rate')}, {r6('(ask - bid) / ((ask + bid) / 2e0) / 2e0', 'cost_rate')} FROM lq WHERE back = 1",
        "lq AS (SELECT symbol, high AS ask, low AS bid, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM {pnl})",
    ),
    "dq_overlap": Report(
        "dq_overlap",
        "SELECT a.symbol AS one, b.symbol AS two, count(*) AS common_times FROM {pnl} a JOIN {pnl} b ON a.time = b.time AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol",
    ),
}
