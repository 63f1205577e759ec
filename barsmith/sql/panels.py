"""The panels in SQL, for DuckDB."""

from __future__ import annotations

LI_KEY = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"


def bars(symbol: str, time: str, price: str, volume: str, key: str, table: str, where: str = "true") -> str:
    return f"""raw AS (SELECT {symbol} AS symbol, ({time})::BIGINT AS time, arg_min({price}, {key}) AS open, max({price}) AS high,
      min({price}) AS low, arg_max({price}, {key}) AS close, sum({volume})::DOUBLE AS volume
      FROM {table} WHERE {where} GROUP BY 1, 2)"""


DAY = "epoch(date_trunc('day', l_shipdate))"
ALIGNED = """common AS (SELECT time FROM raw GROUP BY time HAVING count(*) = (SELECT count(DISTINCT symbol) FROM raw)),
    bars AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_idx, time, open, high, low, close, volume
      FROM raw WHERE time IN (SELECT time FROM common))"""


def lineitem_days(only: str | None = None) -> str:
    where = f"l_returnflag = '{only}'" if only else "true"
    return bars("l_returnflag", DAY, "(l_extendedprice / l_quantity)", "l_quantity", LI_KEY, "lineitem", where)


def event_hours() -> str:
    return bars("event_type", "epoch(date_trunc('hour', ts))", "value", "1", "row(ts, event_id)", "events")


def order_weeks() -> str:
    return bars("o_orderpriority", "epoch(date_trunc('week', o_orderdate))", "o_totalprice", "1", "row(o_orderdate, o_orderkey)", "orders")


def day_panel(only: str | None = None) -> str:
    return f"{lineitem_days(only)}, {ALIGNED}"


FILLED = """gr AS (SELECT symbol, time FROM (SELECT DISTINCT symbol FROM raw), (SELECT DISTINCT time FROM raw)),
  fx AS (SELECT g.symbol, g.time, r.open, r.high, r.low, r.close, r.volume FROM gr g LEFT JOIN raw r ON g.symbol = r.symbol AND g.time = r.time),
  ff AS (SELECT symbol, time, """ + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}"
    for c in ("open", "high", "low", "close", "volume")
) + " FROM fx)"
