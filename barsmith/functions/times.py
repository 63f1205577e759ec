"""Times and names: Unix seconds to text and back, bar closes, sanitised names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EAST = 8 * 3600
FORMATS = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def text(seconds: Column, offset: int = 0) -> Column:
    """Unix seconds as `yyyy-MM-dd HH:mm` at a fixed offset from UTC, whatever the session's zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moved = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds + offset).cast("decimal(18,6)"))
    return F.date_format(moved, "yyyy-MM-dd HH:mm")


def parsed(value: Column, offset: int = EAST) -> Column:
    """Unix seconds of a local time in any of the known formats; 0 for anything else."""
    day, clock = F.substring(value, 1, 10), F.substring(value, 12, 8)
    shape = F.rlike(value, F.lit(r"^\d{4}-\d\d-\d\d( \d\d:\d\d(:\d\d)?)?$"))
    days = F.datediff(day.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    part = lambda i: F.coalesce(F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("int"), F.lit(0))
    seconds = days * 86400 + part(1) * 3600 + part(2) * 60 + part(3) - offset
    return F.when(shape & days.isNotNull(), seconds).otherwise(F.lit(0)).cast("long")


def next_close(last_open: Column, period: int, now: Column) -> Column:
    """When the forming bar closes; null if the session seems to be over, that is if the last close
    is more than two bars and more than two hours ago."""
    closed, tolerance = last_open + period, max(2 * period, 7200)
    following = last_open + 2 * period
    late = F.greatest(F.floor((now - following) / period) + 1, F.lit(0))
    following = following + late * period
    ended = (now - closed > tolerance) | ((late > 0) & (following - closed > tolerance))
    return F.when(closed > now, closed).when(~ended, following).cast("long")


def next_poll(started: Column, now: Column, interval: int, least: int = 10) -> Column:
    """When a loop that began a round at `started` polls next: the interval after its start, but never less
    than a few seconds from now."""
    return now + F.greatest(F.lit(least), F.lit(interval) - (now - started))


def still_good(fetched: Column, now: Column, period: Column, least: float = 10.0) -> Column:
    """Whether bars fetched at a time may serve again: for four fifths of their timeframe's period."""
    return now - fetched < F.greatest(F.lit(least), period * 0.8)


def safe_name(name: Column) -> Column:
    """A name that can be a file's: other characters become underscores."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def plain_text(line: Column) -> Column:
    """A log line without terminal colours."""
    return F.regexp_replace(line, "\u001b\\[[0-9;]*[A-Za-z]", "")
