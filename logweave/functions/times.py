"""Time buckets and the ``as_of`` convention."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The allowed bucket sizes and the presets of the log browser.
INTERVALS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes",
             "1h": "1 hour", "6h": "6 hours", "1d": "1 day"}
PRESETS = {"15m": "15 minutes", "1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days"}

_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}
_EPOCH = dt.datetime(1970, 1, 1)


def check_interval(interval):
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}, use one of {', '.join(INTERVALS)}")
    return INTERVALS[interval]


def parse_time(value):
    """ISO text (``Z`` accepted) or datetime to a naive UTC datetime."""
    if value is None or isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def parse_time_range(start=None, end=None, now=None, hours=24):
    """Default range: ``hours`` back from ``end``; reversed bounds are swapped."""
    end = parse_time(end) or parse_time(now) or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    start = parse_time(start) or end - dt.timedelta(hours=hours)
    return (end, start) if start > end else (start, end)


def time_type(df: DataFrame, name="timestamp"):
    """``timestamp`` or ``timestamp_ntz``, whichever the column has."""
    return df.schema[name].dataType.simpleString()


def time_lit(df, value, name="timestamp"):
    """A bound with the type of the time column, so the comparison reaches the Parquet filter."""
    if isinstance(value, Column):
        return value
    text = parse_time(value).isoformat(sep=" ")
    return F.lit(text).cast(time_type(df, name))


def as_of(df, value=None, name="timestamp"):
    """The reference time of a report: explicit, or the newest row of ``df``.

    The default is a scalar subquery, so the plan stays lazy and has no cross join; its
    value is filled in before the outer scan starts and is pushed into it.
    """
    if value is not None:
        return time_lit(df, value, name)
    if name == "timestamp" and "log_date" in df.columns:  # the newest day of a stored table holds its newest row
        df = df.where(F.col("log_date") == df.agg(F.max("log_date")).scalar())
    return df.agg(F.max(name)).scalar()


def since(as_of_col, interval):
    return as_of_col - F.expr(f"INTERVAL {interval}")


def trunc(df, unit, name="timestamp"):
    """``date_trunc`` that keeps the type of the column."""
    return F.date_trunc(unit, F.col(name)).cast(time_type(df, name))


def bucket(df, interval, name="timestamp", mode="bin", origin=None):
    """Bucket start of the row.

    ``bin``: true N-unit buckets counted from ``origin`` (default epoch).
    ``trunc``: only the unit counts, so ``5m`` and ``15m`` give minutes and ``6h`` gives hours.
    """
    size = check_interval(interval)
    if mode == "trunc":
        return trunc(df, size.split()[1].rstrip("s"), name)
    if mode != "bin":
        raise ValueError("mode must be 'bin' or 'trunc'")
    if origin is None:
        return F.window(name, size, size).getField("start")
    micros = (parse_time(origin) - _EPOCH) // dt.timedelta(microseconds=1)
    offset = micros % (_SECONDS[interval] * 1_000_000)
    return F.window(name, size, size, f"{offset} microseconds").getField("start")


def epoch_seconds(df, name="timestamp"):
    """Whole seconds since the epoch, for either time type (session zone UTC)."""
    return F.unix_seconds(F.col(name).cast("timestamp"))
