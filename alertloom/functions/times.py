"""Time functions. Event times are TIMESTAMP_NTZ local face values; ``as_of`` replaces the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .text import rx


def ntz(value) -> Column:
    """A literal, string, datetime or Column as TIMESTAMP_NTZ."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("timestamp_ntz")


def as_datetime(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))


def to_us(ts: Column) -> Column:
    """Face value as microseconds since 1970, whatever the session zone."""
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000 + clock + second


def from_us(us: Column) -> Column:
    """Inverse of :func:`to_us`."""
    seconds = (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


# Fixed value: timestamp inside a header; searched, so text before it is skipped.
INNER_TS = r"^.*?(\w+)\s+(\d+)\s+(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?.*$"


def inner_ts_parts(inner: Column) -> Column:
    """``[mark, month, day, hour, minute, second, fraction]`` as text from one regex pass; an array
    without the mark when nothing matches."""
    sep = "\x1f"
    groups = sep.join([_TS_MARK, "$1", "$2", "$3", "$4", "$5", "$6"])
    return F.split(F.regexp_replace(inner, rx(INNER_TS), groups), sep)


_TS_MARK = "\x1eTS"


def build_inner_ts(parts: Column, as_of) -> Column:
    """TIMESTAMP_NTZ from the parts, NULL when they name no real moment.

    The day must exist both in the year of ``as_of`` and in the year the rollover rule picks.
    """
    month = F.array_position(F.array(*[F.lit(m) for m in fixed.MONTHS]), F.get(parts, F.lit(1)))
    month = F.nullif(month.cast("int"), F.lit(0))
    day, hour, minute, second = (F.get(parts, F.lit(i)).try_cast("int") for i in (2, 3, 4, 5))
    micro = F.rpad(F.substring(F.get(parts, F.lit(6)), 1, 6), 6, "0")
    seconds = F.concat(F.get(parts, F.lit(5)), F.lit("."), micro).try_cast("decimal(16,6)")
    now = ntz(as_of)
    year, now_month = F.year(now), F.month(now)
    chosen = (
        F.when(month > now_month + 1, year - 1)
        .when((now_month >= 11) & (month <= 2), year + 1)
        .otherwise(year)
    )
    exists = F.try_make_timestamp_ntz(year, month, day, hour, minute, F.lit(0).cast("decimal(16,6)")).isNotNull()
    return F.when(
        (F.get(parts, F.lit(0)) == _TS_MARK) & (second <= 59) & exists, F.try_make_timestamp_ntz(chosen, month, day, hour, minute, seconds)
    )


def parse_inner_ts(inner: Column, as_of) -> Column:
    """Month-name timestamp to TIMESTAMP_NTZ (``as_of`` is a moment or a Column)."""
    return build_inner_ts(inner_ts_parts(inner), as_of)


def period_bounds(period: str, as_of) -> tuple[dt.datetime | None, dt.datetime | None]:
    """``[start, end)`` of a named period; ``(None, None)`` for all time."""
    if period not in fixed.PERIODS:
        raise ValueError(f"invalid period {period!r}, expected one of {fixed.PERIODS}")
    now = as_datetime(as_of)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if period == "today":
        return midnight, None
    if period == "yesterday":
        return midnight - dt.timedelta(days=1), midnight
    if period == "all":
        return None, None
    return now - dt.timedelta(days={"7d": 7, "30d": 30, "1y": 365}[period]), None


def within(df: DataFrame, start=None, end=None, ts: str = "timestamp", closed: bool = False) -> DataFrame:
    """Rows with ``start <= ts < end`` (``<= end`` if ``closed``); the bounds are literals or None.

    A table partitioned by ``event_date`` gets the same bounds on that column, so only its folders of
    the range are read; the bounds on ``ts`` reach the file footers.
    """
    lo = None if start is None else F.lit(as_datetime(start)).cast("timestamp_ntz")
    hi = None if end is None else F.lit(as_datetime(end)).cast("timestamp_ntz")
    if lo is not None:
        df = df.where(F.col(ts) >= lo)
    if hi is not None:
        df = df.where(F.col(ts) <= hi if closed else F.col(ts) < hi)
    if "event_date" in df.columns:
        if start is not None:
            df = df.where(F.col("event_date") >= F.lit(as_datetime(start).date()))
        if end is not None:
            df = df.where(F.col("event_date") <= F.lit(as_datetime(end).date()))
    return df


def in_period(df: DataFrame, period: str, as_of, ts: str = "timestamp") -> DataFrame:
    """The rows of a named period."""
    return within(df, *period_bounds(period, as_of), ts)


def shift_of(ts: Column) -> Column:
    """struct(name, start, end) of the shift a local time falls in."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    day = F.date_trunc("day", ts).cast("timestamp_ntz")

    def at(minutes: int, days: int = 0) -> Column:
        return day + F.expr(f"INTERVAL '{minutes + days * 1440}' MINUTE")

    def shift(name: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), start.alias("start"), end.alias("end"))

    (m, m0, m1), (e, e0, e1), (n, n0, n1) = fixed.SHIFTS
    return (
        F.when((minute >= m0) & (minute < m1), shift(m, at(m0), at(m1)))
        .when((minute >= e0) & (minute < e1), shift(e, at(e0), at(e1)))
        .when(minute < n1, shift(n, at(n0, -1), at(n1)))
        .otherwise(shift(n, at(n0), at(n1, 1)))
    )


def shift_start(as_of) -> dt.datetime:
    """P21 for one moment, as a literal bound."""
    now = as_datetime(as_of)
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    minute = now.hour * 60 + now.minute
    starts = [m for _, m, _ in fixed.SHIFTS if m <= minute]
    first = max(starts) if starts else max(m for _, m, _ in fixed.SHIFTS) - 1440
    return day + dt.timedelta(minutes=first)
