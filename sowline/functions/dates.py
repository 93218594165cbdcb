"""Date and time helpers (rules M1, F1-F12).

Timestamps in the event feeds are UTC wall-clock values held in
``timestamp_ntz`` columns.  Every helper here works on them without going
through the session time zone, so results do not depend on
``spark.sql.session.timeZone``.  Durations are carried as integer
microseconds so that sums are exact and independent of row order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz(text: str) -> Column:
    """A timestamp_ntz literal from text ('2024-01-05' or '2024-01-05 10:00:00')."""
    return F.lit(text).cast("timestamp_ntz")


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp_ntz (UTC wall clock)."""
    return F.timestamp_diff("MICROSECOND", ntz(EPOCH_NTZ), _c(ts))


def micros_to_ts(us) -> Column:
    """Inverse of epoch_micros, as timestamp_ntz."""
    return F.timestamp_add("MICROSECOND", _c(us), ntz(EPOCH_NTZ))


def micros_to_date(us) -> Column:
    """The UTC calendar day of an epoch-microsecond instant."""
    return F.date_from_unix_date(F.floor(_c(us) / F.lit(86_400_000_000)).cast("int"))


def seconds_to_micros(sec) -> Column:
    """Seconds held in a double -> whole microseconds."""
    return F.round(_c(sec) * F.lit(1_000_000.0)).cast("long")


def micros_to_seconds(us) -> Column:
    return _c(us) / F.lit(1_000_000.0)


def utc_day(ts) -> Column:
    """EXTRACT(DATE FROM ts): the UTC calendar day of a timestamp_ntz."""
    return F.to_date(_c(ts))


def local_day(ts, tz: str) -> Column:
    """DATE(ts, tz): the calendar day in zone ``tz`` of a UTC wall-clock timestamp_ntz."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts)))


def local_start(day, tz: str) -> Column:
    """The first UTC instant (timestamp_ntz) of a calendar day in zone ``tz``,
    clock changes included; constant for a literal day."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), F.lit(str(day)).cast("timestamp_ntz"))


def in_local_days(ts, tz: str, first: dt.date | None = None, last: dt.date | None = None) -> Column:
    """``first <= DATE(ts, tz) <= last`` as a range of the raw UTC column, which
    the parquet reader can skip row groups by; an end left out is open."""
    c, cond = _c(ts), F.lit(True)
    if first is not None:
        cond = c >= local_start(first, tz)
    if last is not None:
        below = c < local_start(last + dt.timedelta(days=1), tz)
        cond = below if first is None else cond & below
    return cond


def month_day(d) -> Column:
    """strftime('%m-%d')."""
    return F.date_format(_c(d), "MM-dd")


def iso_week(d) -> Column:
    """ISO-8601 week number (pandas isocalendar().week)."""
    return F.weekofyear(_c(d))
