"""Exchange-time and weekday-calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barwright.functions.expr import col

MONDAY_EPOCH = "1970-01-05"


def wall_time_to_instant(ntz: Column | str, tz: str) -> Column:
    """Zone-less exchange wall time to an instant.

    An ambiguous hour takes the earlier offset and a skipped hour moves forward; both fall
    outside regular sessions.
    """
    return F.to_utc_timestamp(col(ntz).cast("timestamp"), tz)


def local_time(ts: Column | str, tz: str) -> Column:
    return F.from_utc_timestamp(col(ts), tz)


def session_date(ts: Column | str, tz: str) -> Column:
    return F.to_date(local_time(ts, tz))


def in_local_window(ts: Column | str, tz: str, start: str | None, end: str | None) -> Column:
    """Gate on the local clock, `HH:MM` to `HH:MM`; no limits given means always open."""
    if start is None or end is None:
        return F.lit(True)
    return F.date_format(local_time(ts, tz), "HH:mm").between(start, end)


def is_weekend(d: Column | str) -> Column:
    return F.weekday(col(d)) > 4


def business_day_index(d: Column | str) -> Column:
    """Running number of weekdays; Saturday and Sunday share Friday's number."""
    days = F.datediff(col(d), F.lit(MONDAY_EPOCH).cast("date"))
    week = F.floor(days / F.lit(7)).cast("bigint")
    return week * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4)).cast("bigint")


def anchor_weekday(d: Column | str) -> Column:
    """The date itself, or Friday for a weekend date."""
    d = col(d)
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)).cast("int"))


def trailing_weekdays(d: Column | str, periods: int) -> Column:
    """Array of the last `periods` weekdays ending at the anchor weekday, ascending."""
    if periods < 1:
        raise ValueError("periods must be >= 1")
    a = anchor_weekday(d)
    span = 7 * ((periods - 1) // 5 + 1) + 2
    days = F.sequence(F.date_sub(a, span), a)
    return F.slice(F.filter(days, lambda x: ~is_weekend(x)), -periods, periods)
