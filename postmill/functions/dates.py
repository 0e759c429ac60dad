"""Time predicates and date arithmetic. Every operator takes ``as_of``; none reads the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def moment(as_of) -> Column:
    """``as_of`` given as a datetime, an ISO string or a column, as a timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp")


def ago(as_of, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return moment(as_of) - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))


def shifted(ts: Column, offset_h: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(offset_h))


def in_business_hours(ts: Column, offset_h: int = 1, start: int = 6, end: int = 23) -> Column:
    hour = F.hour(shifted(ts, offset_h))
    return (hour >= start) & (hour < end)


def is_local_monday(ts: Column, offset_h: int = 1) -> Column:
    return F.weekday(shifted(ts, offset_h)) == 0


def long_date(ts: Column) -> Column:
    return F.date_format(ts, "MMMM dd, yyyy")


def add_business_days(day: Column, n: int = 2) -> Column:
    """``n`` working days on; a weekend start counts from the Friday before it."""
    start = F.least(F.weekday(day), F.lit(4))
    back = F.weekday(day) - start
    jump = F.lit(n) + F.floor((start + n) / 5).cast("int") * 2
    return F.date_add(day, jump - back)


def age_days(as_of, ts: Column) -> Column:
    return F.datediff(moment(as_of), ts)
