"""Time columns. Local time is the session time zone."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F


def instant(as_of) -> Column:
    """``as_of`` as a timestamp column: a datetime, an ISO text or a column."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, (datetime, date)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of.isoformat()
    return F.lit(as_of).cast("timestamp")


def purchased_ts(c: Column) -> Column:
    """ISO text with or without a time to a timestamp; null when unreadable."""
    return F.trim(c).try_cast("timestamp")


def iso_week(c: Column) -> Column:
    return F.date_trunc("week", c)


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def shift_month(c: Column, months: int) -> Column:
    """First day of the month ``months`` away."""
    return F.add_months(F.trunc(c, "month"), months)


def days_before(as_of: Column, days: int) -> Column:
    """Wall-clock time ``days`` earlier."""
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def days_after(ts: Column, days: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(days)} DAYS")


def elapsed_days(start: Column, end: Column) -> Column:
    """Elapsed days, never below zero; null when either end is missing."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.when(micros.isNotNull(), F.greatest(F.lit(0.0), micros / 86_400_000_000.0))


def ms_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, never below zero; null when either is missing."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.when(micros.isNotNull(), F.greatest(F.lit(0), F.floor(micros / 1000)).cast("long"))


def in_date_range(ts: Column, since: str | None, until: str | None, include_undated: bool = False) -> Column:
    """``since`` to ``until`` inclusive; a date-only ``until`` covers its whole local day."""
    if not since and not until:
        return F.lit(True)
    inside = F.lit(True)
    if since:
        inside = inside & (ts >= F.lit(since).cast("timestamp"))
    if until:
        if len(until.strip()) <= 10:
            inside = inside & (ts < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
        else:
            inside = inside & (ts <= F.lit(until).cast("timestamp"))
    return F.when(ts.isNull(), F.lit(bool(include_undated))).otherwise(inside)


def make_day(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts; two-digit years mean 20yy; null when there is no such day."""
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    text = F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    sound = (F.length(full) == 4) & (F.length(month) <= 2) & (F.length(day) <= 2)
    return F.when(sound, text.try_cast("date"))
