"""Conditions on names, dates and weekdays. Each takes the planning date; none reads a clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_ci(name: Column, pattern: str | Column) -> Column:
    """SQL LIKE without regard to case. A literal pattern is lowered here, so a prefix pattern becomes a StartsWith."""
    if isinstance(pattern, str):
        return F.lower(name).like(pattern.lower())
    return F.like(F.lower(name), F.lower(pattern))


def weekday_number(day: dt.date) -> int:
    """0 for Sunday to 6 for Saturday."""
    return day.isoweekday() % 7


def weekday_of(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday, of a date column."""
    return F.dayofweek(day) - F.lit(1)


def delivery_of_start(lead_days: Column, as_of: dt.date) -> Column:
    """The delivery date of what is started on ``as_of``."""
    return F.date_add(F.lit(as_of), lead_days)


def due_on(delivery_date: Column, lead_days: Column, as_of: dt.date) -> Column:
    """True for an order that must be started on ``as_of``."""
    return delivery_date == delivery_of_start(lead_days, as_of)


def active_on(start: Column, resume: Column, lead_days: Column, as_of: dt.date) -> Column:
    """True where the change covers the delivery of what starts on ``as_of``.

    The range is half open, and a change without a resume date is never active.
    """
    delivery = delivery_of_start(lead_days, as_of)
    return (start <= delivery) & (resume > delivery)


def due_weekday(lead_days: Column, as_of: dt.date, wrap: bool = True) -> Column:
    """The weekday on which what starts on ``as_of`` is delivered.

    Without ``wrap`` it runs past the end of the week. With it, a week is taken off once: a delivery after the end of next week
    has a number that no weekday has.
    """
    shifted = lead_days + F.lit(weekday_number(as_of))
    return F.when(shifted < 7, shifted).otherwise(shifted - 7) if wrap else shifted


def weekday_due(day: Column, lead_days: Column, as_of: dt.date, wrap: bool = True) -> Column:
    """True for a weekly order that must be started on ``as_of``."""
    return day == due_weekday(lead_days, as_of, wrap)


def recent(changed: Column, now: dt.datetime | Column, seconds: int) -> Column:
    """True where ``changed`` is less than ``seconds`` before ``now``, or after it."""
    moment = now if isinstance(now, Column) else F.lit(now)
    return changed > moment - F.make_dt_interval(secs=F.lit(seconds))
