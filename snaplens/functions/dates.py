"""Date arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period code -> (truncation unit, months to the last month, step).
PERIODS = {
    "D": ("day", None, "interval 1 day"),
    "W": ("week", None, "interval 7 days"),
    "M": ("month", 0, "interval 1 month"),
    "Q": ("quarter", 2, "interval 3 months"),
    "Y": ("year", 11, "interval 12 months"),
}


def _check(period: str) -> str:
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}; use one of {', '.join(PERIODS)}")
    return period


def days_between(later: Column, earlier: Column) -> Column:
    """Whole elapsed days."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def newest_first(ts: Column) -> Column:
    """A value that grows as ``ts`` gets older, for ordering inside a struct."""
    return F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - ts


def period_start(ts: Column, period: str) -> Column:
    """First day of the calendar period, as a date; weeks start on Monday."""
    unit = PERIODS[_check(period)][0]
    day = ts.cast("date")
    return day if unit == "day" else F.trunc(day, unit)


def period_end(start: Column, period: str) -> Column:
    """Last day of the period that begins on ``start``, as a date."""
    unit, months, _ = PERIODS[_check(period)]
    if unit == "day":
        return start
    if unit == "week":
        return F.date_add(start, 6)
    return F.last_day(F.add_months(start, months))


def period_step(period: str) -> Column:
    return F.expr(PERIODS[_check(period)][2])


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as written on the clock, whatever the session time zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (F.unix_date(ts.cast("date")).cast("bigint") * 86400 + clock + F.extract(F.lit("SECOND"), ts)).cast("double")


def from_epoch_seconds(seconds: Column) -> Column:
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds.cast("decimal(18,6)")
    )
