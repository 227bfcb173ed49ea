"""Time arithmetic on columns. All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def local_time(ts: Column, offset_seconds: Column) -> Column:
    """Wall clock of the author; null where the offset is unknown."""
    shift = offset_seconds.cast("bigint") * 1_000_000
    return F.timestamp_micros(F.unix_micros(ts) + shift)


def calendar_age_days(ts: Column, as_of: Column) -> Column:
    """Days between two times counted on the calendar.

    Full years weigh 365.25 days and the remaining full months 30 days each;
    the rest is counted in days. Negative when ``ts`` is after ``as_of``.
    """
    first, last = F.least(ts, as_of), F.greatest(ts, as_of)

    def clock(t: Column) -> Column:
        return F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))

    micros = clock(last) - clock(first)
    day_short = (micros < 0).cast("int")
    days = F.dayofmonth(last) - F.dayofmonth(first) - day_short
    month_short = (days < 0).cast("int")
    # a missing month is borrowed at the length of the earlier month
    days = days + month_short * F.dayofmonth(F.last_day(first))
    months = (
        (F.year(last) - F.year(first)) * 12
        + F.month(last)
        - F.month(first)
        - month_short
    )
    whole = F.floor(months / 12) * 365.25 + months % 12 * 30 + days
    age = whole + (micros + day_short * DAY_MICROS) / float(DAY_MICROS)
    return F.when(ts > as_of, -age).when(ts.isNotNull(), age)
