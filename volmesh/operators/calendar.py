"""Calendar and time scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def roll_saturday(day: Column) -> Column:
    return F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).otherwise(day)


def third_friday(day: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "Fri"), 14)


def weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays in [a, b), for a <= b."""
    days, first = F.datediff(b, a), F.weekday(a)
    rest = days % 7
    weekend = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(F.lit(0), F.least(first + rest, F.lit(14)) - 12)
    return F.floor(days / 7) * 5 + rest - weekend


def horizon(dte: Column) -> Column:
    """Trading days of so many calendar days, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(dte * 252 / 365).cast("int"))
