"""New York wall clock on UTC instants (timestamps without a zone are UTC)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ZONE, CLOSE = "America/New_York", 16 * 60
YEAR_SECONDS = 365 * 24 * 3600


def _plain() -> bool:
    """Whether the session's zone is UTC, so that timestamps with and without a zone are the same instants. Then conversions by a fixed zone serve, which cost a tenth of convert_timezone: that reads the zone's name for every row."""
    return SparkSession.active().conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC")


def eastern(ts: Column) -> Column:
    """The wall clock in New York at a UTC instant."""
    if _plain():
        return F.from_utc_timestamp(ts.cast("timestamp"), ZONE).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts.cast("timestamp_ntz"))


def eastern_day(ts: Column) -> Column:
    return F.to_date(eastern(ts))


def at(day: Column, minutes: Column | int) -> Column:
    """The UTC instant of so many minutes after midnight in New York."""
    wall = day.cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes) if isinstance(minutes, int) else minutes)
    if _plain():
        return F.to_utc_timestamp(wall.cast("timestamp"), ZONE).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), wall)


def within(ts: Column, day: Column, start: int, end: int) -> Column:
    """Whether an instant is in (start, end] minutes after midnight in New York on the day. In a plain session its wall clock is found once, for both bounds."""
    if not _plain():
        return (ts > at(day, start)) & (ts <= at(day, end))
    since = F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), ZONE)) - F.unix_date(day).cast("long") * 86_400_000_000
    return F.width_bucket((since - 1).cast("double"), F.lit(start * 6e7), F.lit(end * 6e7), F.lit(1)) == 1


def seconds(end: Column, start: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def years(ts: Column, expiry: Column) -> Column:
    """Years of 365 days from an instant to 16:00 in New York on the expiry."""
    return seconds(at(expiry, CLOSE), ts) / YEAR_SECONDS


def condition_code(text: Column) -> Column:
    """A sale condition as a number: 0 for none or what is no number. Text without digits or with letters, which is none, is not cast: a failed cast throws and catches an exception, which costs more than all else of a print."""
    return F.coalesce(F.when(text.rlike("^[^A-Za-z]*[0-9][^A-Za-z]*$"), text.try_cast("int")), F.lit(0))
