"""Filters and lookups: calendars, universes, completed days, contracts of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trading_days(listed: DataFrame, prints: DataFrame) -> DataFrame:
    """day: the listed calendar's days, and after its end the weekdays that have prints."""
    end = listed.agg(F.max("day").alias("_end"))  # one row
    later = prints.select("day").distinct().join(F.broadcast(end), F.col("day") > F.col("_end")).where(F.weekday("day") < 5).select("day")
    return listed.select("day").distinct().union(later)


def on_weekdays(rows: DataFrame, date: str, days: list[int]) -> DataFrame:
    """Rows whose date falls on the weekdays (Monday is 0); none named means all."""
    return rows.where(F.weekday(date).isin(days)) if days else rows


def live_universe(listed: DataFrame, spot: DataFrame, low: int, high: int, reach: float, fridays: bool) -> DataFrame:
    """day, expiry, strike, right of listed (day, expiry, strike): both rights of contracts within the days to expiry, on Fridays, and within `reach` of the day's spot."""
    dte = F.datediff("expiry", "day")
    rows = listed.where(dte.between(low, high) & ((F.dayofweek("expiry") == 6) | F.lit(not fridays))).distinct()
    rows = rows.join(spot, "day").where(F.abs(F.col("strike") / F.col("spot") - 1) <= reach)
    return rows.select("day", "expiry", "strike", F.explode(F.array(F.lit("C"), F.lit("P"))).alias("right"))


def completed(rows: DataFrame, by: str, date: str, value: str, months: int) -> DataFrame:
    """rows with n and mean of value over the days strictly before, back to `months` months: what a decision of that day may know."""
    past = f"over (partition by {by} order by {date} range between interval {months} months preceding and current row)"
    today = f"over (partition by {by}, {date})"  # a frame can't end a day before in months, so the day itself is taken off
    n = F.expr(f"count({value}) {past} - count({value}) {today}")
    total = F.expr(f"coalesce(sum({value}) {past}, 0) - coalesce(sum({value}) {today}, 0)")
    return rows.withColumns({"n": n, "_total": total}).withColumn("mean", F.when(F.col("n") > 0, F.col("_total") / F.col("n"))).drop("_total")


def lookup(positions: DataFrame, chain: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """positions with the values of their contract in the chain, null where it isn't listed."""
    return positions.join(chain.select(*keys, *values, F.lit(True).alias("listed")), keys, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def of_listed(prints: DataFrame, expiries: DataFrame, keys: list[str]) -> DataFrame:
    """Prints whose keys are in a set."""
    return prints.join(expiries.select(*keys).distinct(), keys, "left_semi")


def friday_expiry(contracts: DataFrame, low: int, high: int, target: int) -> DataFrame:
    """day, expiry, dte: the Friday within the days to expiry that is nearest to the target, of equals the nearer day."""
    rows = contracts.withColumn("dte", F.datediff("expiry", "day")).where((F.dayofweek("expiry") == 6) & F.col("dte").between(low, high))
    return rows.groupBy("day").agg(F.min_by(F.struct("expiry", "dte"), F.struct(F.abs(F.col("dte") - target), F.col("dte"))).alias("_e")).select("day", "_e.*")
