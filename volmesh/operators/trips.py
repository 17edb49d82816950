"""Tables over closed trips: stops and what follows them, contracts and their errors, buckets of an entry's state, days of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import calendar
from .quantiles import quantiles


def after_stops(trips: DataFrame, book: list[str], near: int) -> DataFrame:
    """trips (entry, side, day0, exit_day, reason) with reentry (the trip that closed before it in its book was a stop of its side) and after_stop (it opened 0 to `near` weekdays after some stop of its book).

    Stops are reduced to a row a day; the latest one up to a day is the nearest, so a running maximum over days tells, and rows meet it by day."""
    closes = Window.partitionBy(*book).orderBy("exit_day", "entry")
    rows = trips.withColumn("reentry", F.coalesce((F.lag("reason").over(closes) == "stop") & (F.lag("side").over(closes) == F.col("side")), F.lit(False)))
    stops = trips.where("reason = 'stop'").select(*book, F.col("exit_day").alias("day"), F.col("exit_day").alias("_stop")).distinct()
    days = trips.select(*book, F.col("day0").alias("day")).distinct().join(stops, [*book, "day"], "full_outer")
    last = F.max("_stop").over(Window.partitionBy(*book).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))  # a row a day
    known = days.select(*book, F.col("day").alias("day0"), last.alias("_last"))
    return rows.join(known, [*book, "day0"]).withColumn("after_stop", F.coalesce(calendar.weekdays_between(F.col("_last"), F.col("day0")) <= near, F.lit(False))).drop("_last")


def stop_stats(trips: DataFrame, log: DataFrame, book: list[str], near: int) -> DataFrame:
    """book, stops, blocked_days, reentries, after_n, after_pnl, other_n, other_pnl: stops, days with an entry that a stop blocked (log: book, day, why), re-entries right after a stop, and the trips soon after a stop against the others."""
    rows = after_stops(trips, book, near)
    on = lambda c: F.coalesce(F.sum(F.when(c, F.col("pnl_net"))), F.lit(0.0))
    n = lambda c: F.count(F.when(c, 1))
    stats = rows.groupBy(*book).agg(n(F.col("reason") == "stop").alias("stops"), n(F.col("reentry")).alias("reentries"), n(F.col("after_stop")).alias("after_n"), on(F.col("after_stop")).alias("after_pnl"), n(~F.col("after_stop")).alias("other_n"), on(~F.col("after_stop")).alias("other_pnl"))
    blocked = log.where(F.col("why").isin("cooloff", "reset_wait")).groupBy(*book).agg(F.count_distinct("day").alias("blocked_days"))
    return stats.join(blocked, book, "left").na.fill(0, ["blocked_days"])


def contract_table(trips: DataFrame, book: list[str]) -> DataFrame:
    """book, trips, mean_qty, median_qty, max_qty, credit, net_per_contract, mean_per_contract, se, stops, profits of trips (qty, credit, pnl_net, reason): sizes, the mean credit of a contract, net profit a contract of all and as a mean
    of trips with its standard error."""
    each = F.col("pnl_net") / F.col("qty")
    n = F.count(F.lit(1))
    out = trips.groupBy(*book).agg(n.alias("trips"), F.avg("qty").alias("mean_qty"), F.max("qty").alias("max_qty"), F.avg("credit").alias("credit"), (F.sum("pnl_net") / F.sum("qty")).alias("net_per_contract"), F.avg(each).alias("mean_per_contract"), (F.stddev_samp(each) / F.sqrt(n.cast("double"))).alias("se"), *[F.count(F.when(F.col("reason") == r, 1)).alias(f"{r}s") for r in ("stop", "profit")])
    return out.join(quantiles(trips, book, "qty", [0.5]).withColumnRenamed("q0", "median_qty"), book)


def spread_costs(once: DataFrame, twice: DataFrame, keys: list[str]) -> DataFrame:
    """keys, commission, spread: fees, and what the spread costs, from the same trips closed at once and twice the spread: the difference of their profits before fees."""
    sums = lambda d, m: d.groupBy(*keys).agg(F.sum("commission").alias("commission"), F.sum(F.col("pnl_net") + F.col("commission")).alias(f"_{m}"))
    return sums(once, 1).join(sums(twice, 2).drop("commission"), keys).select(*keys, "commission", (F.col("_1") - F.col("_2")).alias("spread"))


def state_buckets(trips: DataFrame, group: str, by: str, value: str) -> DataFrame:
    """group (and 'all'), bucket, n, total, mean: value by tercile of an entry's state, for each group and pooled; equal states share a bucket."""
    rows = trips.where(F.col(by).isNotNull()).select(F.explode(F.array(F.col(group).cast("string"), F.lit("all"))).alias(group), by, value)
    cuts = quantiles(rows, [group], by, [1 / 3, 2 / 3])
    bucket = (F.col(by) > F.col("q0")).cast("int") + (F.col(by) > F.col("q1")).cast("int")
    return rows.join(cuts, group).groupBy(group, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def state_split(trips: DataFrame, group: str, by: str, value: str) -> DataFrame:
    """group (and 'all'), top_n, top_mean, rest_mean, corr: the tenth of trips with the highest state against the rest, and the correlation of state and value."""
    rows = trips.where(F.col(by).isNotNull()).select(F.explode(F.array(F.col(group).cast("string"), F.lit("all"))).alias(group), by, value)
    top = F.col(by) > F.col("q0")
    return rows.join(quantiles(rows, [group], by, [0.9]), group).groupBy(group).agg(F.count(F.when(top, 1)).alias("top_n"), F.avg(F.when(top, F.col(value))).alias("top_mean"), F.avg(F.when(~top, F.col(value))).alias("rest_mean"), F.corr(by, value).alias("corr"))


def event_years(log: DataFrame) -> DataFrame:
    """year, why, days: distinct days of each event by year."""
    return log.where("why is not null").groupBy(F.year("day").alias("year"), "why").agg(F.count_distinct("day").alias("days"))
