"""Reports over round trips and daily profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def net() -> Column:
    return F.col("pnl") - F.col("commission")


def daily(trips: DataFrame) -> DataFrame:
    """book, date, pnl net of commission, by the day of exit."""
    return trips.groupBy("book", F.col("exit").alias("date")).agg(F.sum(net()).alias("pnl"))


def tail_table(trips: DataFrame, worst: int = 20) -> DataFrame:
    """Worst day and its date (the first of equals), lower quantile, deviation and the sum of the worst days of each book."""
    d = daily(trips)
    rank = F.row_number().over(Window.partitionBy("book").orderBy("pnl", "date"))
    return d.withColumn("_r", rank).groupBy("book").agg(
        F.round(F.min("pnl"), 2).alias("worst"), F.min(F.when(F.col("_r") == 1, F.col("date"))).alias("worst_date"), F.round(F.expr("percentile(pnl, 0.05)"), 2).alias("q5"),
        F.round(F.stddev_samp("pnl"), 4).alias("deviation"), F.round(F.sum(F.when(F.col("_r") <= worst, F.col("pnl"))), 2).alias("worst_sum"),
    )


def period_table(trips: DataFrame) -> DataFrame:
    """Trips, gross, net, commission and share of winners by book and year of exit, with totals by book (year null)."""
    rows = trips.withColumn("year", F.year("exit"))
    return rows.groupingSets([["book", "year"], ["book"]], "book", "year").agg(
        F.count(F.lit(1)).alias("trips"), F.round(F.sum("pnl"), 2).alias("gross"), F.round(F.sum(net()), 2).alias("net"), F.round(F.sum("commission"), 2).alias("commission"), F.round(F.avg((net() > 0).cast("double")), 6).alias("win_rate"))


def trip_errors(trips: DataFrame) -> DataFrame:
    """Mean net profit a trip, its standard error, and median days held by book, side and reason."""
    return trips.groupBy("book", "side", "reason").agg(F.count(F.lit(1)).alias("trips"), F.round(F.avg(net()), 4).alias("mean"), F.round(F.stddev_samp(net()) / F.sqrt(F.count(F.lit(1)).cast("double")), 4).alias("se"), F.round(F.expr("percentile(datediff(exit, entry), 0.5)"), 2).alias("median_days"))


def gap_intervals(trips: DataFrame) -> DataFrame:
    """Daily profit by what lies since the day before in that book: a night, a weekend (over two days, no more than four) or longer."""
    w = Window.partitionBy("book").orderBy("date")
    d = daily(trips).withColumn("_gap", F.datediff("date", F.lag("date").over(w))).where("_gap is not null")
    kind = F.when(F.col("_gap") <= 2, "night").when(F.col("_gap") <= 4, "weekend").otherwise("longer")
    return d.groupBy("book", kind.alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pnl"), 4).alias("mean"), F.round(F.sum("pnl"), 2).alias("total"))


def two_samples(rows: DataFrame, keys: list[str], flag: str, value: str) -> DataFrame:
    """Means of the flagged rows and the others, and the t of their difference at unequal variances."""
    a, b = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    g = rows.groupBy(*keys).agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate((a, b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    return g.withColumn("t", (F.col("mean0") - F.col("mean1")) / F.sqrt(F.col("var0") / F.col("n0") + F.col("var1") / F.col("n1")))


def terciles(trips: DataFrame, by: str) -> DataFrame:
    """Net profit by tercile of a column; equal values share a bucket. Bounds are one row a book."""
    cuts = quantiles(trips, ["book"], by, [1 / 3, 2 / 3])
    bucket = (F.col(by) > F.col("q0")).cast("int") + (F.col(by) > F.col("q1")).cast("int")
    return trips.join(cuts, "book").groupBy("book", bucket.alias("tercile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(net()), 2).alias("net"), F.round(F.avg(net()), 4).alias("mean"))


def stop_reentry(trips: DataFrame, days: int = 5) -> DataFrame:
    """By book and side: stops, and how many entries came within so many days after the latest stop at or before them."""
    # one pass over the trips: the entry of each, and the exit of those that were stopped
    entry = F.struct(F.col("entry").alias("at"), F.lit(0).alias("stop"), F.lit(1).alias("entry"))
    stop = F.when(F.col("reason") == "stop", F.struct(F.col("exit").alias("at"), F.lit(1).alias("stop"), F.lit(0).alias("entry")))
    events = trips.select("book", "side", F.inline(F.array_compact(F.array(entry, stop))))
    daily = events.groupBy("book", "side", "at").agg(F.sum("stop").alias("stop"), F.sum("entry").alias("entry"))  # a row a day
    w = Window.partitionBy("book", "side").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seen = daily.withColumn("_last", F.max(F.when(F.col("stop") > 0, F.col("at"))).over(w))
    return seen.groupBy("book", "side").agg(F.sum("stop").alias("stops"), F.coalesce(F.sum(F.when(F.datediff("at", "_last") <= days, F.col("entry"))), F.lit(0)).alias("soon"))


def last_of_day(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; max_by keeps one row a key on the map side, where a window would shuffle all rows."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def picks(candidates: DataFrame, day: str, score: str, name: str) -> DataFrame:
    """By day: the candidate of the highest score (of equals, the first by name), its lead over the second, the best in hindsight, the sum of labels and the number of candidates."""
    top = Window.partitionBy(day).orderBy(F.desc(score), name)
    rows = candidates.withColumn("_r", F.row_number().over(top)).where("_r <= 2").groupBy(day).agg(F.max(F.when(F.col("_r") == 1, F.col(name))).alias("pick"), (F.max(F.when(F.col("_r") == 1, F.col(score))) - F.max(F.when(F.col("_r") == 2, F.col(score)))).alias("lead"))
    best = candidates.groupBy(day).agg(F.max("label").alias("best"), F.sum("label").alias("total"), F.count(F.lit(1)).alias("n"))
    return rows.join(best, day)
