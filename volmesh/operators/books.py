"""Books of trades: round trips, daily profit, risk measures, reports, spread-cost fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def book_metrics(trips: DataFrame, capital: float = 1e6, tail: float = 0.05) -> DataFrame:
    """For each book: pnl, Sharpe ratio on fixed capital (null if flat), largest drawdown from a peak of at least 0, expected shortfall below the interpolated tail quantile, trips, net win rate, mean days held."""
    net = F.col("pnl") - F.col("commission")
    daily = trips.groupBy("book", F.col("exit").alias("date")).agg(F.sum(net).alias("pnl"))
    w = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = daily.withColumn("total", F.sum("pnl").over(w)).withColumn("down", F.greatest(F.max("total").over(w), F.lit(0.0)) - F.col("total"))
    cut = daily.groupBy("book").agg(F.expr(f"percentile(pnl, {tail})").alias("cut"))
    risk = daily.join(cut, "book").groupBy("book").agg(
        F.round(F.sum("pnl"), 2).alias("pnl"),
        F.round(F.when(F.stddev_samp("pnl") > 0, F.avg(F.col("pnl") / capital) / F.stddev_samp(F.col("pnl") / capital) * F.sqrt(F.lit(252.0))), 6).alias("sharpe"),
        F.round(F.max("down"), 2).alias("max_drawdown"),
        F.round(F.avg(F.when(F.col("pnl") <= F.col("cut"), F.col("pnl"))), 2).alias("shortfall"),
    )
    held = trips.groupBy("book").agg(F.count(F.lit(1)).alias("trips"), F.round(F.avg((net > 0).cast("double")), 6).alias("win_rate"), F.round(F.avg(F.datediff("exit", "entry")), 6).alias("days_held"))
    return risk.join(held, "book")


def by_reason(trips: DataFrame) -> DataFrame:
    """Net pnl by book, side and reason of exit, with totals over reasons (reason null)."""
    return trips.groupingSets([["book", "side", "reason"], ["book", "side"]], "book", "side", "reason").agg(F.round(F.sum(F.col("pnl") - F.col("commission")), 2).alias("net"), F.count(F.lit(1)).alias("n"))


def open_positions(trips: DataFrame) -> DataFrame:
    """How many trips of a book are open on each day on which that changes: [entry, exit)."""
    steps = trips.select("book", F.inline(F.array(F.struct(F.col("entry").alias("date"), F.lit(1).alias("d")), F.struct(F.col("exit").alias("date"), F.lit(-1).alias("d")))))
    net = steps.groupBy("book", "date").agg(F.sum("d").alias("d"))
    return net.select("book", "date", F.sum("d").over(Window.partitionBy("book").orderBy("date")).alias("open"))


def spread_fit(quotes: DataFrame, edges: list[int], tiers: list[float]) -> DataFrame:
    """Least-squares half-spread by delta tier and days-to-expiry bucket. A value on an edge belongs to the lower bucket; a tier begins above its bound."""
    bucket = sum(((F.col("dte") > e).cast("int") for e in edges), F.lit(0))
    tier = sum(((F.abs("delta") > t).cast("int") for t in tiers), F.lit(0))
    rows = quotes.withColumns({"bucket": bucket, "tier": tier})
    fits = rows.groupBy("tier", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_intercept("half", "mid"), 6).alias("a"), F.round(F.regr_slope("half", "mid"), 6).alias("b"))
    return fits.join(quantiles(rows, ["tier", "bucket"], "half", [0.5]), ["tier", "bucket"], "left").withColumnRenamed("q0", "median_half").withColumn("median_half", F.round("median_half", 6))
