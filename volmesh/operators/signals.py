"""Signals, gates, sizing, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band(premium: Column, short: float, long: float) -> Column:
    """short above the short band, long below the long band, else flat; the edges are flat."""
    return F.when(premium > short, "short").when(premium < long, "long").otherwise("flat")


def gated(signal: Column, term: Column, most: float) -> Column:
    """Shorts leave where the term structure is inverted beyond `most`, or unknown."""
    return F.when((signal == "short") & ~F.coalesce(term <= most, F.lit(False)), "flat").otherwise(signal)


def flat_days(signals: DataFrame, n: int) -> DataFrame:
    """signals with `reset`: the last n days were all flat."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1 - n, 0)
    return signals.withColumn("reset", (F.count(F.lit(1)).over(w) == n) & (F.sum((F.col("signal") == "flat").cast("int")).over(w) == n))


def premium_size(premium: Column, budget: float, multiplier: int = 100) -> Column:
    """Most contracts within the budget, at least 1."""
    return F.greatest(F.lit(1), F.floor(budget / (premium * multiplier)).cast("int"))


def fill_price(mid: Column, half: Column, buy: Column, multiple: float, tick: float = 0.01) -> Column:
    """Mid plus or minus the half-spread times the multiple, on the tick, at least one tick."""
    raw = mid + F.when(buy, 1).otherwise(-1) * multiple * half
    return F.greatest(F.bround(raw / tick) * tick, F.lit(tick))


def fee(units: Column, each: float, least: float) -> Column:
    return F.greatest(units * each, F.lit(least))


def half_spread(quotes: DataFrame, model: DataFrame, edges: list[int], tiers: list[float], floor: float) -> DataFrame:
    """quotes with `fitted`: max(floor, a + b * mid) of the quote's tier and bucket. The model has one row for each tier and bucket, at most (len(tiers) + 1) * (len(edges) + 1), so it is broadcast."""
    bucket = sum(((F.col("dte") > e).cast("int") for e in edges), F.lit(0))
    tier = sum(((F.abs("delta") > t).cast("int") for t in tiers), F.lit(0))
    rows = quotes.withColumns({"bucket": bucket, "tier": tier})
    small = model.where(F.col("tier").between(0, len(tiers)) & F.col("bucket").between(0, len(edges))).dropDuplicates(["tier", "bucket"])
    return rows.join(F.broadcast(small.select("tier", "bucket", "a", "b")), ["tier", "bucket"], "left").withColumn("fitted", F.greatest(F.lit(floor), F.col("a") + F.col("b") * F.col("mid"))).drop("a", "b")
