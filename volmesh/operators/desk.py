"""Tables of a desk: margins, hedge ratios, robust spread fits, panels of candidates, live books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def margin(spot: Column, strike: Column, mid: Column, call: Column) -> Column:
    """A short option's margin: its price and the higher of a fifth of the spot less what it is out of the money, and a tenth of the strike (put) or spot (call); for 100."""
    out = F.greatest(F.when(call, strike - spot).otherwise(spot - strike), F.lit(0.0))
    return 100 * (mid + F.greatest(0.2 * spot - out, 0.1 * F.when(call, spot).otherwise(strike)))


def hedge_ratio(premium: Column, low: float, high: float) -> Column:
    """1 under the low premium, 0.5 up to the high one, 0 above: rich shorts go unhedged. An unknown premium is hedged."""
    return F.when(premium > high, 0.0).when(premium > low, 0.5).otherwise(1.0)


def least_absolute(rows: DataFrame, keys: list[str], y: str, x: str, most: int = 50, near: float = 1e-8, least: float = 1e-4, block: int = 10) -> DataFrame:
    """keys, a, b: the line of least absolute deviations by reweighted least squares, until no coefficient moves by more than `near`, or `most` passes.

    A pass is one aggregation with map-side sums; the lines (a row a key) are what is broadcast, never the rows, whatever their size, and a pass carries the line it started from, so that a block of passes is a plan without branches.
    After a block the lines are written (which cuts lineage), the keys that stand still leave with their rows, and the driver learns whether any are left."""
    w, u, v = F.col("_w"), F.col(x), F.col(y)

    def line(part: DataFrame, *last: Column) -> DataFrame:
        s = part.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * u).alias("u"), F.sum(w * v).alias("v"), F.sum(w * u * u).alias("uu"), F.sum(w * u * v).alias("uv"), *last)
        slope = (F.col("w") * F.col("uv") - F.col("u") * F.col("v")) / (F.col("w") * F.col("uu") - F.col("u") * F.col("u"))
        kept = ["_a", "_b"] if last else []
        return s.select(*keys, slope.alias("b"), F.col("u").alias("_u"), F.col("v").alias("_v"), F.col("w").alias("_t"), *kept).select(*keys, ((F.col("_v") - F.col("b") * F.col("_u")) / F.col("_t")).alias("a"), "b", *kept)

    rows = rows.select(*keys, y, x).persist()
    model, done, live = line(rows.withColumn("_w", F.lit(1.0))), None, rows
    for at in range(1, most, block):
        for _ in range(min(block, most - at)):
            met = live.join(F.broadcast(model.select(*keys, "a", "b")), keys).withColumn("_w", 1 / F.greatest(F.abs(v - F.col("a") - F.col("b") * u), F.lit(least)))
            model = line(met, F.max("a").alias("_a"), F.max("b").alias("_b"))  # one value a key
        both = store.settle(model)
        still = F.greatest(F.abs(F.col("a") - F.col("_a")), F.abs(F.col("b") - F.col("_b"))) <= near
        stands = both.where(F.coalesce(still, F.lit(True))).select(*keys, "a", "b")
        done = stands if done is None else done.unionByName(stands)
        model = both.where(~still).select(*keys, "a", "b")
        if model.isEmpty():
            break
        live = rows.join(F.broadcast(model.select(*keys)), keys, "left_semi")
    out = model if done is None else done.unionByName(model)
    rows.unpersist()
    return out


def panel(candidates: DataFrame, labels: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Candidates with their label (skips have 0), of the days on which every candidate but the skips has one."""
    rows = candidates.join(labels, keys, "left").withColumn("label", F.when(F.col("skip"), 0.0).otherwise(F.col("label")))
    whole = rows.groupBy(day).agg(F.bool_and(F.col("label").isNotNull()).alias("_ok")).where("_ok").select(day)
    return rows.join(whole, day, "left_semi")


def mix(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """group, kind, n, share: shares of kinds in each group."""
    g = rows.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def delta_profit(rows: DataFrame) -> DataFrame:
    """entry, delta_pnl: along a path, the delta at each mark times the move of the spot to the next one, for 100."""
    w = Window.partitionBy("entry").orderBy("ts", "event_id")
    gain = F.col("sign") * 100 * F.col("delta") * (F.lead("fwd").over(w) - F.col("fwd"))
    return rows.withColumn("_g", gain).groupBy("entry").agg(F.coalesce(F.sum("_g"), F.lit(0.0)).alias("delta_pnl"), F.count(F.lit(1)).alias("marks"))


def live_book(days: DataFrame) -> DataFrame:
    """call, last, drawdown, days, up: of each book the last total, the largest fall from a peak of at least 0, days and days on which the total rose."""
    w = Window.partitionBy("call").orderBy("day")
    rows = days.withColumns({"_down": F.greatest(F.max("total").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) - F.col("total"), "_up": F.col("total") > F.lag("total", 1, 0.0).over(w)})
    return rows.groupBy("call").agg(F.max_by("total", "day").alias("last"), F.max("_down").alias("drawdown"), F.count(F.lit(1)).alias("days"), F.count(F.when(F.col("_up"), 1)).alias("up"))


def snapshot_of_day(snapshots: DataFrame) -> DataFrame:
    """The first usable snapshot of each day, else the first."""
    return snapshots.groupBy("day").agg(F.min_by(F.struct("hour", "usable"), F.struct(~F.col("usable"), F.col("hour"))).alias("_s")).select("day", "_s.*")


def timeline(cards: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """Cards and planned items on one line; a planned item leaves once its card exists."""
    return cards.select(key, "started", F.lit("card").alias("kind")).unionByName(planned.join(cards.select(key), key, "left_anti").select(key, "started", F.lit("planned").alias("kind")))


def check_window(start: str, end: str, first: str, last: str, holdout: str, final: bool = False) -> None:
    """Refuses a window of days (ISO text) that begins before the first day of data, ends after the last, reaches the hold-out in other than the final run, or is empty."""
    for wrong, why in ((start < first, f"start {start} is before the first day of data ({first})"), (end > last, f"end {end} is after the last day of data ({last})"), (end >= holdout and not final, f"end {end} reaches the hold-out (from {holdout})"), (start > end, f"start {start} is after end {end}")):
        if wrong:
            raise ValueError(f"{why}; refused")


def embargo(trips: DataFrame, bound: str, days: int) -> DataFrame:
    """trips that enter before a hold-out and not within `days` of it, with those still open at the bound marked to close there."""
    end = F.to_date(F.lit(bound))
    return trips.where(F.col("entry") < F.date_sub(end, days)).withColumns({"forced": F.col("exit") > end, "exit": F.least("exit", end)})
