"""Parity forwards of a tape: pairs of opposite prints, the near forward, ratios of the other expiries to it, spot.

All functions take `keys` that no row crosses: the trading day, or the day and a slot. Every group is one of these keys and an expiry (and
strike), so work spreads over days, slots and contracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from . import asof, rolling

ROWS, LEAST, BAND = 20, 5, 0.02


def clean(tape: DataFrame, inside: Column, codes: list[int], least: float) -> DataFrame:
    """Prints inside a span of time with an allowed condition and at least the least price; an expiry on a Saturday is the Friday before."""
    rows = tape.where(F.col("condition").isin(codes) & (F.col("price") >= least) & inside)
    return rows.withColumn("expiry", F.when(F.dayofweek("expiry") == 7, F.date_sub("expiry", 1)).otherwise(F.col("expiry")))


def pairs(tape: DataFrame, keys: list[str], rate: float, within: float) -> DataFrame:
    """keys, expiry, strike, ts, call, event_id, fwd: each print with the latest opposite print of its contract at or before it, at most `within` seconds old; fwd is
    strike + (call - put) * exp(rate * years). Of prints at one instant the largest event_id is the latest.

    One shuffle by keys and contract serves both directions: running maxima of calls and of puts.
    """
    w = Window.partitionBy(*keys, "expiry", "strike").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda side: F.max(F.when(side, F.struct("ts", "event_id", "price"))).over(w)
    rows = tape.withColumns({"_c": last(F.col("call")), "_p": last(~F.col("call"))}).withColumn("_o", F.when(F.col("call"), F.col("_p")).otherwise(F.col("_c")))
    rows = rows.where(F.col("_o").isNotNull() & (clock.seconds(F.col("ts"), F.col("_o.ts")) <= within))
    gap = F.when(F.col("call"), F.col("price") - F.col("_o.price")).otherwise(F.col("_o.price") - F.col("price"))
    return rows.select(*keys, "expiry", "strike", "ts", "call", "event_id", (F.col("strike") + gap * F.exp(rate * clock.years(F.col("ts"), F.col("expiry")))).alias("fwd"))


def near_expiry(prs: DataFrame, keys: list[str], need: int) -> DataFrame:
    """keys, near: the first expiry on or after the day with `need` pairs."""
    counts = prs.where("expiry >= day").groupBy(*keys, "expiry").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= need).groupBy(*keys).agg(F.min("expiry").alias("near"))


def near_forward(prs: DataFrame, keys: list[str], need: int, least: int = LEAST) -> DataFrame:
    """keys, near, ts, event_id, call, fnear of the near expiry's pairs. A day's pairs of one expiry are ordered in one task; the test tape aside, that is the prints of one expiry and day."""
    return medians(prs.join(near_expiry(prs, keys, need), keys).where("expiry = near"), [*keys, "near"], least)


def medians(rows: DataFrame, keys: list[str], least: int | Column) -> DataFrame:
    """keys, ts, call, event_id, fnear: running medians of 20 over pairs of one expiry, after those whose strike is more than 2 % off a first running median have left."""
    return rolling.medians(rows, keys, ["ts", "call", "event_id"], "fwd", "fnear", ROWS, F.lit(least), ("strike", BAND))


def with_dividends(rows: DataFrame, dividends: DataFrame) -> DataFrame:
    """rows with _divs, the list of all (ex_date, amount): a few a year, and one constant for all rows."""
    return rows.withColumn("_divs", dividends.agg(F.collect_list(F.struct("ex_date", F.col("amount").cast("double").alias("amount")))).scalar())


def dividends_between(a: Column, b: Column) -> Column:
    """The sum of the dividends in _divs with a < ex_date <= b."""
    return F.aggregate(F.filter("_divs", lambda x: (x["ex_date"] > a) & (x["ex_date"] <= b)), F.lit(0.0), lambda s, x: s + x["amount"])


def carry(fnear: Column, near: Column, ts: Column, expiry: Column, rate: float, paid: Column) -> Column:
    """An expiry's forward over the near one by carry alone: spot (the near forward discounted, less what is paid between the expiries) grown to the expiry."""
    return (fnear * F.exp(-rate * clock.years(ts, near)) - paid) * F.exp(rate * clock.years(ts, expiry)) / fnear


def _last_near(rows: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """rows with fnear and near of the last near forward at or before ts."""
    value = near.groupBy(*keys, "ts").agg(F.max_by(F.struct("fnear", "near"), F.struct("call", "event_id")).alias("_v"))
    got = asof.asof_join(rows, value, "ts", keys, "_v", "_f").where("_f is not null")
    return got.select(*rows.columns, F.col("_f.fnear").alias("fnear"), F.col("_f.near").alias("near"))


def ratios(prs: DataFrame, near: DataFrame, keys: list[str], rate: float, dividends: DataFrame, least: int = LEAST) -> DataFrame:
    """keys, expiry, ts, ratio: for each other expiry the running median of its pair forwards over the near forward, from pairs within 2 % of the carried forward."""
    rows = with_dividends(_last_near(prs, near, keys).where("expiry != near"), dividends)
    ref = F.col("fnear") * carry(F.col("fnear"), F.col("near"), F.col("ts"), F.col("expiry"), rate, dividends_between(F.col("near"), F.col("expiry")))
    rows = rows.where(F.abs(F.col("strike") / ref - 1) <= BAND).withColumn("_r", F.col("fwd") / F.col("fnear"))
    return rolling.medians(rows, [*keys, "expiry"], ["ts", "call", "event_id"], "_r", "ratio", ROWS, F.lit(least))


def forward_at(rows: DataFrame, near: DataFrame, ratio: DataFrame, keys: list[str], rate: float, dividends: DataFrame) -> DataFrame:
    """rows (with ts and expiry) and fnear, near, forward: the near forward times 1 (near expiry), the last ratio, or carry. Rows before any near forward leave."""
    got = _last_near(rows, near, keys)
    one = ratio.groupBy(*keys, "expiry", "ts").agg(F.max_by("ratio", F.struct("call", "event_id")).alias("ratio"))
    got = asof.asof_join(got, one, "ts", [*keys, "expiry"], "ratio", "_ratio")
    own = carry(F.col("fnear"), F.col("near"), F.col("ts"), F.col("expiry"), rate, dividends_between(F.col("near"), F.col("expiry")))
    factor = F.when(F.col("expiry") == F.col("near"), 1.0).otherwise(F.coalesce("_ratio", own))
    return with_dividends(got, dividends).withColumn("forward", F.col("fnear") * factor).drop("_ratio", "_divs")


def with_spot(rows: DataFrame, rate: float, dividends: DataFrame) -> DataFrame:
    """rows (ts, day, near, fnear) with spot: the near forward discounted from the instant, less dividends after the day up to the near expiry."""
    spot = F.col("fnear") * F.exp(-rate * clock.years(F.col("ts"), F.col("near"))) - dividends_between(F.col("day"), F.col("near"))
    return with_dividends(rows, dividends).withColumn("spot", spot).drop("_divs")
