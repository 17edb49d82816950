"""Daily series: total returns, alignment, carrying forward, audits of days and slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normal_bars(raw: DataFrame, names: dict[str, str], date: str) -> DataFrame:
    """A vendor's bars under the library's names, with a date; rows that lack a price or the volume leave."""
    return raw.withColumnsRenamed({**names, date: "date"}).withColumn("date", F.to_date("date")).na.drop(subset=list(names.values()))


def total_return(bars: DataFrame, ret: str) -> DataFrame:
    """symbol, date, open, high, low, close with dividends reinvested: the path of `ret`, scaled so that the last close stays."""
    w = Window.partitionBy("symbol").orderBy("date")
    grown = F.sum(F.log(1 + F.coalesce(F.col(ret), F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = bars.withColumn("_g", grown)
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("_g", "close"), "date").alias("_end"))
    factor = F.exp(F.col("_g") - F.col("_end._g")) * F.col("_end.close") / F.col("close")
    return rows.join(last, "symbol").select("symbol", "date", *[(F.col(c) * factor).alias(c) for c in ("open", "high", "low", "close")])


def splice(listed: DataFrame, closes: DataFrame) -> DataFrame:
    """listed, then of each symbol the closes after its last day as flat bars; `spliced` tells which."""
    end = listed.groupBy("symbol").agg(F.max("date").alias("_end"))
    later = closes.join(end, "symbol", "left").where("_end is null or date > _end")
    c = F.col("close")
    return listed.select("symbol", "date", "open", "high", "low", "close", F.lit(False).alias("spliced")).unionByName(later.select("symbol", "date", *[c.alias(x) for x in ("open", "high", "low", "close")], F.lit(True).alias("spliced")))


def align(series: list[DataFrame], calendar: DataFrame, carried: list[str], ended: list[str]) -> DataFrame:
    """Series of one row a date on the days of a calendar, the last known value carried forward. Columns in `ended` are null after their last own day.

    Each series has a row a calendar day at most, so that one ordered window over all of them stays small at any size of the tables behind.
    """
    rows = reduce(lambda a, b: a.join(b, "date", "full_outer"), series).join(calendar.select("date", F.lit(True).alias("_listed")), "date", "full_outer")
    all_days = Window.partitionBy(F.lit(1))
    w = all_days.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    value = lambda c: F.last(c, ignorenulls=True).over(w)
    until = lambda c: F.when(F.col("date") <= F.max(F.when(F.col(c).isNotNull(), F.col("date"))).over(all_days), value(c))
    return rows.select("date", "_listed", *[(until(c) if c in ended else value(c)).alias(c) for c in carried]).where("_listed").drop("_listed")


def missing_days(rows: DataFrame, key: str, day: str) -> DataFrame:
    """key, day: weekdays between the first and last day of a key without rows."""
    have = rows.select(key, F.col(day).alias("day")).distinct()
    span = have.groupBy(key).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    due = span.select(key, F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return due.join(have, [key, "day"], "left_anti")


def slot_audit(prints: DataFrame, first: int, minutes: int, slots: int, least: int) -> DataFrame:
    """day, slot, n, why for each slot of each day with prints: slots begin `first` minutes into the day; why is 'none', 'few' or null."""
    at = F.floor((F.hour("ts") * 60 + F.minute("ts") - first) / minutes)
    counts = prints.select(F.to_date("ts").alias("day"), at.cast("int").alias("slot")).where(F.col("slot").between(0, slots - 1)).groupBy("day", "slot").agg(F.count(F.lit(1)).alias("n"))
    grid = prints.select(F.to_date("ts").alias("day")).distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return grid.join(counts, ["day", "slot"], "left").select("day", "slot", n.alias("n"), F.when(n == 0, "none").when(n < least, "few").alias("why"))


def evenly(days: DataFrame, day: str, n: int) -> DataFrame:
    """n of the distinct days, spread evenly from the first to the last (all, if there are no more than n). The window runs over one row a calendar day."""
    d = days.select(F.col(day).alias("day")).distinct()
    w = Window.partitionBy(F.lit(1))
    r = d.withColumns({"_i": F.row_number().over(w.orderBy("day")) - 1, "_n": F.count(F.lit(1)).over(w)})
    # position i is taken when floor(j * (N - 1) / (n - 1)) = i for some j: the least j that reaches i is ceil(i * (n - 1) / (N - 1))
    j = F.ceil(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return r.where((F.col("_n") <= n) | (F.floor(j * (F.col("_n") - 1) / (n - 1)) == F.col("_i"))).select("day")


def replace_by_key(log: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """log without the keys of new, and new."""
    return log.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def publishable(rows: DataFrame, places: int = 4) -> DataFrame:
    """Floating columns rounded; what is not finite becomes null."""
    tidy = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, places)).alias(c)
    return rows.select(*[tidy(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in rows.schema.fields])
