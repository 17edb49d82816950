"""Matching of orders, trips and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_orders(opens: DataFrame, closes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """opens with the close of the same keys and, among equal keys, of the same position; nulls without one."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return opens.withColumn("_n", place).join(closes.withColumn("_n", place).drop(order), [*keys, "_n"], "left").drop("_n")


def placed(rows: DataFrame, group: list[str], day: str, order: str) -> DataFrame:
    """rows with `_n`, their position in the group by day and order. Days are counted first, so that a window over rows holds one day of a group, and one over days a row a day. A row of an unknown group or day stays, without a position."""
    counts = rows.groupBy(*group, day).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*group).orderBy(day)) - F.col("_c")).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*group, day).orderBy(order))
    return rows.withColumn("_i", inside).join(before, [*group, day], "left").withColumn("_n", F.col("_before") + F.col("_i")).drop("_before", "_i")


def match_with_old(opens: DataFrame, closes: DataFrame, keys: list[str], group: list[str], day: str, end: str, order: str) -> DataFrame:
    """opens (order, group, keys, day) with the `close` (its order) and end of their close: by keys and position among equal keys; closes that lack a key, as old logs wrote them, go by position in their group to the opens left. Null without one."""
    known = [F.col(k).isNotNull() for k in keys]
    whole = known[0]
    for k in known[1:]:
        whole = whole & k
    named = closes.select(*closes.columns, F.col(order).alias("close"))
    first = match_orders(opens, named.where(whole).select(*keys, order, "close", end), keys, order)
    left = placed(first.where("close is null").drop("close", end), group, day, order)
    old = placed(named.where(~whole), group, end, order).select(*group, "_n", "close", end)
    return first.where("close is not null").unionByName(left.join(old, [*group, "_n"], "left").drop("_n"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row: what a one-to-one merge must not have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compare_books(trips: DataFrame, a: str, b: str) -> DataFrame:
    """side, entry, n, status, pnl_a, pnl_b of the trips of two books by side, entry and position: same exit and reason, changed, or in one book only."""
    place = F.row_number().over(Window.partitionBy("book", "side", "entry").orderBy("trade"))
    rows = trips.where(F.col("book").isin(a, b)).withColumn("n", place)
    one = lambda book, x: rows.where(F.col("book") == book).select("side", "entry", "n", *[F.col(c).alias(f"{c}_{x}") for c in ("exit", "reason", "pnl")])
    same = (F.col("exit_a") == F.col("exit_b")) & (F.col("reason_a") == F.col("reason_b"))
    status = F.when(F.col("exit_b").isNull(), "first").when(F.col("exit_a").isNull(), "second").when(same, "same").otherwise("changed")
    return one(a, "a").join(one(b, "b"), ["side", "entry", "n"], "full_outer").select("side", "entry", "n", status.alias("status"), "pnl_a", "pnl_b")


def inside_others(trips: DataFrame) -> DataFrame:
    """book, trips, inside: entries that lie strictly inside another trip of the book. A running latest exit of all earlier entries tells, without a join on ranges."""
    days = trips.groupBy("book", "entry").agg(F.max("exit").alias("exit"), F.count(F.lit(1)).alias("n"))  # a row a day
    before = Window.partitionBy("book").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    rows = days.withColumn("_last", F.max("exit").over(before))
    return rows.groupBy("book").agg(F.sum("n").alias("trips"), F.coalesce(F.sum(F.when(F.col("_last") > F.col("entry"), F.col("n"))), F.lit(0)).alias("inside"))


def marginal(daily: DataFrame, book: str, reference: str) -> DataFrame:
    """date, pnl of a book less the reference book's: 0 on days that only one of the two has."""
    one = lambda b, c: daily.where(F.col("book") == b).select("date", F.col("pnl").alias(c))
    both = one(book, "_a").join(one(reference, "_b"), "date", "full_outer")
    return both.select("date", F.coalesce(F.col("_a") - F.col("_b"), F.lit(0.0)).alias("marginal"))


def differences(held: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of which the number of rows held and recorded differ."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = count(held, "held").join(count(recorded, "recorded"), keys, "full_outer").na.fill(0, ["held", "recorded"])
    return both.where("held != recorded")
