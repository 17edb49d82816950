"""Paths of trades over marks: entries, profit along the path, exits, hedges, books. A path has all marks of its contract while the trade may live."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTRACT = ["expiry", "strike", "call"]


def entries(marks: DataFrame, before: int) -> DataFrame:
    """entry (event_id), contract, day0, ts0, mid0, sign: the first mark of each contract and day before an hour. Every third is bought, the others are sold."""
    first = marks.where(F.hour("ts") < before).groupBy("day", *CONTRACT).agg(F.min_by(F.struct("event_id", "ts", "mid"), F.struct("ts", "event_id")).alias("_m"))
    sign = F.when(F.col("_m.event_id") % 3 == 0, 1).otherwise(-1)
    return first.where(F.col("day") <= F.col("expiry")).select(F.col("_m.event_id").alias("entry"), *CONTRACT, F.col("day").alias("day0"), F.col("_m.ts").alias("ts0"), F.col("_m.mid").alias("mid0"), sign.alias("sign"))


def slot_marks(marks: DataFrame, minutes: int) -> DataFrame:
    """The last mark of each contract, day and slot of so many minutes: what a desk that acts once a slot sees. A path over these has at most as many rows as its days have slots."""
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / minutes)
    rest = [c for c in marks.columns if c not in ("day", *CONTRACT)]
    return marks.groupBy("day", *CONTRACT, slot.alias("_slot")).agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("_m")).select("day", *CONTRACT, *[f"_m.{c}" for c in rest])


def path(opened: DataFrame, marks: DataFrame, hold: int) -> DataFrame:
    """opened with each later mark of its contract up to `hold` days and to expiry, and `pnl` for one contract of 100.

    A mark is sent to the hold + 1 days on which it could have been entered, and meets its entries by contract and day: an equal join whose fan-out is fixed.
    """
    sent = marks.where(F.col("day") <= F.col("expiry")).select(*CONTRACT, "event_id", "ts", "day", "fwd", "delta", "mid", F.explode(F.sequence(F.date_sub("day", hold), F.col("day"))).alias("day0"))
    rows = opened.join(sent, [*CONTRACT, "day0"]).where(F.col("ts") > F.col("ts0"))
    return rows.withColumn("pnl", F.col("sign") * (F.col("mid") - F.col("mid0")) * 100)


def exit_reason(days: Column, pnl: Column, premium: Column, hold: int, stop: float, take: float) -> Column:
    return F.when(days >= hold, "time").when(pnl <= -stop * premium, "stop").when(pnl >= take * premium, "profit")


def exits(rows: DataFrame, hold: int, stop: float, take: float) -> DataFrame:
    """entry, contract, day0, sign, mid0, reason, exit_id, exit_ts, exit_day, pnl, downside, score of each path: the first mark with a reason, else the last one (reason 'end').

    downside: root of the summed squares of the falls on the way to the exit; score: pnl over it, null without a fall.
    """
    reason = exit_reason(F.datediff("day", "day0"), F.col("pnl"), F.col("mid0") * 100, hold, stop, take)
    order = F.struct("ts", "event_id")
    w = Window.partitionBy("entry").orderBy("ts", "event_id")
    until = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_why", reason).withColumn("_done", F.count("_why").over(until)).where("_done = 0")
    rows = rows.withColumn("_fall", F.least(F.col("pnl") - F.lag("pnl", 1, 0.0).over(w), F.lit(0.0)))
    last = lambda c: F.max_by(c, order)
    out = rows.groupBy("entry", *CONTRACT, "day0", "sign", "mid0").agg(
        F.coalesce(F.max("_why"), F.lit("end")).alias("reason"), last("event_id").alias("exit_id"), F.max("ts").alias("exit_ts"), last("day").alias("exit_day"), last("pnl").alias("pnl"), F.sqrt(F.sum(F.col("_fall") * F.col("_fall"))).alias("downside"))
    return out.withColumn("score", F.when(F.col("downside") > 0, F.col("pnl") / F.col("downside")))


def hedged(rows: DataFrame, band: float) -> DataFrame:
    """entry, moves, shares, hedge_pnl: shares follow -sign * 100 * delta, but only when the gap reaches the band. Paths are sorted by trade and time and read as a stream of batches, which carries one trade's state: however long a path is, no
    task holds it."""
    target = F.bround(-F.col("sign") * 100 * F.col("delta")).cast("double")

    def fold(frames):
        entry, moves, shares, spot, gain = None, 0, 0.0, None, 0.0
        for f in frames:
            out = []
            for e, goal, fwd in zip(f["entry"].tolist(), f["goal"].tolist(), f["fwd"].tolist()):
                if e != entry:
                    if entry is not None:
                        out.append((entry, moves, shares, gain))
                    entry, moves, shares, spot, gain = e, 0, 0.0, fwd, 0.0
                gain, spot = gain + shares * (fwd - spot), fwd
                if abs(goal - shares) >= band:
                    moves, shares = moves + 1, goal
            if out:
                yield pd.DataFrame(out, columns=names)
        if entry is not None:
            yield pd.DataFrame([(entry, moves, shares, gain)], columns=names)

    names = ["entry", "moves", "shares", "hedge_pnl"]
    paths = rows.select("entry", "ts", "event_id", target.alias("goal"), "fwd").repartition("entry").sortWithinPartitions("entry", "ts", "event_id")
    return paths.select("entry", "goal", "fwd").mapInPandas(fold, "entry long, moves int, shares double, hedge_pnl double")


def busy_periods(trips: DataFrame, book: list[str], key: str, start: str, end: str, places: int) -> DataFrame:
    """trips that could be taken, with `period`: within a book a new one begins where every trip before has ended. Of the trips that begin on one day only the first `places` (by key) can be taken, so a book has at most as many
    rows as days times places, however many candidates there are."""
    first = Window.partitionBy(*book, start).orderBy(key)
    rows = trips.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= places).drop("_i")
    w = Window.partitionBy(*book).orderBy(start, key)
    until = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", F.coalesce((F.col(start) > until).cast("int"), F.lit(1))).withColumn("period", F.sum("_new").over(w)).drop("_new")


def taken(trips: DataFrame, book: list[str], key: str, places: int, start: str = "day0", end: str = "exit_day", side: str | None = None) -> DataFrame:
    """trips with `taken`: in order of start, then key, a trip is taken if fewer than `places` taken trips of its book are still open (a trip is open to its last day) and, with `side`, all of them have its side.

    The book is cut at instants at which no candidate is open, and each busy period is decided by itself, by a fold whose state is the ends and side of what is open. Trips must end on or after their start. Whatever a trip
    changes about a later one besides its time is not modelled."""
    busy = busy_periods(trips, [*book, *([side] if side else [])], key, start, end, places)
    if side:  # each side has its own first trips of a day; periods are those of both sides together
        busy = busy_periods(busy.drop("period"), book, key, start, end, 2 * places)
    row = F.struct(F.col(start).alias("s"), F.col(key).alias("k"), F.col(end).alias("e"), (F.col(side) if side else F.lit("")).alias("side"))
    lists = busy.groupBy(*book, "period").agg(F.array_sort(F.collect_list(row)).alias("_t"))
    kind = busy.schema[end].dataType.simpleString()
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("open"), F.lit("").alias("side"), F.array().cast(f"array<{busy.schema[key].dataType.simpleString()}>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        live = F.filter(s["open"], lambda e: e >= x["s"])
        ok = (F.size(live) < places) & ((F.size(live) == 0) | (s["side"] == x["side"]))
        return F.struct(F.when(ok, F.concat(live, F.array(x["e"]))).otherwise(live).alias("open"), F.when(ok, x["side"]).otherwise(s["side"]).alias("side"), F.when(ok, F.concat(s["kept"], F.array(x["k"]))).otherwise(s["kept"]).alias("kept"))

    kept = lists.select(F.explode(F.aggregate("_t", begin, step)["kept"]).alias(key)).withColumn("taken", F.lit(True))
    return trips.join(kept, key, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def book_days(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """call, day, realized, open, total: profit closed so far, profit of the trips still open at their last mark of the day, and the sum. Books are the two rights."""
    ends = closed.select("entry", "exit_day")
    marks = rows.join(ends, "entry").where(F.col("day") < F.col("exit_day")).groupBy("call", "day", "entry").agg(F.max_by("pnl", F.struct("ts", "event_id")).alias("_o"))
    held = marks.groupBy("call", "day").agg(F.sum("_o").alias("open"))
    done = closed.groupBy("call", F.col("exit_day").alias("day")).agg(F.sum("pnl").alias("_r"))
    w = Window.partitionBy("call").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    both = held.join(done, ["call", "day"], "full_outer").na.fill(0.0, ["open", "_r"]).withColumn("realized", F.sum("_r").over(w))
    return both.select("call", "day", "realized", "open", (F.col("realized") + F.col("open")).alias("total"))
