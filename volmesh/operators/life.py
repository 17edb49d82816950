"""The life of trades: marks along the way, reasons to exit, closes at fills or settlement, gaps, hedges, the book's equity.

A trade meets one mark of its contract a day, so a path has as many rows as the trade has days; trades and books run beside each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendar, signals

CONTRACT = ["expiry", "strike", "call"]


@dataclass(frozen=True)
class Rules:
    exit_dte: int = 2
    short_stop: float = 1.0
    long_stop: float = 0.5
    short_take: float = 0.5
    flat_days: int = 2
    crash_days: int = 3
    cool_days: int = 3
    last_day: str = "2024-01-26"  # before a hold-out: all that is open closes
    no_entry: str = "2024-01-22"  # entries from here on would reach into it
    fee: float = 0.65
    least_fee: float = 1.0
    multiple: float = 1.0


def half(mid: Column) -> Column:
    return F.greatest(F.lit(0.02), 0.01 * mid)


def signal_days(rows: DataFrame, flat_days: int) -> DataFrame:
    """day, signal, flat_run: whether it and the days before it, flat_days in all, are flat. A row a day."""
    w = Window.orderBy("day").rowsBetween(1 - flat_days, 0)
    return rows.select("day", "signal", (F.count(F.when(F.col("signal") == "flat", 1)).over(w) == flat_days).alias("flat_run"))


def opened(first: DataFrame, days: DataFrame, rules: Rules) -> DataFrame:
    """first (entry, contract, day0, mid0, delta0, fwd0) on days with a signal before the embargo, with side, sign and crash (held for days only)."""
    rows = first.join(days.select(F.col("day").alias("day0"), F.col("signal").alias("side")), "day0").where((F.col("side") != "flat") & (F.col("day0") < F.to_date(F.lit(rules.no_entry))))
    return rows.withColumns({"sign": F.when(F.col("side") == "long", 1).otherwise(-1), "crash": (F.col("side") == "long") & (F.col("entry") % 7 == 0)})


def day_marks(marks: DataFrame) -> DataFrame:
    """The last mark of each contract and day."""
    cols = ["event_id", "ts", "fwd", "mark", "delta", "fillable", "mid"]
    return marks.groupBy("day", *CONTRACT).agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("_m")).select("day", *CONTRACT, *[f"_m.{c}" for c in cols])


def intrinsic(spot: Column, strike: Column, call: Column) -> Column:
    return F.greatest(F.when(call, spot - strike).otherwise(strike - spot), F.lit(0.0))


def paths(trades: DataFrame, daily: DataFrame) -> DataFrame:
    """trades with each later day's mark until expiry: value (the mark; without one the conservative side of the last mark and intrinsic), shares (held after the row; an unknown delta leaves them),
    option_pnl, hedge_pnl (so far) and pnl. Equal join by contract: as many rows as trades have days."""
    rows = trades.join(daily, CONTRACT).where(F.col("day") > F.col("day0"))
    w = Window.partitionBy("entry").orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    worth = intrinsic(F.col("fwd"), F.col("strike"), F.col("call"))
    last = F.coalesce(F.last("mark", ignorenulls=True).over(upto), F.col("mid0"))
    rows = rows.withColumn("_last", last).withColumn("value", F.coalesce("mark", F.when(F.col("sign") < 0, F.greatest("_last", worth)).otherwise(F.least("_last", worth))))
    start = -F.col("sign") * 100 * F.col("delta0")
    rows = rows.withColumn("shares", F.coalesce(F.last(-F.col("sign") * 100 * F.col("delta"), ignorenulls=True).over(upto), start))
    gain = F.coalesce(F.lag("shares").over(w), start) * (F.col("fwd") - F.coalesce(F.lag("fwd").over(w), F.col("fwd0")))
    rows = rows.withColumn("_g", gain).withColumns({"option_pnl": F.col("sign") * (F.col("value") - F.col("mid0")) * 100, "hedge_pnl": F.sum("_g").over(upto)})
    return rows.withColumn("pnl", F.col("option_pnl") + F.col("hedge_pnl")).drop("_last", "_g")


def exit_reason(rules: Rules, dte: Column, pnl: Column, premium: Column, side: Column, signal: Column, flat_run: Column, crash: Column, day0: Column, day: Column) -> Column:
    """In this order: time, stop, profit (shorts), flip, flat; crash positions by days held only; then the embargo."""
    stop = F.when(side == "short", rules.short_stop).otherwise(rules.long_stop)
    flip = signal == F.when(side == "short", "long").otherwise("short")
    usual = F.when(dte <= rules.exit_dte, "time").when(pnl <= -stop * premium, "stop").when((side == "short") & (pnl >= rules.short_take * premium), "profit").when(flip, "flip").when(flat_run, "flat")
    days = F.when(calendar.weekdays_between(day0, day) >= rules.crash_days, "crash_time")
    return F.coalesce(F.when(crash, days).otherwise(usual), F.when(day == F.to_date(F.lit(rules.last_day)), "embargo"))


def judged(rows: DataFrame, days: DataFrame, rules: Rules) -> DataFrame:
    """paths with reason (null: stays) and open (no close before)."""
    rows = rows.join(days, "day", "left")
    reason = exit_reason(rules, F.datediff("expiry", "day"), F.col("pnl"), F.col("mid0") * 100, F.col("side"), F.col("signal"), F.coalesce("flat_run", F.lit(False)), F.col("crash"), F.col("day0"), F.col("day"))
    rows = rows.withColumn("reason", reason).withColumn("_closes", F.col("reason").isNotNull() & F.col("fillable"))
    before = Window.partitionBy("entry").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("open", F.count(F.when(F.col("_closes"), 1)).over(before) == 0)


def gap_events(rows: DataFrame) -> DataFrame:
    """entry, day, event of judged rows while open: a close without a fill (it stays open), no mark, no delta."""
    kinds = F.array_compact(F.array(F.when(F.col("reason").isNotNull() & ~F.col("fillable"), "no_fill"), F.when(F.col("mark").isNull(), "no_mark"), F.when(F.col("delta").isNull(), "no_delta")))
    return rows.where("open").select("entry", "day", F.explode(kinds).alias("event"))


def expiry_spots(marks: DataFrame) -> DataFrame:
    """day, spot: the last spot seen in the fill view, else the last one seen."""
    order = F.struct("ts", "event_id")
    return marks.groupBy("day").agg(F.coalesce(F.max_by(F.when(F.col("fillable"), F.col("fwd")), F.when(F.col("fillable"), order)), F.max_by("fwd", order)).alias("spot"))


def closed(trades: DataFrame, rows: DataFrame, spots: DataFrame, rules: Rules) -> DataFrame:
    """entry, side, reason, exit_day, price, option_pnl, hedge_pnl, pnl, commission, pnl_net, src, shares_left, spot (of an expiry, what its hedge is sold at): closes at the first exit with a fill (mid and half-spread on the tick), and expiries that none came before, at intrinsic value of the expiry day's spot, without a fee."""
    fee = signals.fee(F.lit(1.0), rules.fee, rules.least_fee)
    price = signals.fill_price(F.col("mid"), half(F.col("mid")), F.col("sign") < 0, rules.multiple)
    done = rows.where("open and _closes").select("entry", "side", "sign", "mid0", "reason", F.col("day").alias("exit_day"), price.alias("price"), "hedge_pnl", fee.alias("_fee"), F.lit("fill_smile").alias("src"), F.lit(0.0).alias("shares_left"), F.lit(0.0).alias("spot"))
    tail = rows.groupBy("entry").agg(F.max_by(F.struct("shares", "fwd", "hedge_pnl"), "day").alias("_t"))
    left = trades.join(done.select("entry"), "entry", "left_anti").join(spots.withColumnRenamed("day", "expiry"), "expiry").join(tail, "entry", "left")
    shares, fwd = F.coalesce("_t.shares", -F.col("sign") * 100 * F.col("delta0")), F.coalesce("_t.fwd", F.col("fwd0"))
    gone = left.select("entry", "side", "sign", "mid0", F.lit("expired").alias("reason"), F.col("expiry").alias("exit_day"), intrinsic(F.col("spot"), F.col("strike"), F.col("call")).alias("price"), (F.coalesce("_t.hedge_pnl", F.lit(0.0)) + shares * (F.col("spot") - fwd)).alias("hedge_pnl"), F.lit(0.0).alias("_fee"), F.lit("expiry").alias("src"), shares.alias("shares_left"), "spot")
    out = done.unionByName(gone).withColumn("option_pnl", F.col("sign") * (F.col("price") - F.col("mid0")) * 100).withColumn("pnl", F.col("option_pnl") + F.col("hedge_pnl"))
    return out.withColumn("pnl_net", F.col("pnl") - F.col("_fee") - fee).withColumnRenamed("_fee", "commission").drop("sign", "mid0")


def structures(trades: DataFrame) -> DataFrame:
    """Trades of both rights of one expiry, strike and day as one unit: grp (the smaller entry), one side (that of the smaller entry's), premium of all legs."""
    key = ["expiry", "strike", "day0"]
    g = trades.groupBy(*key).agg(F.count_distinct("call").alias("_n"), F.min("entry").alias("grp"), F.sum("mid0").alias("premium")).where("_n = 2")
    return trades.join(g.drop("_n"), key)


def structure_exits(rows: DataFrame, days: DataFrame, rules: Rules) -> DataFrame:
    """grp, reason, exit_day, pnl: legs judged together on summed premium and profit, on days on which all legs have a row, and closed together where all have a fill."""
    unit = rows.groupBy("grp", "day", "day0", "expiry", "side", "premium").agg(F.count(F.lit(1)).alias("_n"), F.sum("pnl").alias("pnl"), F.bool_and("fillable").alias("fillable")).where("_n = 2")
    unit = unit.withColumns({"entry": F.col("grp"), "mid0": F.col("premium"), "crash": F.lit(False)})
    done = judged(unit, days, rules).where("open and _closes")
    return done.select("grp", "reason", F.col("day").alias("exit_day"), "pnl")


def stop_flags(trades: DataFrame, ends: DataFrame, days: DataFrame, rules: Rules) -> DataFrame:
    """entry, stop, cooling, waiting: the latest stop of either side on a day before the entry (of one day's, that of the later entry); whether it was of the entry's side less than cool_days weekdays ago, and whether it
    was of that side and every signal since, its own day's included, has been the same side.

    Stops and signals are reduced to a row a day first, and running maxima over these rows tell."""
    stops = ends.where("reason = 'stop'").groupBy(F.col("exit_day").alias("day")).agg(F.max(F.struct(F.col("exit_day").alias("at"), "entry", "side")).alias("_s"))
    every = trades.select(F.col("day0").alias("day")).distinct().join(stops, "day", "full_outer").join(days.select("day", "signal"), "day", "full_outer")
    until = lambda n: Window.orderBy("day").rowsBetween(Window.unboundedPreceding, n)  # noqa: E731  a row a day
    away = [F.max(F.when(F.col("signal") != s, F.col("day"))).over(until(0)).alias(f"_{s}") for s in ("long", "short")]
    rows = trades.join(every.select(F.col("day").alias("day0"), F.max("_s").over(until(-1)).alias("_s"), *away), "day0")
    same = F.col("_s.side") == F.col("side")
    cooling = same & (calendar.weekdays_between(F.col("_s.at"), F.col("day0")) < rules.cool_days)
    waiting = same & F.coalesce(F.when(F.col("side") == "long", F.col("_long")).otherwise(F.col("_short")) < F.col("_s.at"), F.lit(True))
    return rows.select("entry", F.col("_s.at").alias("stop"), *[F.coalesce(c, F.lit(False)).alias(n) for c, n in ((cooling, "cooling"), (waiting, "waiting"))])


#: Why a trade is not entered, in the order in which the reasons are asked.
BLOCKS = ("cooloff", "reset_wait", "gate", "weekday", "pick_skip")


def entry_decisions(trades: DataFrame, flags: DataFrame, ratios: DataFrame, picks: DataFrame, gate: float, off: list[int]) -> DataFrame:
    """entry, side, why: the first reason against an entry, null if it is taken. A stop of its side cools off; one that no other signal has followed waits; a short is gated by a term ratio of the day before at or over `gate`; weekdays in
    `off` (0 is Monday) have no entries; a day picked as null has no short. ratios (day, ratio) and picks (day, pick) are a row a day."""
    w = Window.orderBy("day")  # a row a day
    before = ratios.select("day", F.lag("ratio").over(w).alias("_ratio"))
    rows = trades.select("entry", "side", F.col("day0").alias("day")).join(flags.select("entry", "cooling", "waiting"), "entry").join(before, "day", "left").join(picks.select("day", "pick", F.lit(True).alias("_picked")), "day", "left")
    short = F.col("side") == "short"
    tests = [F.col("cooling"), F.col("waiting"), short & (F.col("_ratio") >= gate), F.weekday("day").isin(off), short & F.col("_picked") & F.col("pick").isNull()]
    why = F.coalesce(*[F.when(t, n) for t, n in zip(tests, BLOCKS)])
    return rows.select("entry", "side", "day", why.alias("why"))


def allotted(rows: DataFrame, book: list[str]) -> DataFrame:
    """rows (entry, target, held) with part, their share of the book's order: each takes its gap, the largest (then the first entry) also what rounding leaves; and split, orphan shares by weight of the targets."""
    w = Window.partitionBy(*book)
    gap = F.col("target") - F.col("held")
    rows = rows.withColumn("_gap", gap).withColumns({"_order": F.bround(F.sum("_gap").over(w)), "_sum": F.sum("_gap").over(w), "_n": F.count(F.lit(1)).over(w), "_w": F.sum(F.abs("target")).over(w)})
    first = F.row_number().over(w.orderBy(F.abs(F.col("_gap")).desc(), "entry")) == 1
    part = F.when(F.col("_n") == 1, F.col("_order")).otherwise(F.col("_gap") + F.when(first, F.col("_order") - F.col("_sum")).otherwise(0.0))
    split = F.when(F.col("_w") > 0, F.col("orphans") * F.abs("target") / F.col("_w")).otherwise(F.col("orphans") / F.col("_n"))
    return rows.withColumns({"part": part, "split": split}).drop("_gap", "_order", "_sum", "_n", "_w")


def equity(trades: DataFrame, rows: DataFrame, ends: DataFrame, spots: DataFrame, rules: Rules) -> DataFrame:
    """side, day, cash, option, shares, fees, equity of the books of the two sides: running sums of option and share payments and fees, the open options at their marks and the shares at the spot."""
    fee = signals.fee(F.lit(1.0), rules.fee, rules.least_fee)
    start = -F.col("sign") * 100 * F.col("delta0")
    none = F.lit(0.0)
    flow = lambda df, day, cash, shares, cost: df.select("side", F.col(day).alias("day"), cash.alias("cash"), shares.alias("shares"), cost.alias("fees"))
    live = rows.where("open").withColumn("_before", F.coalesce(F.lag("shares").over(Window.partitionBy("entry").orderBy("day")), start))
    kept = live.withColumn("_now", F.when(F.col("_closes"), none).otherwise(F.col("shares")))  # a close sells the hedge
    done = ends.join(trades.select("entry", "sign"), "entry")
    flows = flow(trades, "day0", -F.col("sign") * F.col("mid0") * 100 - fee - start * F.col("fwd0"), start, fee)
    flows = flows.union(flow(kept, "day", -(F.col("_now") - F.col("_before")) * F.col("fwd"), F.col("_now") - F.col("_before"), none))
    flows = flows.union(flow(done, "exit_day", F.col("sign") * F.col("price") * 100 - F.col("commission") + F.col("shares_left") * F.col("spot"), -F.col("shares_left"), F.col("commission")))
    daily = flows.groupBy("side", "day").agg(*[F.sum(c).alias(c) for c in ("cash", "shares", "fees")])
    held = live.where("not _closes").groupBy("side", "day").agg(F.sum(F.col("sign") * F.col("value") * 100).alias("option"))
    w = Window.partitionBy("side").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    out = daily.join(held, ["side", "day"], "left").select("side", "day", *[F.sum(c).over(w).alias(c) for c in ("cash", "shares", "fees")], F.coalesce("option", none).alias("option")).join(spots, "day")
    return out.withColumn("equity", F.col("cash") + F.col("option") + F.col("shares") * F.col("spot"))


def bridge(trips: DataFrame, book: str, reference: str) -> DataFrame:
    """total, fees, same, rest: net profit of a book less the reference's, split into fees saved, the difference over trips that both have (same side, entry, exit and reason), and the rest. One row."""
    from .matching import compare_books

    two = trips.where(F.col("book").isin(book, reference))
    sign = F.when(F.col("book") == book, 1.0).otherwise(-1.0)
    whole = two.agg(F.sum(sign * (F.col("pnl") - F.col("commission"))).alias("total"), F.sum(-sign * F.col("commission")).alias("fees"))
    same = compare_books(trips, book, reference).where("status = 'same'").agg(F.coalesce(F.sum(F.col("pnl_a") - F.col("pnl_b")), F.lit(0.0)).alias("same"))
    out = whole.join(F.broadcast(same)).withColumn("rest", F.col("total") - F.col("fees") - F.col("same"))  # one row each
    return out.select(*[F.round(c, 2).alias(c) for c in ("total", "fees", "same", "rest")])
