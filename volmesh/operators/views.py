"""Day-grid views of a tape: chains at slots as a desk would decide on them, and as it would fill right after, with a log of the slots that were skipped.

A decision sees a day's prints from the open to its cutoff, so all decisions of a day (and the long fill views) see beginnings of one series. Pairs, running
medians and ratios are therefore computed once for a day and near expiry, and a slot takes their last values by its cutoff. Only the short fill windows
have series of their own; a print lies in as many of them as overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, pricing
from ..sources import store
from . import forwards, surface
from .chains import recent_universe

KEYS = ["day", "slot"]
VIEW = [*KEYS, "view"]
#: A series of pairs: a day's (span 0) or a short window's (span is its slot), with the near expiry that it was made for.
SPAN, SERIES = ["day", "span"], ["day", "span", "base"]


def minutes(tape: DataFrame) -> DataFrame:
    """tape with _m, the minutes after midnight."""
    return tape.withColumn("_m", clock.seconds(F.col("ts"), clock.at(F.col("day"), 0)) / 60)


def spans(tape: DataFrame, grid: list[int], window: int) -> DataFrame:
    """Prints of the day's series and of the short windows (slot, slot + window] that hold them."""
    inside = F.filter(F.array(*[F.lit(g) for g in grid]).cast("array<int>"), lambda g: (F.col("_m") > g) & (F.col("_m") <= g + window))
    return tape.select("*", F.explode(F.concat(F.array(F.lit(0)), inside)).alias("span"))


def cutoff(day: Column, slot: Column, view: Column, lag: int, window: int) -> Column:
    return clock.at(day, F.when(view == "decide", slot - lag).otherwise(slot + window))


def near_expiries(prs: DataFrame, grid: list[int], lag: int, window: int, need: int, few: int, fills: bool = True) -> DataFrame:
    """VIEW, _end, base, span: the near expiry of each slot's decide and long view, the first with `need` pairs by the cutoff, and of its short window, the first with `few`."""
    ends = {("decide", g): g - lag for g in grid} | {("long", g): g + window for g in grid if fills}
    by = prs.where("expiry >= day")
    counts = by.where("span = 0").groupBy("day", "expiry").agg(*[F.count(F.when(F.col("_m") <= m, 1)).alias(f"{v}_{g}") for (v, g), m in ends.items()])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("slot"), F.lit(v).alias("view"), F.lit(m).alias("_end"), F.col(f"{v}_{g}").alias("_n")) for (v, g), m in ends.items()])).alias("_e")
    whole = counts.select("day", "expiry", each).select("day", "expiry", "_e.*").where(F.col("_n") >= need).groupBy(*VIEW, "_end").agg(F.min("expiry").alias("base")).withColumn("span", F.lit(0))
    short = by.where("span > 0").groupBy("day", "span", "expiry").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= few).groupBy("day", "span").agg(F.min("expiry").alias("base"))
    short = short.select("day", F.col("span").alias("slot"), F.lit("short").alias("view"), (F.col("span") + window).alias("_end"), "base", "span")
    return whole.select(*short.columns).unionByName(short)


def near_views(expiries: DataFrame, medians: DataFrame) -> DataFrame:
    """VIEW, span, base: the series and near expiry of each slot's decide and fill view that has a forward. A fill takes the short window's series where that gives it a forward, else the day's by the window's end."""
    begun = minutes(medians).groupBy(*SERIES).agg(F.min("_m").alias("_from"))
    found = expiries.join(begun, SERIES).where("_from <= _end").select(*VIEW, "span", "base")
    best = F.max_by(F.struct("span", "base"), F.when(F.col("view") == "short", 1).otherwise(0))
    return found.withColumn("_v", F.when(F.col("view") == "decide", "decide").otherwise("fill")).groupBy(*KEYS, "_v").agg(best.alias("_b")).select(*KEYS, F.col("_v").alias("view"), "_b.*")


def series(prs: DataFrame, expiries: DataFrame, need: int, few: int) -> DataFrame:
    """SERIES, near, ts, call, event_id, fnear: running medians of the pairs of each span's near expiries (expiries: a row a view)."""
    least = F.when(F.col("span") > 0, min(few, forwards.LEAST)).otherwise(min(need, forwards.LEAST))
    rows = prs.withColumn("base", F.col("expiry")).join(F.broadcast(expiries.select(*SERIES).distinct()), SERIES, "left_semi")
    return forwards.medians(rows, SERIES, least).withColumn("near", F.col("base"))


def candidates(tape: DataFrame, contract: list[str], grid: list[int], lag: int, days: int = 5) -> DataFrame:
    """KEYS and contract: those printed today before the decide cutoff, and those printed on any of the `days` days with prints before."""
    past = recent_universe(tape.select("day", *contract), contract, days).where("recent").select("day", *contract, F.lit(0.0).alias("_m"))
    first = tape.select("day", *contract, "_m").unionByName(past).groupBy("day", *contract).agg(F.min("_m").alias("_m"))
    return first.select("day", *contract, F.explode(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: F.col("_m") <= g - lag)).alias("slot"))


def listed(cand: DataFrame, chosen: DataFrame, near: DataFrame, ratio: DataFrame, rate: float, dividends: DataFrame, lag: int, window: int, low: int, high: int, reach: float) -> DataFrame:
    """VIEW, contract, dte, forward, spot, k: candidates within days to expiry and distance from the forward at the view's cutoff."""
    rows = cand.withColumn("dte", F.datediff("expiry", "day")).where(F.col("dte").between(low, high)).join(chosen, KEYS)
    rows = rows.withColumn("ts", cutoff(F.col("day"), F.col("slot"), F.col("view"), lag, window))
    # a forward for each view and expiry, then back to its contracts
    at = forwards.forward_at(rows.select(*VIEW, *SERIES[1:], "ts", "expiry").distinct(), near, ratio, SERIES, rate, dividends)
    at = forwards.with_spot(at, rate, dividends).select(*VIEW, "expiry", "forward", "spot")
    out = rows.select(*VIEW, "dte", *[c for c in cand.columns if c not in KEYS]).join(at, [*VIEW, "expiry"]).withColumn("k", F.log(F.col("strike") / F.col("forward")))
    return out.where(F.abs("k") <= reach)


def view_smiles(prints: DataFrame, chosen: DataFrame, near: DataFrame, ratio: DataFrame, rate: float, dividends: DataFrame, lag: int, window: int, lookback: int, **gates) -> DataFrame:
    """Smiles by view and expiry, of the prints of the lookback before a decide cutoff and of those in a fill window, at the forward of each print's own time. A print's volatility is found once for each series
    that a view takes it from."""
    used = F.broadcast(chosen.select(*SERIES).distinct())
    rows = forwards.forward_at(prints.join(used, SPAN), near, ratio, SERIES, rate, dividends)
    years = clock.years(F.col("ts"), F.col("expiry"))
    rows = store.kept(rows.withColumn("iv", pricing.implied(F.col("price"), F.col("forward"), F.col("strike"), years, F.lit(rate), F.col("call"))).withColumn("k", F.log(F.col("strike") / F.col("forward"))).select("_m", *SERIES, "expiry", "strike", "call", "size", "iv", "k"), "ivs")
    decide = (F.col("view") == "decide") & (F.col("_m") > F.col("slot") - lag - lookback) & (F.col("_m") <= F.col("slot") - lag)
    fill = (F.col("view") == "fill") & (F.col("_m") > F.col("slot")) & (F.col("_m") <= F.col("slot") + window)
    views = chosen.groupBy(*SERIES).agg(F.collect_list(F.struct("slot", "view")).alias("_views"))  # two a slot at most
    seen = rows.join(F.broadcast(views), SERIES).select(*rows.columns, F.explode("_views").alias("_w")).select(*rows.columns, "_w.*").where(decide | fill)
    return surface.smiles(seen, [*VIEW, "expiry"], **gates)


def with_source(fits: DataFrame) -> DataFrame:
    """Smiles by view with src: a fill view takes the decide smile of an expiry that it has none of its own for."""
    decide = fits.where("view = 'decide'")
    borrowed = decide.withColumn("view", F.lit("fill")).join(fits.where("view = 'fill'"), [*VIEW, "expiry"], "left_anti")
    return fits.withColumn("src", F.concat("view", F.lit("_smile"))).unionByName(borrowed.withColumn("src", F.lit("decide_smile")))


def chain(contracts: DataFrame, fits: DataFrame, rate: float, asof: Column) -> DataFrame:
    """contracts with iv, mid (at least the price floor) and greeks of their smile, at the slot's time to expiry. Of slots without a decide smile nothing is left; a fill row without any smile stays, with a null src and no values."""
    rows = contracts.join(fits, [*VIEW, "expiry"], "left").where("view = 'fill' or src is not null")
    open_ = rows.where("view = 'decide'").select(*KEYS).distinct()
    k = F.least(F.greatest(F.col("k"), F.col("kmin")), F.col("kmax"))
    rows = rows.join(open_, KEYS, "left_semi").withColumn("iv", surface.smile_at(k, F.col("a0"), F.col("a1"), F.col("a2"))).withColumn("years", clock.years(asof, F.col("expiry")))
    rows = pricing.valued(rows, F.col("forward"), F.col("strike"), F.col("years"), rate, F.col("iv"), F.col("call"))
    floor = pricing.price_floor(F.col("forward"), F.col("strike"), F.col("years"), F.lit(rate), F.col("spot"), F.col("call"))
    return rows.withColumn("mid", F.when(F.col("src").isNotNull(), F.greatest("price", floor))).drop("price", "a0", "a1", "a2", "kmin", "kmax", "n")


def skip_log(tape: DataFrame, built: DataFrame, chosen: DataFrame, grid: list[int], after: int) -> DataFrame:
    """day, slot, why of each slot of each day, from the tape's first to `after` days past its last, that has no decide chain: no_trades (the day has no prints), no parity forward, no smile."""
    days = tape.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence("a", F.date_add("z", after))).alias("day"))
    every = days.select("day", F.explode(F.array(*[F.lit(g) for g in grid])).alias("slot"))
    flags = [tape.select("day").distinct().withColumn("_traded", F.lit(True)), chosen.where("view = 'decide'").select(*KEYS).withColumn("_forward", F.lit(True)), built.where("view = 'decide'").select(*KEYS).distinct().withColumn("_built", F.lit(True))]
    rows = reduce(lambda d, f: d.join(f, [c for c in f.columns if c in KEYS], "left"), flags, every).where("_built is null")
    return rows.select(*KEYS, F.when(F.col("_traded").isNull(), "no_trades").when(F.col("_forward").isNull(), "no parity forward").otherwise("no smile").alias("why"))


def build(tape: DataFrame, prints: DataFrame, contract: list[str], grid: list[int], rate: float, within: float, dividends: DataFrame, lag: int, window: int, lookback: int, need: int, few: int, low: int, high: int, reach: float, after: int, fills: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chain, log) of the clean prints of a tape (prints): every slot of every day is in the chain's decide rows or in the log, once. Without fills the chain has its decide rows only; these and the log need no fill window."""
    rows = store.kept(spans(minutes(prints), grid if fills else [], window).select("day", "span", "ts", "_m", "event_id", *contract, "price", "size"), "spans")
    prs = store.kept(minutes(forwards.pairs(rows.drop("_m", "size"), SPAN, rate, within)), "pairs")
    expiries = store.settle(near_expiries(prs, grid, lag, window, need, few, fills))
    near = store.kept(series(prs, expiries, need, few), "near")
    chosen = store.settle(near_views(expiries, near))
    bases = F.broadcast(chosen.select(*SERIES).distinct())
    used = near.join(bases, SERIES, "left_semi")
    least = F.when(F.col("span") > 0, min(few, forwards.LEAST)).otherwise(min(need, forwards.LEAST))
    ratio = store.kept(forwards.ratios(prs.drop("_m").join(bases, SPAN), used, SERIES, rate, dividends, least), "ratios")
    cand = candidates(rows.where("span = 0"), contract, grid, lag)
    contracts = listed(cand, chosen, used, ratio, rate, dividends, lag, window, low, high, reach)
    fits = with_source(store.settle(view_smiles(rows.drop("event_id"), chosen, used, ratio, rate, dividends, lag, window, lookback)))
    built = store.settle(chain(contracts, fits, rate, cutoff(F.col("day"), F.col("slot"), F.lit("decide"), 0, 0)))
    return built, skip_log(tape, built, chosen, grid, after)
