"""Queries over the life of trades and what desks report of it; and the same rows in SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import books, chains, features, life
from ..operators.quantiles import quantiles
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived
from . import market, options

#: Term ratio that gates shorts, and weekdays without entries.
GATE, OFF = 1.008, [3]
RULES = life.Rules()


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of which some are unknown, some have no delta, and some no fill."""
    n = F.col("event_id")
    rows = derived(spark, sf_dir, a.MARKS).where("day <= expiry")
    return rows.withColumns({"mark": F.when(n % 13 > 0, F.col("mid")), "delta": F.when(n % 19 > 0, F.col("delta")), "fillable": n % 11 > 0})


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life.signal_days(derived(spark, sf_dir, a.SIGNALS), RULES.flat_days)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first full mark of each contract and day before noon."""
    rows = derived(spark, sf_dir, a.MARKS).where((F.col("day") <= F.col("expiry")) & (F.hour("ts") < 12))
    first = rows.groupBy("day", *life.CONTRACT).agg(F.min_by(F.struct("event_id", "mid", "delta", "fwd", "ts"), F.struct("ts", "event_id")).alias("_m"))
    first = first.select(F.col("day").alias("day0"), *life.CONTRACT, F.col("_m.event_id").alias("entry"), F.col("_m.mid").alias("mid0"), F.col("_m.delta").alias("delta0"), F.col("_m.fwd").alias("fwd0"), F.col("_m.ts").alias("ts0"))
    return life.opened(first, _days(spark, sf_dir), RULES)


def _judged(spark: SparkSession, sf_dir: str, trades: DataFrame) -> DataFrame:
    return store.settle(life.judged(life.paths(trades, life.day_marks(_marks(spark, sf_dir))), _days(spark, sf_dir), RULES))


def _closed(spark: SparkSession, sf_dir: str, trades: DataFrame, rows: DataFrame) -> DataFrame:
    return life.closed(trades, rows, life.expiry_spots(_marks(spark, sf_dir)), RULES)


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    trades = store.settle(_trades(spark, sf_dir))
    rows = _judged(spark, sf_dir, trades)
    return trades, rows, _closed(spark, sf_dir, trades, rows)


def closed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _all(spark, sf_dir)[2]
    return ends.select("entry", "side", "reason", "exit_day", "src", *[F.round(c, 3).alias(c) for c in ("price", "option_pnl", "hedge_pnl", "pnl", "commission", "pnl_net")])


def gap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life.gap_events(_all(spark, sf_dir)[1]).groupBy("day", "event").agg(F.count(F.lit(1)).alias("n"))


def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of gap events and their shares of the scheduled marks, in one row."""
    rows = _all(spark, sf_dir)[1].where("open")
    count = lambda c: F.count(F.when(c, 1))
    kinds = {"no_fill": F.col("reason").isNotNull() & ~F.col("fillable"), "no_mark": F.col("mark").isNull(), "no_delta": F.col("delta").isNull()}
    out = rows.agg(F.count(F.lit(1)).alias("scheduled"), *[count(c).alias(k) for k, c in kinds.items()])
    return out.select("*", *[F.round(F.col(k) / F.col("scheduled"), 6).alias(f"{k}_share") for k in kinds])


def structure_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = life.structures(store.settle(_trades(spark, sf_dir)))
    rows = life.paths(trades, life.day_marks(_marks(spark, sf_dir)))
    return life.structure_exits(rows, _days(spark, sf_dir), RULES).withColumn("pnl", F.round("pnl", 3))


def stop_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, _, ends = _all(spark, sf_dir)
    return life.stop_flags(trades, ends, _days(spark, sf_dir), RULES)


def entry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate entry with the reason that blocks it."""
    trades, _, ends = _all(spark, sf_dir)
    days = _days(spark, sf_dir)
    ratios = derived(spark, sf_dir, a.DAY_RANGE).select("day", (F.col("high") / F.col("low")).alias("ratio"))
    flags = life.stop_flags(trades, ends, days, RULES)
    return life.entry_decisions(trades, flags, ratios, derived(spark, sf_dir, a.PICKS), GATE, OFF)


def premium_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of closed trades' net profit over the premium at entry, by side and year of exit."""
    trades, _, ends = _all(spark, sf_dir)
    rows = ends.join(trades.select("entry", "mid0"), "entry").select("side", F.year("exit_day").alias("year"), (F.col("pnl_net") / (F.col("mid0") * 100)).alias("ratio"))
    found = quantiles(rows, ["side", "year"], "ratio", [0.05, 0.25, 0.5, 0.75, 0.95])
    return found.select("side", "year", *[F.round(f"q{i}", 4).alias(n) for i, n in enumerate(("q5", "q25", "q50", "q75", "q95"))])


def hedge_allotment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's hedge order of a side's book over its open trades; 7 orphan shares a book are split as well."""
    rows = _all(spark, sf_dir)[1].where("open and delta is not null").withColumns({"target": -F.col("sign") * 100 * F.col("delta"), "held": F.floor(F.col("mid0")).cast("double"), "orphans": F.lit(7.0)})
    out = life.allotted(rows.select("side", "day", "entry", "target", "held", "orphans"), ["side", "day"])
    return out.select("side", "day", "entry", F.round("part", 4).alias("part"), F.round("split", 4).alias("split"))


def book_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = life.equity(*_all(spark, sf_dir), life.expiry_spots(_marks(spark, sf_dir)), RULES)
    return out.select("side", "day", *[F.round(c, 2).alias(c) for c in ("cash", "option", "shares", "fees", "equity")])


def side_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option and hedge profit by side."""
    return _all(spark, sf_dir)[2].groupBy("side").agg(F.count(F.lit(1)).alias("trips"), *[F.round(F.sum(c), 2).alias(c) for c in ("option_pnl", "hedge_pnl", "pnl_net")])


def shares_per_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute hedge shares of an open contract by year and side."""
    rows = _all(spark, sf_dir)[1].where("open")
    return rows.groupBy(F.year("day").alias("year"), "side").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs("shares")), 4).alias("shares"))


def open_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades still open at their last mark: value, spot, premium, levels of stop and take, shares and profits."""
    trades, rows, ends = _all(spark, sf_dir)
    last = rows.join(ends.select("entry"), "entry", "left_anti").groupBy("entry").agg(F.max_by(F.struct("side", "day", "expiry", "mid0", "value", "fwd", "shares", "option_pnl", "hedge_pnl", "pnl"), "day").alias("_l")).select("entry", "_l.*")
    premium, short = F.col("mid0") * 100, F.col("side") == "short"
    return last.select("entry", "side", "day", F.datediff("expiry", "day").alias("dte"), F.round("value", 3).alias("mark"), F.round("fwd", 3).alias("spot"), F.round(premium, 2).alias("premium"), F.round(-premium * F.when(short, RULES.short_stop).otherwise(RULES.long_stop), 2).alias("stop"),
                       F.round(F.when(short, premium * RULES.short_take), 2).alias("take"), *[F.round(c, 2).alias(c) for c in ("shares", "option_pnl", "hedge_pnl", "pnl")])


def shadow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual book metrics of the two sides' closed trades."""
    ends = _all(spark, sf_dir)[2].join(_trades(spark, sf_dir).select("entry", "day0"), "entry")
    trips = ends.select(F.col("side").alias("book"), F.col("day0").alias("entry"), F.col("exit_day").alias("exit"), "pnl", (F.col("pnl") - F.col("pnl_net")).alias("commission"), F.col("entry").alias("trade"), "reason", "side")
    return books.book_metrics(trips)


def times_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, and exits at the time of their mark, by half hour."""
    trades, rows, _ = _all(spark, sf_dir)
    half = lambda c: F.hour(c) * 100 + F.floor(F.minute(c) / 30).cast("int") * 30
    each = trades.select(half("ts0").alias("hhmm"), F.lit("entries").alias("action")).union(rows.where("open and _closes").select(half("ts"), F.lit("exits")))
    return each.groupBy("hhmm").pivot("action", ["entries", "exits"]).count().na.fill(0)


def put_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day the ranked delta (0 skips shorts), else the fallback; shorts that it skips."""
    rows = _trades(spark, sf_dir).withColumn("day", F.col("day0")).join(derived(spark, sf_dir, a.PICKS), "day", "left")
    out = rows.groupBy("day", "pick").agg(F.count(F.when((F.col("side") == "short") & (F.col("pick") == 0), 1)).alias("skipped"), F.count(F.lit(1)).alias("n"))
    return out.select("day", F.when(F.col("pick") == 0, "skip").when(F.col("pick").isNotNull(), "pick").otherwise("fallback").alias("kind"), F.round(F.coalesce("pick", F.lit(0.25)), 4).alias("delta"), "skipped", "n")


def vega_hedge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that a trade's vega adds to its hedge, by the spot-vol beta of a year (of the index days 28 years before)."""
    daily = features.daily_features(derived(spark, sf_dir, a.BARS).where("symbol = '1-URGENT'"), derived(spark, sf_dir, a.INDICES))
    beta = features.trend_measures(daily).select(F.date_add("date", 10227).alias("day0"), "beta")
    vega = F.col("fwd0") * 0.01 * F.exp(-8 * F.pow(F.log(F.col("strike") / F.col("fwd0")), 2)) * F.sqrt(F.datediff("expiry", "day0") / 365)
    shares = -0.5 * vega * F.col("beta") / F.col("fwd0") * 100 * F.col("sign")
    return _trades(spark, sf_dir).join(beta, "day0").select("entry", "beta", F.round(shares, 5).alias("shares"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net profit of a book over a reference book: fees saved, trips that both have, the rest."""
    return life.bridge(derived(spark, sf_dir, a.TRIPS), "1-URGENT", "2-HIGH")


def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts by delta target with size by the crash budget, volatility, premium, spread and greeks for the budget, and a skip row, of each snapshot."""
    chain = market._stressed(spark, sf_dir, two_sided=True)
    out = chains.candidate_features(chain, ["day", "hour"], [0.1, 0.25, 0.4], market.BUDGET, market.LEAST, market.WIDTH)
    return out.select("day", "hour", "target", "skip", "strike", "size", *[F.round(c, 5).alias(c) for c in out.columns[6:]])


def interpolated_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of puts at a delta of 0.45 between its neighbours (the test chain reaches little further), and the skew over 0.5, by snapshot and expiry."""
    out = chains.iv_at_delta(chains.clean_quotes(derived(spark, sf_dir, a.CHAIN)), ["day", "hour", "dte"], [0.45, 0.5])
    return out.select("day", "hour", "dte", F.round("iv_45", 6).alias("iv45"), F.round("iv_50", 6).alias("iv50"), F.round(F.col("iv_45") - F.col("iv_50"), 6).alias("skew"))


QUERIES = {f.__name__: f for f in (closed_trades, gap_days, event_shares, structure_exits, stop_flags, entry_log, premium_ratios, hedge_allotment, book_equity, side_legs, shares_per_contract, open_snapshot, shadow_summary, times_of_day, put_picks, vega_hedge, bridge, candidate_features, interpolated_iv)}


@lru_cache
def _ctes(multiple: float = 1.0) -> str:
    r = RULES
    reason = f"""coalesce(case when crash then case when len(list_filter(range(day0::timestamp, day::timestamp, interval 1 day), lambda z: isodow(z) < 6)) >= {r.crash_days} then 'crash_time' end
 when expiry - day <= {r.exit_dte} then 'time' when pnl <= -(case when side = 'short' then {r.short_stop} else {r.long_stop} end) * mid0 * 100 then 'stop' when side = 'short' and pnl >= {r.short_take} * mid0 * 100 then 'profit'
 when signal = case when side = 'short' then 'long' else 'short' end then 'flip' when flat_run then 'flat' end, case when day = date '{r.last_day}' then 'embargo' end)"""
    path = """{0}0 as (select e.*, d.day, d.ts, d.fwd, d.mark, d.delta, d.fillable, d.mid, greatest(case when e.call then d.fwd - e.strike else e.strike - d.fwd end, 0) as worth, -e.sign * 100 * e.delta0 as shares0,
  coalesce(last_value(d.mark ignore nulls) over w, e.mid0) as lastmark, coalesce(last_value(d.delta ignore nulls) over w, e.delta0) * -e.sign * 100 as shares
  from {1} e join dm d on e.expiry = d.expiry and e.strike = d.strike and e.call = d.call and d.day > e.day0 window w as (partition by e.entry order by d.day rows unbounded preceding)),
{0}1 as (select *, coalesce(mark, case when sign < 0 then greatest(lastmark, worth) else least(lastmark, worth) end) as value, coalesce(lag(shares) over w, shares0) * (fwd - coalesce(lag(fwd) over w, fwd0)) as g from {0}0 window w as (partition by entry order by day)),
{0} as (select *, sign * (value - mid0) * 100 as option_pnl, sum(g) over (partition by entry order by day rows unbounded preceding) as hedge_pnl, sign * (value - mid0) * 100 + sum(g) over (partition by entry order by day rows unbounded preceding) as pnl from {1}x)"""
    judge = "{0}r as (select {1}.*, signal, flat_run, " + reason + " as reason from {1} left join sg using (day)), {0} as (select *, reason is not null and fillable as closes, count(*) filter (where reason is not null and fillable) over (partition by entry order by day rows between unbounded preceding and 1 preceding) = 0 as live from {0}r)"
    return f"""mk as (select *, case when event_id % 13 > 0 then mid end as mark, case when event_id % 19 > 0 then delta end as dl, event_id % 11 > 0 as fillable from ({a.MARKS}) m where day <= expiry),
dm as (select day, expiry, strike, call, ts, fwd, mark, dl as delta, fillable, mid from mk qualify row_number() over (partition by day, expiry, strike, call order by ts desc, event_id desc) = 1),
sg as (select *, signal = 'flat' and coalesce(lag(signal) over (order by day) = 'flat', false) as flat_run from ({a.SIGNALS}) s),
en as (select event_id as entry, m.day as day0, expiry, strike, call, mid as mid0, delta as delta0, fwd as fwd0, ts as ts0, signal as side, case when signal = 'long' then 1 else -1 end as sign, signal = 'long' and event_id % 7 = 0 as crash
  from (select * from mk where hour(ts) < 12 qualify row_number() over (partition by day, expiry, strike, call order by ts, event_id) = 1) m join sg on sg.day = m.day where signal <> 'flat' and m.day < date '{r.no_entry}'),
{path.format("pa", "en").replace("from enx)", "from pa1)")}, {judge.format("ju", "pa")},
sp as (select day, coalesce(arg_max(fwd, (ts, event_id)) filter (where fillable), arg_max(fwd, (ts, event_id))) as spot from mk group by 1),
dn as (select entry, side, sign, mid0, reason, day as exit_day, greatest(round_even((mid + case when sign < 0 then 1 else -1 end * {multiple} * greatest(0.02, 0.01 * mid)) / 0.01, 0) * 0.01, 0.01) as price, hedge_pnl, 1.0 as commission, 'fill_smile' as src, 0.0 as shares_left, 0.0 as spot from ju where live and closes),
tl as (select entry, arg_max(shares, day) as shares, arg_max(fwd, day) as fwd, arg_max(hedge_pnl, day) as hedge_pnl from ju group by 1),
gn as (select en.entry, side, sign, mid0, 'expired' as reason, expiry as exit_day, greatest(case when call then spot - strike else strike - spot end, 0) as price, coalesce(tl.hedge_pnl, 0) + coalesce(tl.shares, -sign * 100 * delta0) * (spot - coalesce(tl.fwd, fwd0)) as hedge_pnl, 0.0 as commission, 'expiry' as src, coalesce(tl.shares, -sign * 100 * delta0) as shares_left, spot
  from en join sp on sp.day = en.expiry left join tl using (entry) where en.entry not in (select entry from dn)),
cl as (select *, option_pnl + hedge_pnl as pnl, option_pnl + hedge_pnl - commission - 1 as pnl_net from (select *, sign * (price - mid0) * 100 as option_pnl from (select * from dn union all by name select * from gn) u) v),
st as (select expiry, strike, day0, min(entry) as grp, sum(mid0) as premium from en group by all having count(distinct call) = 2), ens as (select en.*, grp, premium from en join st using (expiry, strike, day0)),
{path.format("ps", "ens").replace("from ensx)", "from ps1)")}, un as (select grp as entry, grp, day, day0, expiry, side, premium as mid0, false as crash, sum(pnl) as pnl, bool_and(fillable) as fillable from ps group by grp, day, day0, expiry, side, premium having count(*) = 2), {judge.format("us", "un")}"""


def oracles(metrics: str, trend: str) -> dict[str, str]:
    c = f"with {_ctes()}"
    return {
        "closed_trades": f"{c} select entry, side, reason, exit_day, src, round(price, 3) as price, round(option_pnl, 3) as option_pnl, round(hedge_pnl, 3) as hedge_pnl, round(pnl, 3) as pnl, round(commission, 3)::double as commission, round(pnl_net, 3) as pnl_net from cl",
        "gap_days": f"{c}, g as (select day, unnest([case when reason is not null and not fillable then 'no_fill' end, case when mark is null then 'no_mark' end, case when delta is null then 'no_delta' end]) as event from ju where live) select day, event, count(*) as n from g where event is not null group by 1, 2",
        "event_shares": f"{c} select *, round(no_fill / scheduled, 6) as no_fill_share, round(no_mark / scheduled, 6) as no_mark_share, round(no_delta / scheduled, 6) as no_delta_share from (select count(*) as scheduled, count(*) filter (where reason is not null and not fillable) as no_fill, count(*) filter (where mark is null) as no_mark, count(*) filter (where delta is null) as no_delta from ju where live) z",
        "structure_exits": f"{c} select grp, reason, day as exit_day, round(pnl, 3) as pnl from us where live and closes",
        "stop_flags": f"""{c}, z as (select en.entry, side, day0, exit_day as stop, ls from en left join (select side as ls, exit_day, entry as le from cl where reason = 'stop') x on exit_day < day0 qualify row_number() over (partition by en.entry order by exit_day desc nulls last, le desc) = 1)
select entry, stop, coalesce(ls = side and len(list_filter(range(stop::timestamp, day0::timestamp, interval 1 day), lambda q: isodow(q) < 6)) < {RULES.cool_days}, false) as cooling,
  coalesce(ls = side and not exists (select 1 from sg where sg.day >= stop and sg.day <= day0 and sg.signal <> side), false) as waiting from z""",
        "entry_log": f"""{c}, z as (select en.entry, side, day0, exit_day as stop, ls from en left join (select side as ls, exit_day, entry as le from cl where reason = 'stop') x on exit_day < day0 qualify row_number() over (partition by en.entry order by exit_day desc nulls last, le desc) = 1), sf as (select entry, side, day0, stop, coalesce(ls = side and len(list_filter(range(stop::timestamp, day0::timestamp, interval 1 day), lambda q: isodow(q) < 6)) < {RULES.cool_days}, false) as cooling,
  coalesce(ls = side and not exists (select 1 from sg where sg.day >= stop and sg.day <= day0 and sg.signal <> side), false) as waiting from z), dr as (select day, lag(high / low) over (order by day) as ratio from ({a.DAY_RANGE}) q), pk as ({a.PICKS})
select entry, side, day0 as day, case when cooling then 'cooloff' when waiting then 'reset_wait' when side = 'short' and ratio >= {GATE} then 'gate' when isodow(day0) - 1 in ({', '.join(map(str, OFF))}) then 'weekday' when side = 'short' and pk.day is not null and pick is null then 'pick_skip' end as why
from sf left join dr on dr.day = day0 left join pk on pk.day = day0""",
        "premium_ratios": f"{c}, q as (select cl.side, year(exit_day)::int as year, pnl_net / (en.mid0 * 100) as ratio from cl join en using (entry)) select side, year, " + ", ".join(f"round(quantile_cont(ratio, {int(n[1:]) / 100}), 4) as {n}" for n in ("q5", "q25", "q50", "q75", "q95")) + " from q group by 1, 2",
        "hedge_allotment": f"""{c}, g as (select side, day, entry, -sign * 100 * delta as target, -sign * 100 * delta - floor(mid0) as gap from ju where live and delta is not null),
h as (select *, count(*) over b as n, sum(gap) over b as total, sum(abs(target)) over b as weight, row_number() over (partition by side, day order by abs(gap) desc, entry) as k from g window b as (partition by side, day))
select side, day, entry, round(case when n = 1 then round_even(total, 0) when k = 1 then gap + round_even(total, 0) - total else gap end, 4) as part, round(case when weight > 0 then 7 * abs(target) / weight else 7.0 / n end, 4) as split from h""",
        "book_equity": f"""{c}, b as (select *, coalesce(lag(shares) over (partition by entry order by day), shares0) as before, case when closes then 0 else shares end as now from ju where live),
f as (select side, day0 as day, -sign * mid0 * 100 - 1 + sign * 100 * delta0 * fwd0 as cash, -sign * 100 * delta0 as shares, 1.0 as fees from en union all select side, day, -(now - before) * fwd, now - before, 0 from b
  union all select side, exit_day, sign * price * 100 - commission + shares_left * spot, -shares_left, commission from cl),
d as (select side, day, sum(cash) as cash, sum(shares) as shares, sum(fees) as fees from f group by 1, 2), o as (select side, day, sum(sign * value * 100) as option from b where not closes group by 1, 2),
r as (select d.side, d.day, sum(cash) over w as cash, sum(shares) over w as shares, sum(fees) over w as fees, coalesce(option, 0) as option from d left join o using (side, day) window w as (partition by d.side order by d.day rows unbounded preceding))
select side, day, round(cash, 2) as cash, round(option, 2) as option, round(shares, 2) as shares, round(fees, 2)::double as fees, round(cash + option + shares * spot, 2) as equity from r join sp using (day)""",
        "side_legs": f"{c} select side, count(*) as trips, round(sum(option_pnl), 2) as option_pnl, round(sum(hedge_pnl), 2) as hedge_pnl, round(sum(pnl_net), 2) as pnl_net from cl group by 1",
        "shares_per_contract": f"{c} select year(day)::int as year, side, count(*) as n, round(avg(abs(shares)), 4) as shares from ju where live group by 1, 2",
        "open_snapshot": f"""{c} select entry, side, day, (expiry - day)::int as dte, round(value, 3) as mark, round(fwd, 3) as spot, round(mid0 * 100, 2) as premium, round(-mid0 * 100 * case when side = 'short' then {RULES.short_stop} else {RULES.long_stop} end, 2) as stop, round(case when side = 'short' then mid0 * 100 * {RULES.short_take} end, 2) as take,
  round(shares, 2) as shares, round(option_pnl, 2) as option_pnl, round(hedge_pnl, 2) as hedge_pnl, round(pnl, 2) as pnl from ju where entry not in (select entry from cl) qualify row_number() over (partition by entry order by day desc) = 1""",
        "shadow_summary": f"with {_ctes()}, tr as (select cl.side as book, en.day0 as entry, exit_day as exit, pnl, pnl - pnl_net as commission, entry as trade from cl join en using (entry)), " + metrics.split("with ", 1)[1].replace(f"({a.TRIPS})", "(select * from tr)"),
        "times_of_day": f"{c}, z as (select hour(ts0) * 100 + minute(ts0) // 30 * 30 as hhmm, 1 as e, 0 as x from en union all select hour(ts) * 100 + minute(ts) // 30 * 30, 0, 1 from ju where live and closes) select hhmm::int as hhmm, sum(e)::bigint as entries, sum(x)::bigint as exits from z group by 1",
        "put_picks": f"""{c} select day0 as day, case when day(day0) % 3 = 0 then 'fallback' when day(day0) % 4 = 0 then 'skip' else 'pick' end as kind, round(case when day(day0) % 3 = 0 then 0.25 else day(day0) % 4 * 0.1 end, 4)::double as delta,
  count(*) filter (where side = 'short' and day(day0) % 3 > 0 and day(day0) % 4 = 0) as skipped, count(*) as n from en group by day0""",
        "vega_hedge": f"""{c}, tm as ({trend}), bt as (select date + 10227 as day0, beta from tm where symbol = '1-URGENT')
select entry, beta, round(-0.5 * fwd0 * 0.01 * exp(-8 * pow(ln(strike / fwd0), 2)) * sqrt((expiry - day0) / 365) * beta / fwd0 * 100 * sign, 5) as shares from en join bt using (day0)""",
        "bridge": f"""with t as (select *, row_number() over (partition by book, side, entry order by trade) as n from ({a.TRIPS}) q where book in ('1-URGENT', '2-HIGH')),
s as (select a.pnl - b.pnl as same from (select * from t where book = '1-URGENT') a join (select * from t where book = '2-HIGH') b using (side, entry, n) where a.exit = b.exit and a.reason = b.reason),
g as (select sum(case when book = '1-URGENT' then pnl - commission else commission - pnl end) as total, sum(case when book = '1-URGENT' then -commission else commission end) as fees from t)
select round(total, 2) as total, round(fees, 2)::double as fees, round(coalesce((select sum(same) from s), 0), 2)::double as same, round(total - fees - coalesce((select sum(same) from s), 0), 2) as rest from g""",
        "candidate_features": f"""with {market._CLEAN.replace("c as (select", "cc as (select")}, c as (select * from cc where bid > 0 and ask > bid and delta is not null), {market._STRESS}, p as (select * from cs where not call),
x as (select p.*, w.target from p, unnest([0.1, 0.25, 0.4]) w(target)), am as (select day, hour, iv as atm from p qualify row_number() over (partition by day, hour order by abs(ln(strike / fwd)), strike, event_id) = 1),
y as (select * from x qualify row_number() over (partition by day, hour, target order by abs(abs(delta) - target), strike, event_id desc) = 1),
z as (select y.* exclude (size), atm, case when net > 0 then coalesce(list_max(list_filter(range(1, greatest(floor({market.BUDGET} / nullif(net, 0)), 0)::bigint + 1), lambda n: n * net + least(greatest({market.LEAST}, {market.WIDTH} * sqrt(n * gamma * 100)), n * abs(delta) * 100) * move <= {market.BUDGET})), 0) else 0 end as size from y join am using (day, hour))
select day, hour::int as hour, target::double as target, false as skip, strike, size::int as size, round(iv, 5) as iv, round(iv - atm, 5) as iv_rel, round(ln(strike / spot), 5) as moneyness, round(mid / spot, 5) as premium, round((ask - bid) / mid, 5) as spread, round(size * mid * 100 / {market.BUDGET}, 5) as credit_budget,
  round(size * vega * 100 / {market.BUDGET}, 5) as vega_budget, round(size * theta * 100 / {market.BUDGET}, 5) as theta_budget, round(size * gamma * spot * spot / {market.BUDGET}, 5) as gamma_budget from z
union all select distinct day, hour::int, null, true, null, null, null, null, null, null, null, null, null, null, null from p""",
        "interpolated_iv": f"""{_CHAIN}, p as (select day, hour, dte, abs(delta) as ad, avg(iv) as iv from c where not call and delta is not null and iv is not null group by all), x as (select p.*, w.t from p, unnest([0.45, 0.5]) w(t)),
y as (select day, hour, dte, t, max(ad) filter (where ad <= t) as lo, min(ad) filter (where ad >= t) as hi, arg_max(iv, ad) filter (where ad <= t) as vlo, arg_min(iv, ad) filter (where ad >= t) as vhi from x group by all),
z as (select *, case when hi = lo then vlo else vlo + (vhi - vlo) * (t - lo) / (hi - lo) end as iv from y)
select day, hour::int as hour, dte, round(max(iv) filter (where t = 0.45), 6) as iv45, round(max(iv) filter (where t = 0.5), 6) as iv50, round(max(iv) filter (where t = 0.45) - max(iv) filter (where t = 0.5), 6) as skew from z group by 1, 2, 3""",
    }


def _clean() -> str:
    from . import market

    return f"with {market._CLEAN}"


_CHAIN = _clean()
