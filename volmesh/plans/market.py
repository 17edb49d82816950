"""Queries over daily series and quote snapshots, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calendar, chains, series
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived
from . import options

CONTRACT = ["dte", "strike", "call"]
SNAP = ["day", "hour"]


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.clean_quotes(derived(spark, sf_dir, a.CHAIN))


def adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    rows = derived(spark, sf_dir, a.BARS).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1 + F.when(F.dayofmonth("date") == 15, 0.004).otherwise(0.0))
    return series.total_return(rows, "ret").select("symbol", "date", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")])


def spliced_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derived(spark, sf_dir, a.BARS)
    rows = series.splice(bars.where("date < date'1997-01-01'"), bars.select("symbol", "date", "close"))
    ret = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("date")))
    return rows.select("symbol", "date", "spliced", F.round("high", 4).alias("high"), F.round(ret, 6).alias("ret"))


def index_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = derived(spark, sf_dir, a.INDEX_GAPS)
    vix, rate = i.where("vix is not null").select("date", "vix"), i.where("irx is not null").select("date", "irx")
    rows = series.align([vix, rate], derived(spark, sf_dir, a.BARS).select("date").distinct(), ["vix", "irx"], ["vix"])
    return rows.select("date", F.round("vix", 6).alias("vix"), F.round((F.pow(1 + F.col("irx") / 100, 252) - 1) * 100, 6).alias("annual"))


def projected_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day: the next four dividends, on third Fridays three months apart, at the last amount paid before."""
    days = derived(spark, sf_dir, a.BARS).select("date").distinct()
    paid = derived(spark, sf_dir, a.DIVIDENDS)
    w = Window.partitionBy(F.lit(1)).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)  # a row a calendar day
    both = days.select("date", F.lit(0).alias("_side"), F.lit(None).cast("struct<ex:date,amount:double>").alias("_d")).union(paid.select("ex_date", F.lit(1), F.struct("ex_date", "amount")))
    last = both.withColumn("_d", F.last("_d", ignorenulls=True).over(w)).where("_side = 0 and _d is not null")
    ahead = last.select("date", F.col("_d.amount").alias("amount"), F.col("_d.ex").alias("ex"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    return ahead.select("date", "i", calendar.third_friday(F.add_months("ex", F.col("i") * 3)).alias("ex_date"), F.round("amount", 4).alias("amount"))


def dividends_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dividends with entry < ex-date <= exit of each trip, as the difference of two running sums by calendar date: equal joins, no range join."""
    trips, paid = derived(spark, sf_dir, a.TRIPS).where("exit >= entry"), derived(spark, sf_dir, a.DIVIDENDS)
    days = trips.select(F.explode(F.array("entry", "exit")).alias("date")).distinct().select("date", F.lit(0.0).alias("amount"))
    w = Window.partitionBy(F.lit(1)).orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    total = days.union(paid.select(F.col("ex_date"), "amount")).select("date", F.sum("amount").over(w).alias("_t")).distinct()
    rows = trips.join(total.select(F.col("date").alias("entry"), F.col("_t").alias("_a")), "entry").join(total.select(F.col("date").alias("exit"), F.col("_t").alias("_b")), "exit")
    return rows.select("trade", F.round(F.col("_b") - F.col("_a"), 4).alias("dividends"))


def days_to_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days to the next third Friday of a quarter's last month, the day itself included; null after the last."""
    days = derived(spark, sf_dir, a.BARS).select("date").distinct()
    events = days.where("month(date) % 3 = 0").select(calendar.third_friday(F.col("date")).alias("date")).distinct().withColumn("_e", F.col("date"))
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(0, Window.unboundedFollowing)  # a row a calendar day
    rows = days.withColumn("_day", F.lit(True)).join(events, "date", "full_outer").withColumn("_next", F.first("_e", ignorenulls=True).over(w))
    return rows.where("_day").select("date", F.datediff("_next", "date").alias("days"))


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = F.col("strike") * 1000 + F.col("dte") * 2 + F.col("call").cast("int")
    return series.missing_days(derived(spark, sf_dir, a.OPTIONS).withColumn("contract", contract), "contract", "day")


def slot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.slot_audit(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts"), 600, 30, 12, 6)


def skipped_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By slot: days, and the shares of empty and thin ones."""
    return slot_audit(spark, sf_dir).groupBy("slot").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(F.when(F.col("why") == "none", 1.0).otherwise(0.0)), 6).alias("none"), F.round(F.avg(F.when(F.col("why") == "few", 1.0).otherwise(0.0)), 6).alias("few"))


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.evenly(derived(spark, sf_dir, a.BARS), "date", 50)


def replaced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = derived(spark, sf_dir, a.INDICES).select("date", "vix")
    return series.publishable(series.replace_by_key(i, i.where("month(date) = 6").withColumn("vix", F.when(F.dayofmonth("date") == 1, F.lit(float("nan"))).otherwise(F.col("vix") + 1)), ["date"]))


def index_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long index levels as a column for each name; days without any leave."""
    i = derived(spark, sf_dir, a.INDICES)
    long = i.select("date", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.col(c) > b, F.col(c)).alias("v")) for c, b in (("vix", 20), ("vix9d", 19), ("vix3m", 19))])).alias("_e")).select("date", "_e.*")
    wide = long.groupBy("date").pivot("name", ["vix", "vix3m", "vix9d"]).agg(F.max("v")).na.drop("all", subset=["vix", "vix3m", "vix9d"])
    return wide.select("date", *[F.round(c, 6).alias(c) for c in ("vix", "vix3m", "vix9d")])


def quote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that pass every filter, of snapshots that enough implied volatilities cover."""
    rows = chains.listed(chains.tradable(chains.covered(_chain(spark, sf_dir), SNAP)), 7, 45, 0.025)
    return rows.select("event_id", F.round("mid", 6).alias("mid"), F.round(F.col("ask") - F.col("bid"), 6).alias("width"))


def recent_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.recent_universe(derived(spark, sf_dir, a.OPTIONS).where("condition > 0"), CONTRACT, 5)


def chosen_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By snapshot: the expiry nearest to 30 days and its strike at the money."""
    chain = _chain(spark, sf_dir)
    expiry = chains.pick_expiry(chain, SNAP, 10, 60, 30)
    return chains.pick_strike(chain.join(expiry, [*SNAP, "dte"], "left_semi"), [*SNAP, "dte"])


def delta_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.by_delta(_chain(spark, sf_dir), ["day", "dte"], [0.25, 0.4], False)
    return rows.select("day", "dte", "target", "strike", F.round("delta", 6).alias("delta"), F.round("mid", 6).alias("mid"))


def structure_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.structures(_chain(spark, sf_dir), SNAP).withColumn("net", F.round("net", 6))


def surface_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.surface_features(_chain(spark, sf_dir), ["day"]).select("day", "dte", *[F.round(c, 6).alias(c) for c in ("iv25", "iv10", "skew", "wing", "slope")])


#: Crash budget, drop of the spot, volatility in a crash at least and as a multiple, hedge band at least and for a root of gamma.
BUDGET, DROP, SHOCK, TIMES, LEAST, WIDTH = 87_500.0, 0.2, 0.6, 1.5, 25.0, 40.0


def _stressed(spark: SparkSession, sf_dir: str, two_sided: bool = False) -> DataFrame:
    """Written before and after, as one plan of all these steps is more code than Java compiles."""
    return store.settle(chains.stressed(store.settle(chains.tradable(_chain(spark, sf_dir)) if two_sided else _chain(spark, sf_dir)).where("mid > 0"), options.RATE, DROP, SHOCK, TIMES))


def stress_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts that a crash budget bears with and without the hedge's band; the band of one contract; conservative mark."""
    rows = _stressed(spark, sf_dir).where("not call and delta is not null")
    inner = F.greatest(F.col("strike") - F.col("fwd"), F.lit(0.0))
    mark = chains.conservative_mark(F.when(F.col("event_id") % 4 > 0, F.col("mid")), F.col("last") * 0.9, inner, F.col("event_id") % 3 == 0)
    rows = chains.stress_quantity(chains.stress_quantity(rows, "fit", BUDGET, LEAST, WIDTH), "unhedged", BUDGET, 1e12, 0.0)
    return rows.select("event_id", "fit", "unhedged", F.round(chains.hedge_band(F.col("gamma") * 100, LEAST, WIDTH), 6).alias("band"), F.round(mark, 6).alias("mark"))


QUERIES = {f.__name__: f for f in (adjusted_bars, spliced_bars, index_frame, projected_dividends, dividends_held, days_to_event, missing_days, slot_audit, skipped_share, even_sample, replaced_log, index_pivot, quote_quality, recent_universe, chosen_contract, delta_strikes, structure_prices, surface_features, stress_sizes)}

_THIRD_FRIDAY = "(date_trunc('month', {0}) + to_days(((12 - dayofweek(date_trunc('month', {0})::date)) % 7 + 14)::int))::date"
_CLEAN = f"""c0 as ({a.CHAIN}), c1 as (select * replace (case when bid > 0 then bid end as bid, case when ask > 0 then ask end as ask, case when last > 0 then last end as last) from c0), c as (select *, coalesce((bid + ask) / 2, last) as mid from c1)"""
_AUDIT = """e as (select ts::date as day, floor((hour(ts) * 60 + minute(ts) - 600) / 30)::int as slot from events), g as (select distinct e.day, r.slot::int as slot from e, range(12) r(slot)),
n as (select g.day, g.slot, count(e.day) as n from g left join e on e.day = g.day and e.slot = g.slot group by all), u as (select *, case when n = 0 then 'none' when n < 6 then 'few' end as why from n)"""


def _nearest(keys: str, targets: list[tuple[str, float]], where: str) -> str:
    """Options nearest to a target delta by a row number, where the operator takes the least of a struct."""
    values = ", ".join(f"({c}, {t}::double)" for c, t in targets)
    return f"""(select * from (select c.*, v.target, row_number() over (partition by {keys}, c.call, v.target order by abs(abs(delta) - v.target), strike, event_id desc) as r
 from c join (values {values}) v(call, target) on c.call = v.call where delta is not null and {where}) z where r = 1)"""


_STRESS = f"""sa as (select *, fwd * exp(-{options.RATE} * years) as spot, iv * sqrt(years) as sd, greatest({SHOCK}, {TIMES} * iv) * sqrt(years) as sc from c where iv is not null and mid > 0),
sb as (select * exclude (delta), ln(fwd / strike) / sd + sd / 2 as d1, spot * (1 - {DROP}) as low, ln(spot * (1 - {DROP}) / strike) / sc + sc / 2 as c1 from sa),
sk as (select *, {options._cdf("d1")} as n1, {options._cdf("d1 - sd")} as n2, {options._density("d1")} as p1, {options._cdf("c1")} as m1, {options._cdf("c1 - sc")} as m2, case when call then 0 else 1 end as put from sb),
cs as (select *, n1 - put as delta, p1 / (spot * sd) as gamma, spot * p1 * sqrt(years) / 100 as vega, (-spot * p1 * iv / (2 * sqrt(years)) - {options.RATE} * strike * exp(-{options.RATE} * years) * (n2 - put)) / 365 as theta, spot - low as move,
  (low * m1 - strike * m2 - put * (low - strike) - mid) * 100 - abs(n1 - put) * 100 * (spot - low) as net from sk)"""
_LEGS = sorted({(str(c).lower(), t) for legs in chains.STRUCTURES.values() for c, t, _ in legs})
_TABLE = ", ".join(f"('{n}', {c}, {t}::double, {r})" for n, legs in chains.STRUCTURES.items() for c, t, r in legs)

ORACLES = {
    "adjusted_bars": f"""with b as (select *, close / lag(close) over w - 1 + case when day(date) = 15 then 0.004 else 0 end as ret from ({a.BARS}) q window w as (partition by symbol order by date)),
p as (select *, product(1 + coalesce(ret, 0)) over (partition by symbol order by date) as g from b), l as (select symbol, arg_max(close, date) / arg_max(g, date) as s from p group by 1)
select symbol, date, round(open * g * s / close, 4) as open, round(high * g * s / close, 4) as high, round(low * g * s / close, 4) as low, round(g * s, 4) as close from p join l using (symbol)""",
    "spliced_bars": f"""select symbol, date, date > (select max(date) from ({a.BARS}) y where date < date '1997-01-01' and y.symbol = b.symbol) as spliced,
  round(case when date < date '1997-01-01' then high else close end, 4) as high, round(ln(close / lag(close) over (partition by symbol order by date)), 6) as ret from ({a.BARS}) b""",
    "index_frame": f"""with i as ({a.INDEX_GAPS}), v as (select date, vix from i where vix is not null), r as (select date, irx from i where irx is not null), d as (select distinct date from ({a.BARS}) b)
select d.date, case when d.date <= (select max(date) from v) then round(v.vix, 6) end as vix, round((pow(1 + r.irx / 100, 252) - 1) * 100, 6) as annual from d asof left join v on d.date >= v.date asof left join r on d.date >= r.date""",
    "projected_dividends": f"""select d.date, i::int as i, {_THIRD_FRIDAY.format("(p.ex_date + to_months((3 * i)::int))")} as ex_date, round(amount, 4) as amount
from (select distinct date from ({a.BARS}) b) d asof join ({a.DIVIDENDS}) p on d.date > p.ex_date, range(1, 5) r(i)""",
    "dividends_held": f"select trade, round(coalesce((select sum(amount) from ({a.DIVIDENDS}) d where d.ex_date > t.entry and d.ex_date <= t.exit), 0), 4)::double as dividends from ({a.TRIPS}) t where exit >= entry",
    "days_to_event": f"""with d as (select distinct date from ({a.BARS}) b), e as (select distinct {_THIRD_FRIDAY.format("date")} as at from d where month(date) % 3 = 0)
select d.date, datediff('day', d.date, e.at)::int as days from d asof left join e on d.date <= e.at""",
    "missing_days": f"""with h as (select distinct strike * 1000 + dte * 2 + call::int as contract, day from ({a.OPTIONS}) o), s as (select contract, unnest(range(min(day)::timestamp, max(day)::timestamp + interval 1 day, interval 1 day))::date as day from h group by 1)
select contract, day from s where isodow(day) < 6 except select contract, day from h""",
    "slot_audit": f"with {_AUDIT} select day, slot, n, why from u",
    "skipped_share": f"with {_AUDIT} select slot, count(*) as days, round(avg((coalesce(why, '') = 'none')::int), 6) as none, round(avg((coalesce(why, '') = 'few')::int), 6) as few from u group by 1",
    "even_sample": f"""with d as (select distinct date from ({a.BARS}) b), l as (select list(date order by date) as x from d)
select distinct x[floor(j * (len(x) - 1) / 49.0)::int + 1] as day from l, range(50) r(j)""",
    "replaced_log": f"select date, round(case when month(date) = 6 then case when day(date) > 1 then vix + 1 end else vix end, 4) as vix from ({a.INDICES}) i",
    "index_pivot": f"select date, round(case when vix > 20 then vix end, 6) as vix, round(case when vix3m > 19 then vix3m end, 6) as vix3m, round(case when vix9d > 19 then vix9d end, 6) as vix9d from ({a.INDICES}) i where vix > 20 or vix3m > 19 or vix9d > 19",
    "quote_quality": f"""with {_CLEAN}, g as (select day, hour from c group by all having avg((iv is not null)::int) >= 0.5)
select event_id, round(mid, 6) as mid, round(ask - bid, 6) as width from c join g using (day, hour) where bid > 0 and ask > bid and delta is not null and dte between 7 and 45 and abs(ln(strike / fwd)) <= 0.025""",
    "recent_universe": f"""with s as (select distinct day, dte, strike, call from ({a.OPTIONS}) o where condition > 0), n as (select day, row_number() over (order by day) as i from (select distinct day from s) q), k as (select * from s join n using (day)),
p as (select n.day, k.dte, k.strike, k.call, n.i - k.i as back from n join k on n.i - k.i between 0 and 5) select day, dte, strike, call, bool_or(back = 0) as today, bool_or(back > 0) as recent from p group by 1, 2, 3, 4""",
    "chosen_contract": f"""with {_CLEAN}, x as (select distinct day, hour, dte from c where dte between 10 and 60), y as (select * from x qualify row_number() over (partition by day, hour order by abs(dte - 30), dte) = 1),
m as (select day, hour, dte, quantile_cont(fwd, 0.5) as spot from c join y using (day, hour, dte) group by all)
select day, hour::int as hour, dte, strike from (select c.day, c.hour, c.dte, strike, row_number() over (partition by c.day, c.hour order by abs(strike - spot), strike) as r from c join m using (day, hour, dte) where mid is not null) z where r = 1""",
    "delta_strikes": f"with {_CLEAN}, n as {_nearest('day, dte', [('false', 0.25), ('false', 0.4)], 'true')} select day, dte, target, strike, round(delta, 6) as delta, round(mid, 6) as mid from n",
    "structure_prices": f"""with {_CLEAN}, n as {_nearest('day, hour', _LEGS, 'true')}, t(structure, call, target, ratio) as (values {_TABLE}), k as (select distinct day, hour from c where delta is not null)
select k.day, k.hour::int as hour, t.structure, count(*)::int as legs, round(case when count(n.mid) = count(*) then sum(t.ratio * n.mid) end, 6) as net from k cross join t left join n on n.day = k.day and n.hour = k.hour and n.call = t.call and n.target = t.target group by 1, 2, 3""",
    "surface_features": f"""with {_CLEAN}, x as (select day, dte, avg(iv) as m from c where dte >= 5 group by 1, 2), w as (select day, min(dte) as near, arg_max(m, dte) - arg_min(m, dte) as slope from x where m is not null group by 1),
n as {_nearest('day', [('false', 0.5), ('false', 0.25), ('false', 0.1)], 'iv is not null and dte = (select min(q.dte) from c q where q.day = c.day and q.dte >= 5)')},
p as (select day, dte, max(iv) filter (where target = 0.25) as i25, max(iv) filter (where target = 0.1) as i10, max(iv) filter (where target = 0.5) as i50 from n group by 1, 2)
select day, dte, round(i25, 6) as iv25, round(i10, 6) as iv10, round(i25 - i50, 6) as skew, round(i10 - i25, 6) as wing, round(slope, 6) as slope from p join w using (day)""",
    "stress_sizes": f"""with {_CLEAN}, {_STRESS}, st as (select *, list_filter(range(1, greatest(floor({BUDGET} / nullif(net, 0)), 0)::bigint + 1), lambda n: n * net + least(greatest({LEAST}, {WIDTH} * sqrt(n * gamma * 100)), n * abs(delta) * 100) * move <= {BUDGET}) as hs,
  list_filter(range(1, greatest(floor({BUDGET} / nullif(net, 0)), 0)::bigint + 1), lambda n: n * net + n * abs(delta) * 100 * move <= {BUDGET}) as us from cs where not call and delta is not null)
select event_id, case when net > 0 then coalesce(list_max(hs), 0) else 0 end::int as fit, case when net > 0 then coalesce(list_max(us), 0) else 0 end::int as unhedged, round(greatest({LEAST}, {WIDTH} * sqrt(gamma * 100)), 6) as band,
  round(case when event_id % 4 > 0 then mid when event_id % 3 = 0 then greatest(last * 0.9, greatest(strike - fwd, 0)) else least(last * 0.9, greatest(strike - fwd, 0)) end, 6) as mark from st""",
}
