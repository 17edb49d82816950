"""Named queries of the library, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import books, calendar, features
from .plans import desk, forwards, life, market, options, periods, ranking, research, scores, stores, studies, trades, trips, views
from .sources import adapters as a
from .sources.adapters import derived


def daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.daily_features(derived(spark, sf_dir, a.BARS), derived(spark, sf_dir, a.INDICES))


def forward_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.forward_target(derived(spark, sf_dir, a.BARS), 22)


def calendar_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, a.TRIPS).select("trade", "entry", "exit").where("exit >= entry")
    e, x = F.col("entry"), F.col("exit")
    return rows.select("trade", calendar.roll_saturday(e).alias("rolled"), calendar.third_friday(e).alias("third_friday"), calendar.weekdays_between(e, x).cast("long").alias("weekdays"), calendar.horizon(F.datediff(x, e)).alias("horizon"))


QUERIES = {
    "daily_features": daily_features,
    "forward_target": forward_target,
    "calendar_scalars": calendar_scalars,
    "book_metrics": lambda s, d: books.book_metrics(derived(s, d, a.TRIPS)),
    "by_reason": lambda s, d: books.by_reason(derived(s, d, a.TRIPS)),
    "open_positions": lambda s, d: books.open_positions(derived(s, d, a.TRIPS)),
    "spread_fit": lambda s, d: books.spread_fit(derived(s, d, a.QUOTES), [7, 14, 30], [0.5, 0.75]),
}

ORACLES = {
    "daily_features": f"""
with b as ({a.BARS}), i as ({a.INDICES}),
r as (select *, ln(close / lag(close) over w) as ret, ln(high / low) as hl from b window w as (partition by symbol order by date)),
s as (select *, coalesce(hl > 20 * case when count(hl) over p >= 5 then quantile_cont(hl, 0.5) over p end, false) as bad
      from r window p as (partition by symbol order by date rows between 22 preceding and 1 preceding)),
t as (select *, case when bad then ret * ret else 0.5 * hl * hl - 0.38629436111989061 * pow(ln(close / open), 2) end as rv from s),
u as (select t.*, case when count(rv) over w5 = 5 then avg(rv) over w5 end as w5, case when count(rv) over w22 = 22 then avg(rv) over w22 end as w22,
             case when count(close) over w50 = 50 then avg(close) over w50 end as ma, case when count(close) over w200 = 200 then avg(close) over w200 end as ma200, i.vix as v0, i.vix3m as v3, i.irx as rf
      from t left join i using (date) window w5 as (partition by symbol order by date rows 4 preceding), w22 as (partition by symbol order by date rows 21 preceding), w50 as (partition by symbol order by date rows 49 preceding), w200 as (partition by symbol order by date rows 199 preceding)),
v as (select *, last_value(v0 ignore nulls) over w as vx, last_value(v3 ignore nulls) over w as vx3, last_value(rf ignore nulls) over w as irx0 from u window w as (partition by symbol order by date rows unbounded preceding)),
x as (select *, list(vx) filter (where vx is not null) over (partition by symbol order by date rows 251 preceding) as yr from v)
select symbol, date, round(ret, 6) as ret, bad, round(rv * 1e4, 6) as rv, round(rv * 1e4, 6) as rv_d, round(w5 * 1e4, 6) as rv_w, round(w22 * 1e4, 6) as rv_m,
  case when ma is not null then close > ma end as above50, case when ma200 is not null then close > ma200 end as above200, round(irx0, 6) as irx, round(vx, 6) as vix, round(vx / vx3, 6) as term,
  round(case when len(yr) = 252 then (len(list_filter(yr, lambda q: q < vx)) + (len(list_filter(yr, lambda q: q = vx)) + 1) / 2) / 252 end, 6) as vix_pct
from x""",
    "forward_target": f"""
with r as (select symbol, date, ln(close / lag(close) over (partition by symbol order by date)) as ret from ({a.BARS}) b)
select symbol, date, round(case when count(ret) over w = 22 then sqrt(252 * avg(ret * ret) over w) end, 6) as target
from r window w as (partition by symbol order by date rows between 1 following and 22 following)""",
    "calendar_scalars": f"""
select trade, case when dayofweek(entry) = 6 then (entry - interval 1 day)::date else entry end as rolled,
  (date_trunc('month', entry) + to_days(((12 - dayofweek(date_trunc('month', entry)::date)) % 7 + 14)::int))::date as third_friday,
  len(list_filter(range(entry::timestamp, exit::timestamp, interval 1 day), lambda q: isodow(q) < 6))::bigint as weekdays,
  greatest(1, round_even(datediff('day', entry, exit) * 252 / 365, 0)::int) as horizon
from ({a.TRIPS}) t where exit >= entry""",
    "book_metrics": f"""
with t as ({a.TRIPS}), d as (select book, exit as date, sum(pnl - commission) as pnl from t group by all),
e as (select *, sum(pnl) over w as total from d window w as (partition by book order by date rows unbounded preceding)),
f as (select *, greatest(max(total) over (partition by book order by date rows unbounded preceding), 0) - total as down from e),
c as (select book, quantile_cont(pnl, 0.05) as cut from d group by 1),
r as (select f.book, round(sum(pnl), 2) as pnl, round(case when stddev_samp(pnl) > 0 then avg(pnl / 1e6) / stddev_samp(pnl / 1e6) * sqrt(252.0) end, 6) as sharpe,
      round(max(down), 2) as max_drawdown, round(avg(pnl) filter (where pnl <= cut), 2) as shortfall from f join c using (book) group by 1),
h as (select book, count(*) as trips, round(avg((pnl - commission > 0)::int), 6) as win_rate, round(avg(datediff('day', entry, exit)), 6) as days_held from t group by 1)
select * from r join h using (book)""",
    "by_reason": f"""
select book, side, reason, round(sum(pnl - commission), 2) as net, count(*) as n from ({a.TRIPS}) t group by grouping sets ((book, side, reason), (book, side))""",
    "open_positions": f"""
with t as ({a.TRIPS}), s as (select book, entry as date, 1 as d from t union all select book, exit, -1 from t), n as (select book, date, sum(d) as d from s group by all)
select book, date, (sum(d) over (partition by book order by date))::bigint as open from n""",
    "spread_fit": f"""
select tier, bucket, count(*) as n, round(regr_intercept(half, mid), 6) as a, round(regr_slope(half, mid), 6) as b, round(quantile_cont(half, 0.5), 6) as median_half
from (select *, (dte > 7)::int + (dte > 14)::int + (dte > 30)::int as bucket, (abs(delta) > 0.5)::int + (abs(delta) > 0.75)::int as tier from ({a.QUOTES}) q) group by all""",
}

QUERIES |= {**options.QUERIES, **research.QUERIES, **market.QUERIES, **trades.QUERIES, **scores.QUERIES, **studies.QUERIES, **desk.QUERIES}
ORACLES |= {**options.ORACLES, **research.oracles(ORACLES["daily_features"], ORACLES["forward_target"]), **market.ORACLES, **trades.ORACLES}
ORACLES |= scores.oracles(ORACLES["book_metrics"], ORACLES["daily_features"], ORACLES["forward_target"], ORACLES["daily_signal"])
ORACLES |= studies.oracles(ORACLES["daily_features"], ORACLES["forward_target"], ORACLES["har_fit"])
ORACLES |= desk.oracles(ORACLES["smile_views"], ORACLES["book_days"].replace("round(realized, 3)", "realized").replace("round(open, 3)", "open").replace("round(realized + open, 3)", "realized + open"), ORACLES["har_iterated"])
QUERIES |= {**forwards.QUERIES, **views.QUERIES, **stores.QUERIES, **life.QUERIES, **periods.QUERIES}
ORACLES |= {**forwards.ORACLES, **views.ORACLES, **stores.ORACLES, **life.oracles(ORACLES["book_metrics"], ORACLES["trend_measures"])}
ORACLES |= periods.oracles(ORACLES["daily_features"], ORACLES["forward_target"], ORACLES["daily_signal"], ORACLES["trend_measures"])
QUERIES |= ranking.QUERIES
ORACLES |= ranking.oracles(trades.SLOT_EXITS, ORACLES["daily_features"], ORACLES["forward_target"])
QUERIES |= trips.QUERIES
ORACLES |= trips.oracles(ORACLES["entry_log"], ORACLES["daily_features"], ORACLES["forward_target"], ORACLES["trend_measures"], *[ORACLES[n] for n in ("candidate_features", "surface_features", "days_to_event")])
