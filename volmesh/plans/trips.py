"""Queries over closed trips, stored models, normal bars and re-scored fits; and the same rows in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue, features, forecasts, life as lives, models, series, signals, trips
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived
from . import life, market, options, periods, research, studies

#: Weekdays after a stop that count as soon; first day of a hold-out; days that a fit of 22 days ahead may learn from end here; lowest volatility of a forecast.
#: Days between the daily series and the option tape; the symbol whose days are the candidates' own.
SHIFT, BOOK = 10_227, "1-URGENT"
NEAR, HOLDOUT, LEARN, LOWEST = 3, "1996-06-01", "1996-12-01", 0.05


def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades, _, ends = life._all(spark, sf_dir)
    state = (F.col("mid0") / F.col("fwd0")).alias("state")
    return ends.drop("side").join(trades.select("entry", "call", "side", "day0", "mid0", state), "entry").withColumns({"qty": (1 + F.col("entry") % 3).cast("double"), "credit": F.col("mid0") * 100})


def stop_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops by right, days that they blocked, and the trips soon after one."""
    rows = store.settle(_closed(spark, sf_dir))
    log = life.entry_log(spark, sf_dir).join(rows.select("entry", "call"), "entry")
    out = trips.stop_stats(rows, log, ["call"], NEAR)
    return out.withColumns({c: F.round(c, 3) for c in ("after_pnl", "other_pnl")})


def contract_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trips.contract_table(_closed(spark, sf_dir).withColumn("pnl_net", F.col("pnl_net") * F.col("qty")), ["side"])
    return out.select("side", "trips", "stops", "profits", *[F.round(c, 4).alias(c) for c in ("mean_qty", "median_qty", "max_qty", "credit", "net_per_contract", "mean_per_contract", "se")])


def spread_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees and cost of the spread by side, from closes at once and twice the spread."""
    trades, rows, once = life._all(spark, sf_dir)
    twice = lives.closed(trades, rows, lives.expiry_spots(life._marks(spark, sf_dir)), replace(life.RULES, multiple=2.0))
    out = trips.spread_costs(once, twice, ["side"])
    return out.select("side", F.round("commission", 3).alias("commission"), F.round("spread", 3).alias("spread"))


def state_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trips.state_buckets(_closed(spark, sf_dir), "side", "state", "pnl_net")
    return out.select("side", "bucket", "n", F.round("total", 3).alias("total"), F.round("mean", 4).alias("mean"))


def state_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trips.state_split(_closed(spark, sf_dir), "side", "state", "pnl_net")
    return out.select("side", "top_n", *[F.round(c, 4).alias(c) for c in ("top_mean", "rest_mean", "corr")])


def event_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.event_years(life.entry_log(spark, sf_dir))


def holdout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.holdout_used(derived(spark, sf_dir, a.RUNS), HOLDOUT)


def normal_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.normal_bars(derived(spark, sf_dir, a.RAW_BARS), {f"P_{c}": c.lower() for c in ("Open", "High", "Low", "Close", "Volume")}, "Stamp")
    return rows.select("symbol", "date", "volume", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")])


def stored_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes valued by a spread model that was written to a table and read again."""
    folder = store.fresh(spark, "model")
    fit = models.pooled_spread(studies._quotes(spark, sf_dir), studies.THIN).select("tier", "bucket", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))
    models.save_model(fit, {"floor": 0.02, "method": "least squares"}, folder)
    model, meta = models.load_model(spark, folder)
    rows = signals.half_spread(studies._quotes(spark, sf_dir).drop("tier", "bucket"), model, options.EDGES, options.TIERS, float(meta["floor"]))
    return rows.select("quote", F.round("fitted", 6).alias("fitted"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each snapshot with what was known of the day before (indices, variances, returns), the day's surface, its weekday and the days to the next event. Candidates are of 2024, days of 1996: they are SHIFT days apart."""
    w = Window.partitionBy("symbol").orderBy("date")
    days = research._features(spark, sf_dir).where(F.col("symbol") == BOOK).withColumn("dvix_5", F.col("vix") - F.lag("vix", 5).over(w))
    trend = features.trend_measures(research._features(spark, sf_dir)).where(F.col("symbol") == BOOK).select("date", F.col("ret5").alias("ret_5"), F.col("ret20").alias("ret_20"))
    events = market.days_to_event(spark, sf_dir).select(F.date_add("date", SHIFT).alias("day"), F.col("days").alias("event_days"))
    known = days.join(trend, "date").select(F.date_add("date", SHIFT + 1).alias("day"), "ret", "rv_d", "rv_w", "rv_m", "vix", "term", "vix_pct", "above50", "above200", F.round("dvix_5", 6).alias("dvix_5"), "ret_5", "ret_20")
    surface = market.surface_features(spark, sf_dir).select("day", "skew", "wing", "slope")
    rows = life.candidate_features(spark, sf_dir).withColumn("weekday", F.weekday("day"))
    return rows.join(known, "day", "left").join(surface, "day", "left").join(events, "day", "left")


def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.moving_averages(derived(spark, sf_dir, a.BARS), [50, 200])
    return rows.withColumns({c: F.round(c, 4) for c in ("ma_50", "ma_200")})


def harx_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of each later day by a fit of the days before, with and without the index's variance and the week's return; no lower than 5 %."""
    rows = features.trend_measures(research._features(spark, sf_dir)).select("symbol", "date", F.col("ret5").alias("ret_w"))
    days = research._features(spark, sf_dir).select("symbol", "date", "rv_d", "rv_w", "rv_m", (F.pow(F.col("vix") / 100, 2) / 252 * 1e4).alias("vix_var")).join(rows, ["symbol", "date"])
    ahead = features.forward_target(derived(spark, sf_dir, a.BARS), 22).select("symbol", "date", (F.pow("target", F.lit(2)) / 252 * 1e4).alias("ahead"))
    days = store.settle(days.join(ahead, ["symbol", "date"], "left"))
    out = None
    for name, xs in (("har_gk", periods.HARX[:3]), ("harx", periods.HARX)):
        fit = forecasts.ols(days.where(F.col("date") < F.to_date(F.lit(LEARN))), ["symbol"], "ahead", xs)
        got = forecasts.rescored(days.where(F.col("date") >= F.to_date(F.lit("1997-01-01"))), fit, ["symbol"], xs, LOWEST).select("symbol", "date", F.round("vol", 6).alias(name))
        out = got if out is None else out.join(got, ["symbol", "date"], "left")
    return out


QUERIES = {f.__name__: f for f in (stop_stats, contract_trips, spread_costs, state_buckets, state_split, event_years, holdout_runs, normal_bars, stored_spread, candidate_rows, moving_averages, harx_forecasts)}


def oracles(log: str, daily: str, target: str, trend: str, candidates: str, surface: str, events: str) -> dict[str, str]:
    """SQL of the queries above, on the SQL of the entry log, daily features, forward targets and trends."""
    c = f"with {life._ctes()}, tr as (select cl.* exclude (side), en.call, en.side, en.day0, en.mid0, en.mid0 / en.fwd0 as state, (1 + entry % 3)::double as qty from cl join en using (entry)), lo as ({log})"
    week = "len(list_filter(range({0}::timestamp, {1}::timestamp, interval 1 day), lambda q: isodow(q) < 6))"
    both = "(select side, state, pnl_net from tr union all select 'all', state, pnl_net from tr)"

    def fit(name: str, xs: list[str]) -> str:
        steps = periods.elimination(xs, name)
        terms = " + ".join(f"b_{x} * x.{x}" for x in xs)
        return f"{steps}, {name} as (select x.symbol, x.date, sqrt(252 * greatest((intercept + {terms}) / 1e4, {LOWEST}::double * {LOWEST} / 252)) as vol from x join {name}_f f on f.symbol = x.symbol where x.date >= date '1997-01-01' and {' and '.join(f'x.{x} is not null' for x in xs)})"

    return {
        "stop_stats": f"""{c}, r as (select *, coalesce(lag(reason) over w = 'stop' and lag(side) over w = side, false) as reentry, exists (select 1 from tr s where s.call = tr.call and s.reason = 'stop' and s.exit_day <= tr.day0 and {week.format('s.exit_day', 'tr.day0')} <= {NEAR}) as after from tr window w as (partition by call order by exit_day, entry)),
b as (select call, count(distinct day) as blocked_days from lo join (select entry, call from tr) using (entry) where why in ('cooloff', 'reset_wait') group by 1)
select r.call, count(*) filter (where reason = 'stop') as stops, count(*) filter (where reentry) as reentries, count(*) filter (where after) as after_n, round(coalesce(sum(pnl_net) filter (where after), 0), 3) as after_pnl, count(*) filter (where not after) as other_n, round(coalesce(sum(pnl_net) filter (where not after), 0), 3) as other_pnl, coalesce(any_value(blocked_days), 0) as blocked_days
from r left join b on b.call = r.call group by 1""",
        "contract_trips": f"""{c} select side, count(*) as trips, count(*) filter (where reason = 'stop') as stops, count(*) filter (where reason = 'profit') as profits, round(avg(qty), 4) as mean_qty, round(quantile_cont(qty, 0.5), 4) as median_qty, round(max(qty), 4) as max_qty, round(avg(mid0 * 100), 4) as credit,
  round(sum(pnl_net * qty) / sum(qty), 4) as net_per_contract, round(avg(pnl_net), 4) as mean_per_contract, round(stddev_samp(pnl_net) / sqrt(count(*)), 4) as se from tr group by 1""",
        "spread_costs": f"""{c}, m2 as (with {life._ctes(2.0)} select entry, side, commission, pnl_net from cl) select x.side, round(sum(x.commission), 3)::double as commission, round(sum(x.pnl_net + x.commission) - sum(m2.pnl_net + m2.commission), 3) as spread from cl x join m2 using (entry) group by 1""",
        "state_buckets": f"""{c}, bo as {both}, k as (select side, quantile_cont(state, 1/3) as c1, quantile_cont(state, 2/3) as c2 from bo group by 1)
select side, ((state > c1)::int + (state > c2)::int)::int as bucket, count(*) as n, round(sum(pnl_net), 3) as total, round(avg(pnl_net), 4) as mean from bo join k using (side) group by 1, 2""",
        "state_split": f"""{c}, bo as {both}, k as (select side, quantile_cont(state, 0.9) as c9 from bo group by 1)
select side, count(*) filter (where state > c9) as top_n, round(avg(pnl_net) filter (where state > c9), 4) as top_mean, round(avg(pnl_net) filter (where state <= c9), 4) as rest_mean, round(corr(state, pnl_net), 4) as corr from bo join k using (side) group by 1""",
        "event_years": f"with lo as ({log}) select year(day)::int as year, why, count(distinct day) as days from lo where why is not null group by 1, 2",
        "holdout_runs": f"select split_part(name, '/', 1) as card, count(*) filter (where ran >= date '{HOLDOUT}') as runs, min(ran) filter (where ran >= date '{HOLDOUT}') as first, bool_or(ran >= date '{HOLDOUT}') as used from ({a.RUNS}) r group by 1",
        "normal_bars": f"""select symbol, cast(Stamp as date) as date, P_Volume as volume, round(P_Open, 4) as open, round(P_High, 4) as high, round(P_Low, 4) as low, round(P_Close, 4) as close from ({a.RAW_BARS}) r where P_Open is not null and P_High is not null and P_Low is not null and P_Close is not null and P_Volume is not null""",
        "stored_spread": f"""with {studies._SPREAD} select quote, round(greatest(0.02, a + b * mid), 6) as fitted from z join m using (tier, bucket)""",
        "candidate_rows": f"""with f as (select *, round(vix - lag(vix, 5) over (order by date), 6) as dvix_5 from ({daily}) d where symbol = '{BOOK}'), tq as (select date, ret5 as ret_5, ret20 as ret_20 from ({trend}) t where symbol = '{BOOK}'), ca as ({candidates}), su as ({surface}), ev as ({events})
select ca.*, (isodow(ca.day) - 1)::int as weekday, ret, rv_d, rv_w, rv_m, vix, term, vix_pct, above50, above200, dvix_5, ret_5, ret_20, skew, wing, slope, ev.days as event_days
from ca left join (select * from f join tq using (date)) k on k.date + {SHIFT + 1} = ca.day left join su on su.day = ca.day left join ev on ev.date + {SHIFT} = ca.day""",
        "moving_averages": f"""select symbol, date, round(case when n50 = 50 then m50 end, 4) as ma_50, case when n50 = 50 then close > m50 end as above_50, round(case when n200 = 200 then m200 end, 4) as ma_200, case when n200 = 200 then close > m200 end as above_200
from (select *, count(close) over w50 as n50, avg(close) over w50 as m50, count(close) over w200 as n200, avg(close) over w200 as m200 from ({a.BARS}) b window w50 as (partition by symbol order by date rows 49 preceding), w200 as (partition by symbol order by date rows 199 preceding)) z""",
        "harx_forecasts": f"""with f as ({daily}), tq as ({trend}), k as ({target}), x as (select f.symbol, f.date, rv_d, rv_w, rv_m, pow(vix / 100, 2) / 252 * 1e4 as vix_var, ret5 as ret_w, pow(target, 2) / 252 * 1e4 as y from f join tq using (symbol, date) left join k using (symbol, date)),
{fit('har_gk', periods.HARX[:3])}, {fit('harx', periods.HARX)} select g.symbol, g.date, round(g.vol, 6) as har_gk, round(h.vol, 6) as harx from har_gk g left join harx h on h.symbol = g.symbol and h.date = g.date""",
    }
