"""Queries over daily features and books: forecasts, signals, reports; and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, forecasts, reports, signals
from ..sources import adapters as a
from ..sources.adapters import derived


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.daily_features(derived(spark, sf_dir, a.BARS), derived(spark, sf_dir, a.INDICES))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing variance and the volatility index as forecasts of the next 22 days."""
    rows = _features(spark, sf_dir).join(features.forward_target(derived(spark, sf_dir, a.BARS), 22), ["symbol", "date"])
    two = F.explode(F.array(F.struct(F.lit("trailing").alias("name"), F.sqrt(F.col("rv_m") * 252 / 1e4).alias("forecast")), F.struct(F.lit("index").alias("name"), (F.col("vix") / 100).alias("forecast"))))
    return rows.select("symbol", "date", "target", two.alias("_f")).select("symbol", "date", "target", "_f.*").where("target > 0 and forecast > 0")


def har_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    fit = forecasts.ols(_features(spark, sf_dir).withColumn("ahead", F.lead("rv").over(w)), ["symbol"], "ahead", ["rv_d", "rv_w", "rv_m"])
    return fit.select("symbol", "n", *[F.round(c, 5).alias(c) for c in ("intercept", "b_rv_d", "b_rv_w", "b_rv_m")])


def forecast_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("name", F.year("date").alias("fold"), forecasts.qlike(F.col("target"), F.col("forecast")).alias("loss"), (100 * (F.col("forecast") - F.col("target"))).alias("bias"))
    return forecasts.losses(rows).select("name", "fold", "n", *[F.round(c, 5).alias(c) for c in ("mean_loss", "median_loss", "median_bias")])


def loss_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = forecasts.qlike(F.col("target"), F.col("forecast"))
    gaps = _scored(spark, sf_dir).groupBy("symbol", "date").agg((F.max(F.when(F.col("name") == "index", loss)) - F.max(F.when(F.col("name") == "trailing", loss))).alias("gap"))
    return forecasts.newey_west(gaps, ["symbol"], "date", "gap").select("symbol", "n", *[F.round(c, 5).alias(c) for c in ("mean", "se", "t")])


def corrected_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.bias_corrected(_scored(spark, sf_dir).where("name = 'index'"), ["symbol"]).select("symbol", "date", F.round("corrected", 6).alias("corrected"))


def daily_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir).withColumn("premium", F.col("vix") / 100 - F.sqrt(F.col("rv_m") * 252 / 1e4))
    rows = rows.withColumn("signal", signals.gated(signals.band(F.col("premium"), 0.05, -0.05), F.col("term"), 1.0))
    return signals.flat_days(rows, 3).select("symbol", "date", "signal", "reset")


def trend_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.trend_measures(_features(spark, sf_dir))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily profit on the days of third-week Wednesdays against the others."""
    d = reports.daily(derived(spark, sf_dir, a.TRIPS)).withColumn("event", (F.dayofweek("date") == 4) & F.dayofmonth("date").between(15, 21))
    return reports.two_samples(d, ["book"], "event", "pnl").select("book", "n0", "n1", *[F.round(c, 4).alias(c) for c in ("mean0", "mean1", "t")])


QUERIES = {f.__name__: f for f in (har_fit, forecast_losses, loss_gap, corrected_forecast, daily_signal, trend_measures, event_days)} | {
    "tail_table": lambda s, d: reports.tail_table(derived(s, d, a.TRIPS)),
    "period_table": lambda s, d: reports.period_table(derived(s, d, a.TRIPS)),
    "trip_errors": lambda s, d: reports.trip_errors(derived(s, d, a.TRIPS)),
    "gap_intervals": lambda s, d: reports.gap_intervals(derived(s, d, a.TRIPS)),
    "terciles": lambda s, d: reports.terciles(derived(s, d, a.TRIPS), "commission"),
    "stop_reentry": lambda s, d: reports.stop_reentry(derived(s, d, a.TRIPS)),
    "last_of_day": lambda s, d: reports.last_of_day(derived(s, d, a.TAPE).withColumn("day", F.to_date("ts")).select("day", "expiry_no", "ts", "event_id", "price"), ["day", "expiry_no"], ["ts", "event_id"]).select("day", "expiry_no", "event_id", "price"),
    "picks": lambda s, d: reports.picks(derived(s, d, a.CANDIDATES), "day", "score", "name").withColumn("total", F.round("total", 2)),
}


def oracles(daily: str, target: str) -> dict[str, str]:
    """SQL of the queries above, on the SQL of daily features and forward targets."""
    scored = f"""f as ({daily}), g as ({target}), s0 as (select symbol, date, target, 'trailing' as name, sqrt(rv_m * 252 / 1e4) as forecast from f join g using (symbol, date) union all select symbol, date, target, 'index', vix / 100 from f join g using (symbol, date)),
s as (select *, pow(target / forecast, 2) - ln(pow(target / forecast, 2)) - 1 as loss from s0 where target > 0 and forecast > 0)"""
    net = f"t as (select *, pnl - commission as net from ({a.TRIPS}) q), d as (select book, exit as date, sum(net) as pnl from t group by all)"
    lag = " + ".join(f"2 * {1 - k / 23} * coalesce(lag(g, {k}) over w, 0)" for k in range(1, 23))
    det = "(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz))"
    return {
        "har_fit": f"""with f as ({daily}), l as (select symbol, rv_d as x, rv_w as y, rv_m as z, lead(rv) over (partition by symbol order by date) as v from f),
c as (select symbol, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, avg(v) as mv, var_pop(x) as xx, var_pop(y) as yy, var_pop(z) as zz, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz, covar_pop(x, v) as xv, covar_pop(y, v) as yv, covar_pop(z, v) as zv from l where x is not null and y is not null and z is not null and v is not null group by 1),
b as (select *, (xv * (yy * zz - yz * yz) - xy * (yv * zz - yz * zv) + xz * (yv * yz - yy * zv)) / {det} as bx, (xx * (yv * zz - yz * zv) - xv * (xy * zz - yz * xz) + xz * (xy * zv - yv * xz)) / {det} as by_, (xx * (yy * zv - yv * yz) - xy * (xy * zv - yv * xz) + xv * (xy * yz - yy * xz)) / {det} as bz from c)
select symbol, n, round(mv - bx * mx - by_ * my - bz * mz, 5) as intercept, round(bx, 5) as b_rv_d, round(by_, 5) as b_rv_w, round(bz, 5) as b_rv_m from b""",
        "forecast_losses": f"""with {scored}, y as (select *, year(date)::int as fold, 100 * (forecast - target) as bias from s)
select name, fold, count(*) as n, round(avg(loss), 5) as mean_loss, round(quantile_cont(loss, 0.5), 5) as median_loss, round(quantile_cont(bias, 0.5), 5) as median_bias from y group by grouping sets ((name, fold), (name))""",
        "loss_gap": f"""with {scored}, p as (select symbol, date, max(loss) filter (where name = 'index') - max(loss) filter (where name = 'trailing') as gap from s group by all),
c as (select *, gap - avg(gap) over (partition by symbol) as g from p where gap is not null), v as (select *, g * (g + {lag}) as v from c window w as (partition by symbol order by date)),
e as (select symbol, count(*) as n, avg(gap) as mean, sqrt(greatest(avg(v), 0) / count(*)) as se from v group by 1) select symbol, n, round(mean, 5) as mean, round(se, 5) as se, round(case when se > 0 then mean / se end, 5) as t from e""",
        "corrected_forecast": f"""with {scored}, e as (select *, ln(target / forecast) as e from s where name = 'index')
select symbol, date, round(forecast * exp(coalesce(quantile_cont(e, 0.5) over (partition by symbol order by date rows between 274 preceding and 23 preceding), 0)), 6) as corrected from e""",
        "daily_signal": f"""with f as ({daily}), p as (select *, vix / 100 - sqrt(rv_m * 252 / 1e4) as premium from f),
q as (select symbol, date, case when premium > 0.05 then case when coalesce(term <= 1, false) then 'short' else 'flat' end when premium < -0.05 then 'long' else 'flat' end as signal from p)
select symbol, date, signal, count(*) over w = 3 and count(*) filter (where signal = 'flat') over w = 3 as reset from q window w as (partition by symbol order by date rows 2 preceding)""",
        "trend_measures": f"""with f as ({daily}), g as (select *, vix - lag(vix) over w as dv from f window w as (partition by symbol order by date))
select symbol, date, round(case when count(ret) over w5 = 5 then sum(ret) over w5 end, 6) as ret5, round(case when count(ret) over w20 = 20 then sum(ret) over w20 end, 6) as ret20, round(vix - lag(vix, 5) over w, 6) as vix5,
  round(case when count(ret) over w10 = 10 and sum(abs(ret)) over w10 > 0 then abs(sum(ret) over w10) / sum(abs(ret)) over w10 end, 6) as efficiency,
  round(case when count(ret * dv) over y < 21 or var_samp(ret) over y = 0 then 0 else covar_samp(dv, ret) over y / var_samp(ret) filter (where dv is not null) over y end, 4) as beta, round(1 + 0.5 * (2 * vix_pct - 1), 6) as tilt
from g window w as (partition by symbol order by date), w5 as (partition by symbol order by date rows 4 preceding), w20 as (partition by symbol order by date rows 19 preceding), w10 as (partition by symbol order by date rows between 10 preceding and 1 preceding), y as (partition by symbol order by date rows 251 preceding)""",
        "event_days": f"""with {net}, e as (select *, dayofweek(date) = 3 and day(date) between 15 and 21 as ev from d),
g as (select book, count(*) filter (where ev) as n0, count(*) filter (where not ev) as n1, avg(pnl) filter (where ev) as mean0, avg(pnl) filter (where not ev) as mean1, var_samp(pnl) filter (where ev) as v0, var_samp(pnl) filter (where not ev) as v1 from e group by 1)
select book, n0, n1, round(mean0, 4) as mean0, round(mean1, 4) as mean1, round((mean0 - mean1) / sqrt(v0 / n0 + v1 / n1), 4) as t from g""",
        "tail_table": f"""with {net}, r as (select *, row_number() over (partition by book order by pnl, date) as r from d)
select book, round(min(pnl), 2) as worst, min(date) filter (where r = 1) as worst_date, round(quantile_cont(pnl, 0.05), 2) as q5, round(stddev_samp(pnl), 4) as deviation, round(sum(pnl) filter (where r <= 20), 2) as worst_sum from r group by 1""",
        "period_table": f"""with {net}, y as (select *, year(exit)::int as year from t)
select book, year, count(*) as trips, round(sum(pnl), 2) as gross, round(sum(net), 2) as net, round(sum(commission), 2) as commission, round(avg((net > 0)::int), 6) as win_rate from y group by grouping sets ((book, year), (book))""",
        "trip_errors": f"""with {net} select book, side, reason, count(*) as trips, round(avg(net), 4) as mean, round(stddev_samp(net) / sqrt(count(*)), 4) as se, round(quantile_cont(datediff('day', entry, exit), 0.5), 2) as median_days from t group by all""",
        "gap_intervals": f"""with {net}, g as (select *, datediff('day', lag(date) over (partition by book order by date), date) as gap from d)
select book, case when gap <= 2 then 'night' when gap <= 4 then 'weekend' else 'longer' end as gap, count(*) as n, round(avg(pnl), 4) as mean, round(sum(pnl), 2) as total from g where gap is not null group by 1, 2""",
        "terciles": f"""with {net}, c as (select book, quantile_cont(commission, 1/3) as c1, quantile_cont(commission, 2/3) as c2 from t group by 1)
select book, (commission > c1)::int + (commission > c2)::int as tercile, count(*) as n, round(sum(net), 2) as net, round(avg(net), 4) as mean from t join c using (book) group by 1, 2""",
        "stop_reentry": f"""with {net}, s as (select distinct book, side, exit as at from t where reason = 'stop'), n as (select t.book, t.side, count(*) as soon from t asof join s on t.book = s.book and t.side = s.side and t.entry >= s.at where t.entry - s.at <= 5 group by 1, 2)
select k.book, k.side, k.stops, coalesce(soon, 0) as soon from (select book, side, count(*) filter (where reason = 'stop') as stops from t group by 1, 2) k left join n using (book, side)""",
        "last_of_day": f"select ts::date as day, expiry_no, event_id, price from ({a.TAPE}) t qualify row_number() over (partition by ts::date, expiry_no order by ts desc, event_id desc) = 1",
        "picks": f"""with c as ({a.CANDIDATES}), r as (select *, row_number() over (partition by day order by score desc, name) as r from c)
select day, max(name) filter (where r = 1) as pick, max(score) filter (where r = 1) - max(score) filter (where r = 2) as lead, max(label) as best, round(sum(label), 2) as total, count(*) as n from r group by 1""",
    }
