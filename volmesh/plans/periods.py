"""Queries of tables by period, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import catalogue, chains, features, forecasts, periods, reports, scorecards
from ..operators.reports import net
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived
from . import life, market, research, scores

SPLIT = "1995-06-01"
PERIODS = [("all", None, None), ("early", None, SPLIT), ("late", SPLIT, None)]
BARS = [("pnl", "higher", 0.0, "all"), ("worst", "not_below", 50.0, "early"), ("worst", "not_below", 50.0, "late"), ("deviation", "at_most", 4000.0, "late")]
LEAST_STOPS = 100
CRASHES = [("spring", "1995-03-01", "1995-06-01"), ("summer", "1997-07-01", "1997-10-01")]
SMALL = 100.0
CALM, LEAST_CALM = 20.0, 30
WEEK_END = "1998-07-31"
HARX = ["rv_d", "rv_w", "rv_m", "vix_var", "ret_w"]


def _units() -> Column:
    return F.col("commission") / 0.65


def _period_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periods.in_periods(scores._variants(spark, sf_dir), PERIODS, "exit")
    return rows.groupBy("book", "variant", "multiple", "period").agg(
        F.count(F.lit(1)).alias("trips"), F.sum(net()).alias("pnl"), F.sum("commission").alias("commission"), F.stddev_samp(net()).alias("deviation"), F.min(net()).alias("worst"), F.avg((net() > 0).cast("double")).alias("win_rate"))


def variant_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by variant, cost multiple and period."""
    rows = _period_table(spark, sf_dir)
    return rows.select("book", "variant", "multiple", "period", "trips", *[F.round(c, 3).alias(c) for c in ("pnl", "commission", "deviation", "worst")], F.round("win_rate", 6).alias("win_rate"))


def period_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.period_checks(_period_table(spark, sf_dir), ["book", "multiple"], "variant", "plain", BARS, scorecards.RULES)


def period_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's variant passes if all bars hold at all multiples and periods; too few stops (at multiple 1) leave it open."""
    stops = scores._variants(spark, sf_dir).where("multiple = 1 and reason = 'stop'").groupBy("book", "variant").agg(F.count(F.lit(1)).alias("n"))
    return periods.verdicts(period_bars(spark, sf_dir), ["book", "variant"], stops, LEAST_STOPS)


def tail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.tails(derived(spark, sf_dir, a.TRIPS), _units())
    return out.select("book", "trough", *[F.round(c, 3).alias(c) for c in ("q5", "shortfall", "most")])


def crash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.window_sums(derived(spark, sf_dir, a.TRIPS), CRASHES, _units())
    return out.select("book", "period", "entries", *[F.round(c, 3).alias(c) for c in ("units", "most", "net", "daily")])


def fee_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("units")
    plans = {"fixed": F.greatest(u * 0.005, F.lit(1.0)), "tiered": F.greatest(u * 0.0035, F.lit(0.35)) + u * 0.001}
    out = periods.fees_by_period(derived(spark, sf_dir, a.TRIPS).withColumn("units", _units()), PERIODS, "entry", "units", plans, SMALL)
    return out.select("book", "period", "orders", F.round("under", 6).alias("under"), "fixed", "tiered")


def weekday_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips and net profit a trip by book and weekday of entry (0 is Monday)."""
    return derived(spark, sf_dir, a.TRIPS).groupBy("book", F.weekday("entry").alias("weekday")).agg(F.count(F.lit(1)).alias("trips"), F.round(F.avg(net()), 4).alias("per_trip"))


def signal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each signal by symbol and year; days whose signal is unknown count in `days` alone."""
    of = lambda s: F.count(F.when(F.col("signal") == s, 1)).alias(s)
    return research.daily_signal(spark, sf_dir).groupBy("symbol", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("days"), of("short"), of("long"), of("flat"))


def trip_mechanics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median days to expiry at entry and exit and days held of closed trades, by side and reason."""
    trades, _, ends = life._all(spark, sf_dir)
    rows = ends.select("entry", "side", "reason", "exit_day").join(trades.select("entry", "day0", "expiry"), "entry")
    middle = lambda x, y, n: F.round(F.expr(f"percentile(datediff({x}, {y}), 0.5)"), 2).alias(n)  # noqa: E731 - whole days: few distinct values
    return rows.groupBy("side", "reason").agg(F.count(F.lit(1)).alias("n"), middle("expiry", "day0", "entry_dte"), middle("expiry", "exit_day", "exit_dte"), middle("exit_day", "day0", "held"))


def pick_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades and their net profit by the delta picked for their day of entry (0.25 without a pick)."""
    trades, _, ends = life._all(spark, sf_dir)
    rows = ends.select("entry", "pnl_net").join(trades.select("entry", F.col("day0").alias("day")), "entry").join(derived(spark, sf_dir, a.PICKS), "day", "left")
    return rows.groupBy(F.round(F.coalesce("pick", F.lit(0.25)), 4).alias("delta")).agg(F.count(F.lit(1)).alias("trips"), F.round(F.sum("pnl_net"), 2).alias("net"))


def entry_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each closed trade with volatility and delta of its contract in the chain of its hour of entry, and its net profit."""
    trades, _, ends = life._all(spark, sf_dir)
    at = trades.select("entry", F.col("day0").alias("day"), F.hour("ts0").alias("hour"), (7 + 2 * F.datediff("expiry", F.lit("2024-01-12").cast("date"))).alias("dte"), "strike", "call")
    chain = derived(spark, sf_dir, a.CHAIN)
    rows = periods.at_entry(at, chain, ["day", "hour", "dte", "strike", "call"], ["iv", "delta"]).join(ends.select("entry", "pnl_net"), "entry")
    return rows.select("entry", F.round("iv", 6).alias("iv"), F.round("delta", 6).alias("delta"), F.round("pnl_net", 3).alias("per"))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and bias of the two forecasts with the index of their day."""
    vix = research._features(spark, sf_dir).select("symbol", "date", "vix")
    rows = research._scored(spark, sf_dir).join(vix, ["symbol", "date"])
    return rows.select("name", "date", "vix", forecasts.qlike(F.col("target"), F.col("forecast")).alias("loss"), (100 * (F.col("forecast") - F.col("target"))).alias("bias"))


def _forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.forecast_scores(periods.in_periods(_forecasts(spark, sf_dir), PERIODS, "date"), F.col("vix") < CALM)


def forecast_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast_scores(spark, sf_dir).select("name", "period", "days", "calm_days", *[F.round(c, 5).alias(c) for c in ("loss", "bias", "calm_bias")])


def calm_bias_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss, and median bias on calm days, by forecast and year."""
    rows = _forecasts(spark, sf_dir).withColumn("period", F.year("date"))
    return periods.forecast_scores(rows, F.col("vix") < CALM).select("name", F.col("period").alias("year"), "days", "calm_days", F.round("loss", 5).alias("loss"), F.round("calm_bias", 5).alias("calm_bias"))


def forecast_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against trailing variance: a lower loss and a smaller calm bias in each half, of enough calm days."""
    table = _forecast_scores(spark, sf_dir).where("period != 'all'").withColumn("one", F.lit(1))
    bars = [(m, r, 0.0, p) for p in ("early", "late") for m, r in (("loss", "lower"), ("calm_bias", "less_severe"))]
    rules = {**scorecards.RULES, "lower": lambda v, ref, x: v < ref}
    calm = table.groupBy("name").agg(F.min("calm_days").alias("n"))
    return periods.verdicts(periods.period_checks(table, ["one"], "name", "trailing", bars, rules), ["name"], calm, LEAST_CALM)


def harx_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean squared return of the next 22 days on variances of a day, a week and a month, the index's variance and the week's return, by symbol."""
    rows = features.trend_measures(research._features(spark, sf_dir)).select("symbol", "date", F.col("ret5").alias("ret_w"))
    days = research._features(spark, sf_dir).select("symbol", "date", "rv_d", "rv_w", "rv_m", (F.pow(F.col("vix") / 100, 2) / 252 * 1e4).alias("vix_var"))
    ahead = features.forward_target(derived(spark, sf_dir, a.BARS), 22).select("symbol", "date", (F.pow("target", F.lit(2)) / 252 * 1e4).alias("ahead"))
    fit = forecasts.ols(days.join(rows, ["symbol", "date"]).join(ahead, ["symbol", "date"]), ["symbol"], "ahead", HARX)
    return fit.select("symbol", "n", F.round("intercept", 4).alias("intercept"), *[F.round(f"b_{x}", 4).alias(f"b_{x}") for x in HARX])


def pick_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.pick_books(derived(spark, sf_dir, a.LABELS).join(derived(spark, sf_dir, a.CANDIDATES).select("day", "name", "score"), ["day", "name"]), "day", "score", "name", 250.0).withColumn("mean", F.round("mean", 4))


def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.missing_months(derived(spark, sf_dir, a.RUNS), ["name", "config"], "ran")


def calendar_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.calendar_prices(market._chain(spark, sf_dir), ["day", "hour"])
    return out.select("day", "hour", "strike", "call", "near", "far", F.round("net", 6).alias("net"), F.round("closing", 6).alias("closing"))


def session_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tradable quotes of the New York session, of hours that enough implied volatilities cover."""
    chain = market._chain(spark, sf_dir).join(derived(spark, sf_dir, a.OPTIONS).select("event_id", "ts"), "event_id")
    rows = periods.in_session(chains.tradable(chains.covered(chain, market.SNAP)), clock.eastern(F.col("ts")), 9 * 60 + 30, 16 * 60)
    return rows.select("event_id", F.round("mid", 6).alias("mid"))


def published_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known columns of the chain as JSON lines, rounded and with nulls for what is not finite, read back."""
    rows = market._chain(spark, sf_dir).withColumn("ratio", F.try_divide(F.col("ask"), F.col("bid")))
    return store.publish(rows, ["event_id", "day", "iv", "delta", "mid", "ratio"], store.fresh(spark, "published"))


def week_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a week brought: runs, cards with a verdict, trips opened and closed, and the change in each book's profit."""
    trips = derived(spark, sf_dir, a.TRIPS)
    judged = catalogue.card_fields(derived(spark, sf_dir, a.CARDS), "card").where("stage = 'judged'").withColumn("on", F.make_date(F.lit(1998), F.lit(7), F.month("started") + 22))
    counts = [periods.activity(t, k, d, WEEK_END) for t, k, d in ((derived(spark, sf_dir, a.RUNS), "runs", "ran"), (judged, "judged", "on"), (trips, "opened", "entry"), (trips, "closed", "exit"))]
    end = F.to_date(F.lit(WEEK_END))
    week = reports.daily(trips).where((F.col("date") > F.date_sub(end, 7)) & (F.col("date") <= end))
    out = week.groupBy(F.concat(F.lit("change "), "book").alias("kind")).agg(F.round(F.sum("pnl"), 3).alias("n"))
    for c in counts:
        out = out.union(c)
    return out


QUERIES = {f.__name__: f for f in (variant_periods, period_bars, period_verdicts, tail_dates, crash_windows, fee_periods, weekday_trips, signal_years, trip_mechanics, pick_entries, entry_quotes, forecast_periods, calm_bias_years, forecast_verdicts, harx_fit, pick_books, missing_months, calendar_prices, session_quotes, published_chain, week_activity)}


def elimination(xs: list[str], name: str = "m", where: str = "date < date '1996-12-01'") -> str:
    """CTE {name}_f of intercept and coefficients by symbol: least squares of y in x by elimination on covariances, a step a regressor."""
    names = [*xs, "y"]
    cov = ", ".join(f"covar_pop({p}, {q}) as m_{p}_{q}" for p in xs for q in names)
    steps, last = [], f"{name}0"
    for k, p in enumerate(xs):
        cells = ", ".join(f"m_{i}_{j}" if i == p else f"m_{i}_{j} - m_{i}_{p} * m_{p}_{j} / m_{p}_{p} as m_{i}_{j}" for i in xs for j in names)
        steps.append(f"{name}{k + 1} as (select symbol, n, {', '.join(f'a_{x}' for x in names)}, {cells} from {last})")
        last = f"{name}{k + 1}"
    b = {x: f"m_{x}_y / m_{x}_{x}" for x in xs}
    known = " and ".join(f"{x} is not null" for x in names)
    return f"""{name}0 as (select symbol, count(*) as n, {', '.join(f'avg({x}) as a_{x}' for x in names)}, {cov} from x where {known} and {where} group by 1), {', '.join(steps)},
{name}_f as (select symbol, n, a_y - {' - '.join(f'{b[x]} * a_{x}' for x in xs)} as intercept, {', '.join(f'{b[x]} as b_{x}' for x in xs)} from {last})"""


def _harx() -> str:
    return f"{elimination(HARX, where='true')} select symbol, n, round(intercept, 4) as intercept, {', '.join(f'round(b_{x}, 4) as b_{x}' for x in HARX)} from m_f"


def oracles(daily: str, target: str, signal: str, trend: str) -> dict[str, str]:
    """SQL of the queries above, on the SQL of daily features, forward targets, daily signals and trends."""
    trips = f"t as (select *, pnl - commission as net, commission / 0.65 as units from ({a.TRIPS}) q)"
    spans = lambda ps: ", ".join(f"('{n}', date '{lo or '0001-01-01'}', date '{hi or '9999-12-31'}')" for n, lo, hi in ps)
    span = f"sp(period, lo, hi) as (values {spans(PERIODS)})"
    table = ", ".join(f"('{n}', {m}::double, {over.get('stop', scores.BASE['stop'])}::double, {over.get('cost', scores.BASE['cost'])}::double)" for n, over in scores.VARIANTS.items() for m in scores.MULTIPLES)
    wide = f"""{span}, v as (select b.book, w.variant, w.multiple, b.reason, b.exit, greatest(b.pnl, -w.stop) - b.commission * w.cost * w.multiple as net, b.commission * w.cost * w.multiple as commission from ({a.TRIPS}) b cross join (values {table}) w(variant, multiple, stop, cost)),
g as (select book, variant, multiple, period, count(*) as trips, sum(net) as pnl, sum(commission) as commission, stddev_samp(net) as deviation, min(net) as worst, avg((net > 0)::int) as win_rate from v join sp on exit >= lo and exit < hi group by 1, 2, 3, 4)"""
    rules = {"higher": "x.{0} > r.{0}", "not_below": "x.{0} >= r.{0} - {1}", "at_most": "x.{0} <= {1}"}
    bars = " union all ".join(f"select x.book, x.multiple, x.variant, x.period, '{m}' as metric, '{r}' as rule, {rules[r].format(m, b)} as ok from g x join g r on r.book = x.book and r.multiple = x.multiple and r.period = x.period and r.variant = 'plain' where x.variant != 'plain' and x.period = '{p}'" for m, r, b, p in BARS)
    days = f"f as ({daily}), k as ({target}), s0 as (select symbol, date, vix, target, 'trailing' as name, sqrt(rv_m * 252 / 1e4) as forecast from f join k using (symbol, date) union all select symbol, date, vix, target, 'index', vix / 100 from f join k using (symbol, date)), s as (select *, pow(target / forecast, 2) - ln(pow(target / forecast, 2)) - 1 as loss, 100 * (forecast - target) as bias from s0 where target > 0 and forecast > 0)"
    scored = f"{span}, {days}, h as (select name, period, count(*) as days, count(*) filter (where vix < {CALM}) as calm_days, avg(loss) as loss, quantile_cont(bias, 0.5) as bias, quantile_cont(bias, 0.5) filter (where vix < {CALM}) as calm_bias from s join sp on date >= lo and date < hi group by 1, 2)"
    c = f"with {life._ctes()}"
    week = f"> date '{WEEK_END}' - 7"
    upto = f"<= date '{WEEK_END}'"
    return {
        "variant_periods": f"with {wide} select book, variant, multiple, period, trips, round(pnl, 3) as pnl, round(commission, 3) as commission, round(deviation, 3) as deviation, round(worst, 3) as worst, round(win_rate, 6) as win_rate from g",
        "period_bars": f"with {wide} {bars}",
        "period_verdicts": f"""with {wide}, c as ({bars}), e as (select book, variant, count(*) filter (where multiple = 1 and reason = 'stop') as n from v group by 1, 2), o as (select book, variant, bool_and(ok) as ok from c group by 1, 2)
select book, variant, n, case when n < {LEAST_STOPS} then 'inconclusive' when ok then 'passed' else 'failed' end as verdict from o join e using (book, variant)""",
        "tail_dates": f"""with {trips}, d as (select book, exit as date, sum(net) as pnl from t group by all), e as (select *, sum(pnl) over (partition by book order by date) as total from d), u as (select *, greatest(max(total) over (partition by book order by date), 0) - total as down from e),
q as (select book, quantile_cont(pnl, 0.05) as q5 from d group by 1), w as (select book, date as trough from u qualify row_number() over (partition by book order by down desc, date) = 1)
select book, trough, round(any_value(q5), 3) as q5, round(avg(pnl) filter (where pnl <= q5), 3) as shortfall, round(any_value(most), 3)::double as most from d join q using (book) join w using (book) join (select book, max(units) as most from t group by 1) m using (book) group by 1, 2""",
        "crash_windows": f"""with {trips}, sp(period, lo, hi) as (values {spans(CRASHES)}), o as (select book, period, count(*) as entries, sum(units) as units, max(units) as most, sum(net) as net from t join sp on entry >= lo and entry < hi group by 1, 2), b as (select book, period, sum(net) as daily from t join sp on exit >= lo and exit < hi group by 1, 2)
select book, period, coalesce(entries, 0) as entries, round(coalesce(units, 0), 3)::double as units, round(coalesce(most, 0), 3)::double as most, round(coalesce(net, 0), 3)::double as net, round(coalesce(daily, 0), 3)::double as daily from o full join b using (book, period)""",
        "fee_periods": f"""with {trips}, {span} select book, period, count(*) as orders, round(avg((units < {SMALL})::int), 6) as under, sum(round(greatest(units * 0.005, 1), 4)::decimal(20, 4))::double as fixed, sum(round(greatest(units * 0.0035, 0.35) + units * 0.001, 4)::decimal(20, 4))::double as tiered from t join sp on entry >= lo and entry < hi group by 1, 2""",
        "weekday_trips": f"with {trips} select book, (isodow(entry) - 1)::int as weekday, count(*) as trips, round(avg(net), 4) as per_trip from t group by 1, 2",
        "signal_years": f"with s as ({signal}) select symbol, year(date)::int as year, count(*) as days, count(*) filter (where signal = 'short') as short, count(*) filter (where signal = 'long') as long, count(*) filter (where signal = 'flat') as flat from s group by 1, 2",
        "trip_mechanics": f"""{c} select cl.side, cl.reason, count(*) as n, round(quantile_cont(expiry - day0, 0.5), 2)::double as entry_dte, round(quantile_cont(expiry - exit_day, 0.5), 2)::double as exit_dte, round(quantile_cont(exit_day - day0, 0.5), 2)::double as held from cl join en using (entry) group by 1, 2""",
        "pick_entries": f"{c} select round(coalesce(case when day(day0) % 3 > 0 then day(day0) % 4 * 0.1 end, 0.25), 4)::double as delta, count(*) as trips, round(sum(pnl_net), 2) as net from cl join en using (entry) group by 1",
        "entry_quotes": f"""{c}, ch as (select * from ({a.CHAIN}) q qualify row_number() over (partition by day, hour, dte, strike, call order by event_id desc) = 1)
select cl.entry, round(iv, 6) as iv, round(ch.delta, 6) as delta, round(pnl_net, 3) as per from cl join en using (entry) left join ch on ch.day = en.day0 and ch.hour = hour(en.ts0) and ch.dte = 7 + 2 * (en.expiry - date '2024-01-12') and ch.strike = en.strike and ch.call = en.call""",
        "forecast_periods": f"with {scored} select name, period, days, calm_days, round(loss, 5) as loss, round(bias, 5) as bias, round(calm_bias, 5) as calm_bias from h",
        "calm_bias_years": f"with {days} select name, year(date)::int as year, count(*) as days, count(*) filter (where vix < {CALM}) as calm_days, round(avg(loss), 5) as loss, round(quantile_cont(bias, 0.5) filter (where vix < {CALM}), 5) as calm_bias from s group by 1, 2",
        "forecast_verdicts": f"""with {scored}, j as (select x.period, x.calm_days, coalesce(x.loss < r.loss and abs(x.calm_bias) < abs(r.calm_bias), false) as ok from h x join h r using (period) where x.name = 'index' and r.name = 'trailing' and period <> 'all')
select 'index' as name, min(calm_days) as n, case when min(calm_days) < {LEAST_CALM} then 'inconclusive' when bool_and(ok) then 'passed' else 'failed' end as verdict from j""",
        "harx_fit": f"""with f as ({daily}), tr as ({trend}), k as ({target}), x as (select f.symbol, rv_d, rv_w, rv_m, pow(vix / 100, 2) / 252 * 1e4 as vix_var, ret5 as ret_w, pow(target, 2) / 252 * 1e4 as y from f join tr using (symbol, date) join k using (symbol, date)), {_harx()}""",
        "pick_books": f"""with c as (select l.day, l.name, l.label, q.score from ({a.LABELS}) l join ({a.CANDIDATES}) q on q.day = l.day and q.name = l.name), p as (select *, row_number() over (partition by day order by score desc, name) as i, row_number() over (partition by day order by abs(score - 250), name) as j from c),
d as (select day, max(label) filter (where i = 1) as picked, max(label) filter (where j = 1) as fixed, max(label) as hindsight from p group by 1), u as (select day, 'picked' as book, picked as v from d union all select day, 'fixed', fixed from d union all select day, 'hindsight', hindsight from d)
select book, year(day)::int as year, round(avg(coalesce(v, 0)), 4) as mean, count(*) as n from u group by 1, 2""",
        "missing_months": f"""with r as (select distinct name, config, date_trunc('month', ran)::date as month from ({a.RUNS}) q), m as (select unnest(range(min(month)::timestamp, max(month)::timestamp + interval 1 day, interval 1 month))::date as month from r), k as (select distinct name, config from r)
select name, config, month from k cross join m except select name, config, month from r""",
        "calendar_prices": f"""with {market._CLEAN}, e as (select day, hour, min(dte) as near, max(dte) as far from c group by 1, 2 having min(dte) < max(dte)), l as (select c.* from c where mid is not null qualify row_number() over (partition by day, hour, dte, strike, call order by event_id desc) = 1)
select e.day, e.hour::int as hour, n.strike, n.call, e.near, e.far, round(n.mid - f.mid, 6) as net, round(f.mid - n.mid, 6) as closing from e join l n on n.day = e.day and n.hour = e.hour and n.dte = e.near join l f on f.day = e.day and f.hour = e.hour and f.dte = e.far and f.strike = n.strike and f.call = n.call""",
        "session_quotes": f"""with {market._CLEAN}, g as (select day, hour from c group by all having avg((iv is not null)::int) >= 0.5), o as (select event_id, ts - interval 5 hour as wall from ({a.OPTIONS}) q)
select event_id, round(mid, 6) as mid from c join g using (day, hour) join o using (event_id) where bid > 0 and ask > bid and delta is not null and hour(wall) * 60 + minute(wall) between 570 and 960""",
        "published_chain": f"with {market._CLEAN} select event_id, day::varchar as day, round(iv, 4) as iv, round(delta, 4) as delta, round(mid, 4) as mid, round(ask / bid, 4) as ratio from c",
        "week_activity": f"""with {trips}, k as (select make_date(1998, 7, 23 + doc_id % 9) as dt from documents where doc_id % 3 <> 1 and doc_id % 4 > 0)
select 'runs' as kind, count(*)::double as n from ({a.RUNS}) r where ran {week} and ran {upto} union all select 'judged', count(*)::double from k where dt {week} and dt {upto} union all select 'opened', count(*)::double from t where entry {week} and entry {upto}
union all select 'closed', count(*)::double from t where exit {week} and exit {upto} union all select 'change ' || book, round(sum(net), 3)::double from t where exit {week} and exit {upto} group by book""",
    }
