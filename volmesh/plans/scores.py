"""Queries for scorecards of books, gates and forecasts, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import books, features, reports, scorecards
from ..operators.reports import net
from ..operators.quantiles import quantiles
from ..sources import adapters as a
from ..sources.adapters import derived
from . import research

BASE = {"stop": 1e9, "cost": 1.0}
VARIANTS = {"plain": {}, "tight": {"stop": 2000.0}, "cheap": {"cost": 0.5}}
MULTIPLES = [1.0, 2.0]
#: What no variant may override.
PINNED = ("start", "end", "holdout_start")
BARS = [("pnl", "higher", 0.0), ("deviation", "less_severe", 0.0), ("worst", "not_below", 100.0), ("pnl", "within", 0.5), ("trips", "above", 100.0), ("deviation", "at_most", 4000.0)]
TIERS = [(0.0, 0.05), (50.0, 0.03), (100.0, 0.02)]


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, a.TRIPS)


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scorecards.variants(_trips(spark, sf_dir), BASE, VARIANTS, MULTIPLES, PINNED)
    return rows.withColumns({"pnl": F.greatest(F.col("pnl"), -F.col("stop")), "commission": F.col("commission") * F.col("cost") * F.col("multiple")})


def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.book_metrics(_variants(spark, sf_dir).withColumn("book", F.concat_ws("|", "book", "variant", F.col("multiple").cast("int"))))


def pass_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _variants(spark, sf_dir).groupBy("book", "multiple", "variant").agg(F.sum(net()).alias("pnl"), F.stddev_samp(net()).alias("deviation"), F.min(net()).alias("worst"), F.count(F.lit(1)).alias("trips"))
    return scorecards.checks(table, ["book", "multiple"], "variant", "plain", BARS)


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecards.exposure(_trips(spark, sf_dir))


def fee_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.col("commission") / 0.65
    plans = {"flat": F.greatest(units * 0.035, F.lit(1.0)), "tiered": scorecards.tiered(units, TIERS, 0.001, 0.35)}
    rows = _trips(spark, sf_dir).select("book", units.alias("units"), F.explode(F.array(*[F.struct(F.lit(n).alias("plan"), p.alias("fee")) for n, p in plans.items()])).alias("_p"))
    middle = quantiles(_trips(spark, sf_dir).withColumn("units", units), ["book"], "units", [0.5])
    return rows.groupBy("book", F.col("_p.plan").alias("plan")).agg(F.round(F.sum("_p.fee"), 3).alias("fees")).join(middle, "book").select("book", "plan", "fees", F.round("q0", 3).alias("median_units"))


def entry_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecards.weekdays(_trips(spark, sf_dir)).withColumnsRenamed({str(i): f"d{i}" for i in range(7)})


def yearly_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net profit by book and year, reasons as columns."""
    wide = _trips(spark, sf_dir).groupBy("book", F.year("exit").alias("year")).pivot("reason", ["flat", "profit", "stop", "time"]).agg(F.sum(net())).na.fill(0.0)
    return wide.select("book", "year", *[F.round(c, 4).alias(c) for c in ("flat", "profit", "stop", "time")])


def entry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trip with the signal and index rank of its day of entry."""
    days = research._features(spark, sf_dir).select(F.col("symbol").alias("book"), F.col("date").alias("entry"), "vix", "vix_pct")
    signal = research.daily_signal(spark, sf_dir).select(F.col("symbol").alias("book"), F.col("date").alias("entry"), "signal")
    return _trips(spark, sf_dir).select("trade", "book", "entry").join(days.join(signal, ["book", "entry"]), ["book", "entry"], "left").select("trade", "signal", "vix", "vix_pct")


def gate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips by whether the day before their entry had an inverted term structure."""
    days = research._features(spark, sf_dir).select(F.col("symbol").alias("book"), F.col("date").alias("entry"), F.lag("term").over(Window.partitionBy("symbol").orderBy("date")).alias("_t"))
    rows = _trips(spark, sf_dir).join(days, ["book", "entry"], "left").withColumn("gated", F.coalesce(F.col("_t") > 1, F.lit(False)))
    return rows.groupBy("book", "side", "gated").agg(F.count(F.lit(1)).alias("trips"), F.round(F.sum(net()), 4).alias("net"))


def yearly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scorecards.rates(_trips(spark, sf_dir))
    return rows.select("book", *[F.round(c, 3).alias(c) for c in rows.columns[1:]])


def profit_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecards.volatility(_trips(spark, sf_dir)).withColumn("deviation", F.round("deviation", 3))


def share_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = derived(spark, sf_dir, a.MARKS).select("call", "day", "ts", "event_id", F.bround(50 * F.col("delta")).alias("shares"), F.col("fwd").alias("spot"), (F.col("event_id") % 4 > 0).alias("held"), F.lit(0.005).alias("each"))
    return scorecards.share_attribution(marks, ["call", "day"]).select("call", "day", *[F.round(c, 4).alias(c) for c in ("held", "flat", "cost")])


def tail_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = reports.daily(_trips(spark, sf_dir)).withColumn("_late", F.dayofmonth("date") > 20)
    rows = scorecards.tail_split(days, ["book"], "pnl", "_late", 0.05)
    return rows.select("book", "live", "n", "bad", *[F.round(c, 4).alias(c) for c in ("tail", "worst", "total")])


def signal_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the index fell the day after a short and rose after a long, by symbol and year."""
    days = research._features(spark, sf_dir).select("symbol", "date", (F.lead("vix").over(Window.partitionBy("symbol").orderBy("date")) - F.col("vix")).alias("move"))
    rows = research.daily_signal(spark, sf_dir).join(days, ["symbol", "date"]).withColumn("year", F.year("date"))
    return scorecards.directions(rows, ["symbol", "year"], "signal", "move").select("symbol", "year", "n", *[F.round(c, 6).alias(c) for c in ("flat", "short_right", "long_right")])


def bias_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median bias of the index as a forecast by band of the index (right-closed)."""
    rows = research._features(spark, sf_dir).join(features.forward_target(derived(spark, sf_dir, a.BARS), 22), ["symbol", "date"]).where("target is not null and vix is not null")
    band = F.when(F.col("vix") <= 18, "to 18").when(F.col("vix") <= 20, "to 20").when(F.col("vix") <= 22, "to 22").otherwise("over")
    return rows.groupBy("symbol", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile(vix - 100 * target, 0.5)"), 4).alias("bias"))


def bad_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a false high or low: their range and the move of the close."""
    bars = derived(spark, sf_dir, a.BARS).select("symbol", "date", F.log(F.col("high") / F.col("low")).alias("range"))
    return research._features(spark, sf_dir).where("bad").join(bars, ["symbol", "date"]).select("symbol", "date", F.round("range", 6).alias("range"), "ret")


def pick_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade 0 to 4 of each candidate by the bounds 10, 40, 60 and 90 per cent of the labels of the year before; a value on a bound has the lower grade."""
    rows = derived(spark, sf_dir, a.CANDIDATES).withColumn("year", F.year("day"))
    bounds = quantiles(rows.withColumn("year", F.col("year") + 1), ["year"], "label", [0.1, 0.4, 0.6, 0.9])
    above = sum(((F.col(f"q{i}") < F.col("label")).cast("int") for i in range(4)), F.lit(0))
    return rows.join(bounds, "year").select("name", above.alias("grade"))


QUERIES = {f.__name__: f for f in (variant_metrics, pass_bars, exposure, fee_plans, entry_weekdays, yearly_reasons, entry_state, gate_split, yearly_rates, profit_volatility, share_attribution, tail_gate, signal_directions, bias_bands, bad_ranges, pick_grades)}


def oracles(metrics: str, daily: str, target: str, signal: str) -> dict[str, str]:
    """SQL of the queries above, on the SQL of book metrics, daily features, forward targets and daily signals."""
    trips = f"t as ({a.TRIPS})"
    table = ", ".join(f"('{n}', {m}::double, {over.get('stop', BASE['stop'])}::double, {over.get('cost', BASE['cost'])}::double)" for n, over in VARIANTS.items() for m in MULTIPLES)
    variants = f"select b.book, v.variant, v.multiple, b.side, b.entry, b.exit, greatest(b.pnl, -v.stop) as pnl, b.commission * v.cost * v.multiple as commission from ({a.TRIPS}) b cross join (values {table}) v(variant, multiple, stop, cost)"
    one = f"select * replace (book || '|' || variant || '|' || multiple::int as book) from ({variants}) w"
    rules = {"higher": "x.{0} > r.{0}", "less_severe": "abs(x.{0}) < abs(r.{0})", "within": "abs(x.{0} - r.{0}) <= {1} * abs(r.{0})", "not_below": "x.{0} >= r.{0} - {1}", "above": "x.{0} > {1}", "at_most": "x.{0} <= {1}"}
    bars = " union all ".join(f"select x.book, x.multiple, x.variant, '{m}' as metric, '{r}' as rule, {rules[r].format(m, b)} as ok from g x join g r on r.book = x.book and r.multiple = x.multiple and r.variant = 'plain' where x.variant != 'plain'" for m, r, b in BARS)
    return {
        "variant_metrics": metrics.replace(a.TRIPS, one),
        "pass_bars": f"""with g as (select book, multiple, variant, sum(pnl - commission) as pnl, stddev_samp(pnl - commission) as deviation, min(pnl - commission) as worst, count(*) as trips from ({variants}) v group by 1, 2, 3), c as ({bars})
select *, bool_and(ok) over (partition by book, multiple, variant) as verdict from c""",
        "exposure": f"""with {trips}, s as (select unnest(range(min(entry)::timestamp, max(exit)::timestamp + interval 1 day, interval 1 day))::date as date from t), y as (select year(date)::int as year, count(*) as days from s where isodow(date) < 6 group by 1),
h as (select distinct book, date from s join t on t.entry <= s.date and t.exit >= s.date where isodow(date) < 6), k as (select book, year(date)::int as year, count(*) as held from h group by 1, 2) select book, year, held, days, round(held / days, 6) as share from k join y using (year)""",
        "fee_plans": f"""with {trips}, u as (select book, commission / 0.65 as q from t), p as (select book, q, 'flat' as plan, greatest(q * 0.035, 1) as fee from u
union all select book, q, 'tiered', greatest(case when q <= 50 then q * 0.05 when q <= 100 then 2.5 + (q - 50) * 0.03 else 4 + (q - 100) * 0.02 end + q * 0.001, 0.35) from u) select book, plan, round(sum(fee), 3) as fees, round(quantile_cont(q, 0.5), 3) as median_units from p group by 1, 2""",
        "entry_weekdays": f"with {trips} select book, " + ", ".join(f"count(*) filter (where isodow(entry) = {i + 1}) as d{i}" for i in range(7)) + " from t group by 1",
        "yearly_reasons": f"with {trips} select book, year(exit)::int as year, " + ", ".join(f"round(coalesce(sum(pnl - commission) filter (where reason = '{r}'), 0), 4) as {r}" for r in ("flat", "profit", "stop", "time")) + " from t group by 1, 2",
        "entry_state": f"with {trips}, f as ({daily}), s as ({signal}) select trade, signal, vix, vix_pct from t left join f on f.symbol = t.book and f.date = t.entry left join s on s.symbol = t.book and s.date = t.entry",
        "gate_split": f"""with {trips}, f as ({daily}), g as (select symbol, date, lag(term) over (partition by symbol order by date) as prior from f)
select book, side, coalesce(prior > 1, false) as gated, count(*) as trips, round(sum(pnl - commission), 4) as net from t left join g on g.symbol = t.book and g.date = t.entry group by 1, 2, 3""",
        "yearly_rates": f"""with {trips}, s as (select book, min(entry) as a, max(exit) as b, count(*) as n, sum(pnl - commission) as p, (max(exit) - min(entry)) / 365.25 as years from t group by 1),
l as (select t.book, count(*) as n, sum(pnl - commission) as p, count(distinct exit) as d from t join s using (book) where s.b - t.exit < 90 group by 1)
select s.book, round(years, 3)::double as years, round(s.n / years, 3) as trips_year, round(s.p / years, 3) as pnl_year, round(s.p / s.n, 3) as per_trade, round(l.n * 252 / l.d, 3) as live_trips, round(l.p * 252 / l.d, 3) as live_pnl from s join l using (book)""",
        "profit_volatility": f"""with {trips}, d as (select book, exit as date, sum(pnl - commission) as pnl from t group by all), y as (select *, year(date)::int as year from d)
select book, year, count(*) as days, round(stddev_samp(pnl), 3) as deviation from y group by grouping sets ((book, year), (book))""",
        "share_attribution": f"""with m as (select call, day, ts, fwd, round_even(50 * delta, 0) as shares, event_id % 4 > 0 as held from ({a.MARKS}) q), l as (select *, lag(shares) over w * (fwd - lag(fwd) over w) as gain, lag(held) over w as was, abs(shares - lag(shares, 1, 0) over w) * 0.005 as cost from m window w as (partition by call, day order by ts))
select call, day, round(coalesce(sum(gain) filter (where was), 0), 4) as held, round(coalesce(sum(gain) filter (where not was), 0), 4) as flat, round(sum(cost), 4) as cost from l group by 1, 2""",
        "tail_gate": f"""with {trips}, d as (select book, exit as date, sum(pnl - commission) as pnl from t group by all), b as (select *, 'all' as live from d union all select *, 'gated' from d where day(date) <= 20),
r as (select *, row_number() over (partition by book, live order by pnl, date) as r, count(*) over (partition by book, live) as k, stddev_samp(pnl) over (partition by book, live) as s from b)
select book, live, count(*) as n, count(*) filter (where pnl < -s) as bad, round(avg(pnl) filter (where r <= ceil(k * 0.05)), 4) as tail, round(min(pnl), 4) as worst, round(sum(pnl), 4) as total from r group by 1, 2""",
        "signal_directions": f"""with f as ({daily}), s as ({signal}), m as (select symbol, date, lead(vix) over (partition by symbol order by date) - vix as move from f), j as (select * from s join m using (symbol, date) where move is not null and signal is not null)
select symbol, year(date)::int as year, count(*) as n, round(avg((signal = 'flat')::int), 6) as flat, round(avg((move < 0)::int) filter (where signal = 'short'), 6) as short_right, round(avg((move > 0)::int) filter (where signal = 'long'), 6) as long_right from j group by 1, 2""",
        "bias_bands": f"""with f as ({daily}), g as ({target}), j as (select * from f join g using (symbol, date) where target is not null and vix is not null)
select symbol, case when vix <= 18 then 'to 18' when vix <= 20 then 'to 20' when vix <= 22 then 'to 22' else 'over' end as band, count(*) as n, round(quantile_cont(vix - 100 * target, 0.5), 4) as bias from j group by 1, 2""",
        "bad_ranges": f"with f as ({daily}) select f.symbol, f.date, round(ln(high / low), 6) as range, ret from f join ({a.BARS}) b on b.symbol = f.symbol and b.date = f.date where bad",
        "pick_grades": f"""with c as (select *, year(day) as year from ({a.CANDIDATES}) q), b as (select year + 1 as year, quantile_cont(label, 0.1) as b1, quantile_cont(label, 0.4) as b2, quantile_cont(label, 0.6) as b3, quantile_cont(label, 0.9) as b4 from c group by 1)
select name, ((label > b1)::int + (label > b2)::int + (label > b3)::int + (label > b4)::int)::int as grade from c join b using (year)""",
    }
