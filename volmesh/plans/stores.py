"""Queries over stored tables, calendars, universes and checks of a build; and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import asof, catalogue, filters, forwards as fw, paths, surface
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived
from . import forwards, options


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints as snapshots by day and half hour, written and read again."""
    wall = clock.eastern(F.col("ts"))
    rows = forwards.tape(spark, sf_dir).withColumn("hhmm", F.hour(wall) * 100 + F.floor(F.minute(wall) / 30).cast("int") * 30)
    folder = store.fresh(spark, "snapshots")
    store.save_snapshots(rows.select("event_id", "price", "day", "hhmm"), folder)
    return spark.read.parquet(folder)


def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the time of each event, the latest snapshot at or before it, else the latest of all."""
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return store.as_of(asked, _snapshots(spark, sf_dir), "ts").select("event_id", F.col("day").alias("snap_day"), "hhmm", "n")


def grid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.at_time(_snapshots(spark, sf_dir), 1000).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 3).alias("total"))


def union_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshot tables, of which one lacks the conditions, read as one."""
    rows, one, two = forwards.tape(spark, sf_dir), store.fresh(spark, "old"), store.fresh(spark, "new")
    rows.where("not call").select("event_id", "day", "price").write.parquet(one)
    rows.where("call").select("event_id", "day", "price", "condition").write.parquet(two)
    return store.snapshots(spark, [one, two]).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count("condition").alias("known"), F.round(F.sum("price"), 3).alias("total"))


def open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the tape on which the close has no forward yet."""
    return store.open_days(forwards.tape(spark, sf_dir).select("day").distinct(), forwards.parity_close(spark, sf_dir))


def symbol_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derived(spark, sf_dir, a.BARS)
    return store.extract(bars, F.col("symbol") == "1-URGENT", ["date", "close"], ["date"], store.fresh(spark, "extract")).withColumn("close", F.round("close", 4))


def raw_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of each raw source."""
    out = None
    for name, df in store.bundle(spark, sf_dir, ["orders", "lineitem", "events", "part"]).items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.union(one)
    return out


def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log to which two writers with different columns append."""
    trips, folder = derived(spark, sf_dir, a.TRIPS), store.fresh(spark, "log")
    store.append(trips.where("side = 'long'").select("trade", "book"), folder)
    store.append(trips.where("side = 'short'").select("trade", "book", "reason"), folder)
    return store.read_log(spark, folder).groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("with_reason"))


def registry_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial registry as CSV, read with its numbers."""
    runs = derived(spark, sf_dir, a.RUNS).withColumn("run", F.concat(F.lit("out/"), F.col("name"), F.lit("/"), F.col("run")))
    folder = store.fresh(spark, "registry")
    known = runs.select("name", "run", F.col("multiple").cast("double").alias("multiple"), "pnl")
    bare = derived(spark, sf_dir, a.CARDS).select(F.concat(F.lit("card-"), F.col("doc_id") % 50).alias("card"), F.col("doc_id").cast("string").alias("run"))
    catalogue.export(known, bare, folder)
    got = catalogue.load_registry(spark, folder)
    return got.groupBy("card", "variant").agg(F.count(F.lit(1)).alias("n"), F.count("pnl").alias("numbers"), F.round(F.sum("pnl"), 2).alias("pnl"), F.max("run").alias("last_run"))


def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.trading_days(derived(spark, sf_dir, a.BARS).select(F.col("date").alias("day")), forwards.tape(spark, sf_dir))


def rate_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rate strictly before each bar's day: as-of over distinct days (a row a day), then by equal day."""
    rates = derived(spark, sf_dir, a.INDEX_GAPS).where("irx is not null").select(F.lit(1).alias("k"), "date", "irx")
    bars = derived(spark, sf_dir, a.BARS).select("symbol", "date")
    known = asof.asof_join(bars.select(F.lit(1).alias("k"), "date").distinct(), rates, "date", ["k"], "irx", "rate", strict=True)
    return bars.join(known, "date").select("symbol", "date", F.round("rate", 6).alias("rate"))


def weekday_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.on_weekdays(derived(spark, sf_dir, a.TRIPS), "entry", [0, 2, 4]).groupBy("book").agg(F.count(F.lit(1)).alias("n"))


def _day_spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fw.near_forward(store.settle(forwards._pairs(spark, sf_dir)), ["day"], forwards.NEED)
    return near.groupBy("day", "near").agg(F.max_by("fnear", F.struct("ts", "call", "event_id")).alias("spot"))


def live_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = forwards.clean_contracts(spark, sf_dir).select("day", "expiry", "strike")
    return filters.live_universe(listed, _day_spot(spark, sf_dir).select("day", "spot"), 3, 40, 0.03, True)


def friday_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.friday_expiry(forwards.clean_contracts(spark, sf_dir), 2, 30, 10)


def completed_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.completed(derived(spark, sf_dir, a.BARS), "symbol", "date", "close", 12)
    return rows.select("symbol", "date", "n", F.round("mean", 6).alias("mean"))


def contract_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions opened before noon with the last price of their contract on the tape that day, null if it did not print."""
    opened = paths.entries(derived(spark, sf_dir, a.MARKS), 12).select("entry", F.col("day0").alias("day"), "expiry", "strike", "call")
    tape = forwards.session(forwards.tape(spark, sf_dir)).groupBy("day", "expiry", "strike", "call").agg(F.max_by("price", F.struct("ts", "event_id")).alias("mark"))
    return filters.lookup(opened, tape, ["day", "expiry", "strike", "call"], ["mark"]).select("entry", "listed", F.round("mark", 4).alias("mark"))


def listed_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean prints of each day whose expiry is the day's Friday expiry."""
    rows = forwards.session(forwards.tape(spark, sf_dir))
    return filters.of_listed(rows, friday_expiry(spark, sf_dir), ["day", "expiry"]).groupBy("day", "expiry").agg(F.count(F.lit(1)).alias("n"))


def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived spots against the day's range and open: share inside, median and 95th percentile of the error in dollars and basis points. A row a day is all that meets."""
    day = _day_spot(spark, sf_dir).withColumn("spot", F.col("spot") * F.exp(-forwards.RATE * clock.years(clock.at(F.col("day"), forwards.CLOSE), F.col("near"))))
    rows = day.join(derived(spark, sf_dir, a.DAY_RANGE), "day").withColumn("err", F.abs(F.col("spot") - F.col("open"))).withColumn("bps", F.col("err") / F.col("open") * 1e4)
    at = lambda c, p: F.round(F.expr(f"percentile({c}, {p})"), 3)
    inside = (F.col("spot") >= F.col("low")) & (F.col("spot") <= F.col("high"))
    return rows.agg(F.count(F.lit(1)).alias("days"), F.round(F.avg(inside.cast("double")), 6).alias("inside"), at("err", 0.5).alias("median"), at("err", 0.95).alias("high"), at("bps", 0.5).alias("median_bps"), at("bps", 0.95).alias("high_bps"))


def iv_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The at-the-money volatility nearest to 30 days over the volatility index, by year (a row a day: index days are moved 28 years to meet the tape)."""
    atm = surface.atm_iv(derived(spark, sf_dir, a.OPTIONS), options.KEYS).where("atm is not null")
    near = atm.groupBy("day").agg(F.min_by("atm", F.struct(F.abs(F.col("dte") - 30), F.col("dte"))).alias("iv"))
    vix = derived(spark, sf_dir, a.INDICES).select(F.date_add("date", 10227).alias("day"), "vix")
    rows = near.join(vix, "day").withColumn("ratio", F.col("iv") / (F.col("vix") / 100))
    return rows.groupBy(F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("n"), *[F.round(x, 5).alias(n) for n, x in (("median", F.expr("percentile(ratio, 0.5)")), ("least", F.min("ratio")), ("most", F.max("ratio")))])


def catalogue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.totals(catalogue.card_fields(derived(spark, sf_dir, a.CARDS), "card"), derived(spark, sf_dir, a.RUNS))


QUERIES = {f.__name__: f for f in (snapshot_asof, grid_time, union_layouts, open_days, symbol_extract, raw_bundle, appended_log, registry_export, trading_calendar, rate_before, weekday_entries, live_universe, friday_expiry, completed_year, contract_lookup, listed_prints, spot_check, iv_check, catalogue_totals)}

_T = forwards.TAPE
_SNAP = f"{_T}, sn as (select *, (hour(wall) * 100 + minute(wall) // 30 * 30)::int as hhmm from t0)"
_NEAR = f"{forwards._SESSION}, {forwards.near_sql('day', str(forwards.NEED))}, ds as (select day, near, arg_max(fnear, (ts, call, event_id)) as spot from nf group by 1, 2)"
_FRIDAY = "fe as (select day, expiry, (expiry - day)::int as dte from (select distinct day, expiry from t) z where isodow(expiry) = 5 and expiry - day between 2 and 30 qualify row_number() over (partition by day order by abs(expiry - day - 10), expiry - day) = 1)"
_CLEAN = f"{_T}, {forwards.clean('09:30', '16:00')}"

ORACLES = {
    "snapshot_asof": f"""with {_SNAP}, k as (select day, hhmm, count(*) as n, day + to_minutes((hhmm // 100 * 60 + hhmm % 100)::bigint) as tm from sn group by 1, 2), l as (select arg_max(day, tm) as day, arg_max(hhmm, tm) as hhmm, arg_max(n, tm) as n from k)
select event_id, coalesce(k.day, l.day) as snap_day, coalesce(k.hhmm, l.hhmm) as hhmm, coalesce(k.n, l.n) as n from (select event_id, ts from events) e asof left join k on e.ts >= k.tm, l""",
    "grid_time": f"with {_SNAP} select day, count(*) as n, round(sum(price), 3) as total from sn where hhmm = 1000 group by 1",
    "union_layouts": f"with {_T} select day, count(*) as n, count(*) filter (where call) as known, round(sum(price), 3) as total from t0 group by 1",
    "open_days": f"with {forwards.TAPE}, {forwards.clean('15:45', '16:00')}, {forwards.pairs_sql('day')}, {forwards.near_sql('day', '1', '1')} select distinct day from t0 where day not in (select day from nf)",
    "symbol_extract": f"select date, round(close, 4) as close from ({a.BARS}) b where symbol = '1-URGENT'",
    "raw_bundle": "select 'orders' as name, count(*) as n, (select count(*) from (describe orders))::int as columns from orders union all select 'lineitem', count(*), (select count(*) from (describe lineitem))::int from lineitem union all select 'events', count(*), (select count(*) from (describe events))::int from events union all select 'part', count(*), (select count(*) from (describe part))::int from part",
    "appended_log": f"select book, count(*) as n, count(*) filter (where side = 'short') as with_reason from ({a.TRIPS}) t group by 1",
    "registry_export": f"""with r as (select split_part(name, '/', 1) as card, split_part(name, '/', 2) as variant, run::varchar as run, round(pnl, 4) as pnl from ({a.RUNS}) q union all select 'card-' || (doc_id % 50), '', doc_id::varchar, null from documents)
select card, nullif(variant, '') as variant, count(*) as n, count(pnl) as numbers, round(sum(pnl), 2) as pnl, max(run) as last_run from r group by 1, 2""",
    "trading_calendar": f"with {_T}, l as (select distinct date as day from ({a.BARS}) b) select day from l union select day from t0 where day > (select max(day) from l) and isodow(day) < 6",
    "rate_before": f"select b.symbol, b.date, round(i.irx, 6) as rate from ({a.BARS}) b asof left join (select * from ({a.INDEX_GAPS}) where irx is not null) i on b.date > i.date",
    "weekday_entries": f"select book, count(*) as n from ({a.TRIPS}) t where isodow(entry) in (1, 3, 5) group by 1",
    "live_universe": f"with {_NEAR} select distinct day, expiry, strike, w.r as \"right\" from t join ds using (day), unnest(['C', 'P']) w(r) where expiry - day between 3 and 40 and isodow(expiry) = 5 and abs(strike / spot - 1) <= 0.03",
    "friday_expiry": f"with {_CLEAN}, {_FRIDAY} select * from fe",
    "completed_year": f"select symbol, date, count(close) over w as n, round(avg(close) over w, 6) as mean from ({a.BARS}) b window w as (partition by symbol order by date range between interval 12 months preceding and interval 1 day preceding)",
    "contract_lookup": f"""with {_CLEAN}, p as (select day, expiry, strike, call, arg_max(price, (ts, event_id)) as mark from t group by all), m as ({a.MARKS}),
e as (select event_id as entry, day, expiry, strike, call from m where hour(ts) < 12 qualify row_number() over (partition by day, expiry, strike, call order by ts, event_id) = 1)
select entry, mark is not null as listed, round(mark, 4) as mark from e left join p using (day, expiry, strike, call) where day <= expiry""",
    "listed_prints": f"with {_CLEAN}, {_FRIDAY} select t.day, t.expiry, count(*) as n from t join fe on t.day = fe.day and t.expiry = fe.expiry group by 1, 2",
    "spot_check": f"""with {_NEAR}, s as (select day, spot * exp(-{forwards.RATE} * (epoch_us((near + time '16:00') at time zone 'America/New_York') - epoch_us((day + time '16:00') at time zone 'America/New_York')) / 1e6 / 31536000) as spot from ds),
e as (select *, abs(spot - open) as err, abs(spot - open) / open * 1e4 as bps from s join ({a.DAY_RANGE}) r using (day))
select count(*) as days, round(avg((spot between low and high)::int), 6) as inside, round(quantile_cont(err, 0.5), 3) as median, round(quantile_cont(err, 0.95), 3) as high, round(quantile_cont(bps, 0.5), 3) as median_bps, round(quantile_cont(bps, 0.95), 3) as high_bps from e""",
    "iv_check": f"""with o as ({a.OPTIONS}), m as (select *, quantile_cont(fwd, 0.5) over (partition by day, dte) as mid from o), b as (select day, dte, strike from m qualify row_number() over (partition by day, dte order by abs(strike - mid), strike) = 1),
g as (select day, dte, avg(iv) as atm from o join b using (day, dte, strike) group by all), n as (select day, atm from g where atm is not null qualify row_number() over (partition by day order by abs(dte - 30), dte) = 1),
j as (select n.day, atm / (vix / 100) as ratio from n join ({a.INDICES}) i on i.date + 10227 = n.day)
select year(day)::int as year, count(*) as n, round(quantile_cont(ratio, 0.5), 5) as median, round(min(ratio), 5) as least, round(max(ratio), 5) as most from j group by 1""",
    "catalogue_totals": f"select count(*) as cards, count(*) filter (where doc_id % 3 <> 1 and doc_id % 4 > 0) as judged, count(*) filter (where doc_id % 3 = 1) as planned, (select count(*) from ({a.RUNS}) r) as trials, (select count(distinct name) from ({a.RUNS}) r) as variants from documents",
}
