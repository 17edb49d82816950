"""Queries for fitted models, forwards and smiles at slots, streams and the catalogue, and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import catalogue, features, models, surface
from ..sources import adapters as a
from ..sources.adapters import derived
from ..sources import store
from ..streaming import slots
from . import forwards, options, research

LENGTH, HORIZON, THIN = 120, 22, 60
TODAY = "2024-06-15"
#: The day grid: slots, how stale a decision's prints are, the smile's lookback and the fill window, in minutes (wider than in production, as the test tape is thin).
GRID, LAG, LOOKBACK, WINDOW = [615 + 30 * i for i in range(12)], 15, 240, 60


def har_iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = F.collect_list("rv").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(-21, 0))
    rows = research._features(spark, sf_dir).select("symbol", "date", past.alias("past")).where("size(past) = 22").join(research.har_fit(spark, sf_dir), "symbol")
    out = models.iterate_har(rows, "past", {"intercept": F.col("intercept"), "d": F.col("b_rv_d"), "w": F.col("b_rv_w"), "m": F.col("b_rv_m")}, 4, 0.01)
    return out.select("symbol", "date", F.round(F.sqrt(252 * F.col("forecast") / 1e4), 6).alias("vol"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = research._features(spark, sf_dir).join(features.forward_target(derived(spark, sf_dir, a.BARS), HORIZON), ["symbol", "date"])
    return rows.select("symbol", "date", (F.pow("target", 2) / 252 * 1e4).alias("y"), F.col("rv_m").alias("a"), (F.pow(F.col("vix") / 100, 2) / 252 * 1e4).alias("b"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of each day by the fit of its month."""
    rows = _training(spark, sf_dir)
    fits = models.walk_forward(rows, ["symbol"], "y", "a", "b", 36, 2)
    days = rows.where("a is not null and b is not null").withColumn("month", F.year("date") * 12 + F.month("date")).join(fits, ["symbol", "month"])
    var = F.greatest(F.col("intercept") + F.col("ba") * F.col("a") + F.col("bb") * F.col("b"), F.lit(0.1))
    return days.select("symbol", "date", "n", F.round(F.sqrt(var * 252 / 1e4), 5).alias("vol"))


def garch_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.garch_monthly(research._features(spark, sf_dir).select("symbol", "date", "ret"), LENGTH, HORIZON).withColumn("vol", F.round("vol", 5))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = sum(((F.col("dte") > e).cast("int") for e in options.EDGES), F.lit(0))
    tier = sum(((F.abs("delta") > t).cast("int") for t in options.TIERS), F.lit(0))
    return derived(spark, sf_dir, a.QUOTES).withColumns({"bucket": bucket, "tier": tier})


def pooled_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.pooled_spread(_quotes(spark, sf_dir), THIN).select("tier", "bucket", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def spread_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.spread_quality(_quotes(spark, sf_dir), pooled_spread(spark, sf_dir), 0.02)
    return rows.select("tier", "bucket", "n", *[F.round(c, 6).alias(c) for c in ("mean_half", "median_half", "mean_fitted", "median_error")])


def smile_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smiles at three-hourly slots: `decide` from the six hours that end 15 minutes before the slot, `fill` from the three hours after it.

    A print is sent to the few slots that its time can count for. Where an expiry has no fill smile, the decide smile stands in; src tells.
    """
    rows = derived(spark, sf_dir, a.OPTIONS).withColumn("_m", F.hour("ts") * 60 + F.minute("ts"))
    slot = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("slot")
    decide = F.when((F.col("_m") < F.col("slot") * 180 - 15) & (F.col("_m") >= F.col("slot") * 180 - 375), "decide")
    views = rows.select("*", slot).select("*", F.explode(F.array_compact(F.array(decide, F.when(F.floor(F.col("_m") / 180) == F.col("slot"), "fill")))).alias("view"))
    fits = surface.smiles(views, ["day", "slot", "dte", "view"])
    one = lambda v: fits.where(F.col("view") == v).select("day", "slot", "dte", F.struct("a0", "n").alias(v))
    both = one("decide").join(one("fill"), ["day", "slot", "dte"], "full_outer")
    best = F.coalesce("fill", "decide")
    return both.select("day", "slot", "dte", F.when(F.col("fill").isNotNull(), "fill_smile").otherwise("decide_smile").alias("src"), F.round(best["a0"], 5).alias("a0"), best["n"].alias("n"))


def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints with the latest opposite print of their contract and day in the hour before, from a stream that keeps two prints a key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    tape = spark.sql(a.TAPE.replace("from events ", "from {events} "), events=source).select(F.to_date("ts").alias("day"), "expiry_no", "strike", "ts", "event_id", (F.col("right_") == "C").alias("call"), F.col("price").cast("double").alias("price"))
    rows = slots.run_available(spark, slots.paired_prints(tape, ["day", "expiry_no", "strike"], 3600.0, "2 hours"), "pairs")
    return rows.select("event_id", "other_id", F.round(F.col("strike") + F.col("gap"), 6).alias("forward"))


def view_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints that the decide and fill views of the day grid see, by slot, view and contract, from a stream of the stored tape."""
    source = spark.readStream.schema(forwards.tape(spark, sf_dir).schema).parquet(store.stored_tape(spark, sf_dir, lambda: forwards._prints(spark, sf_dir)))
    rows = slots.view_prints(forwards.session(source), LAG, LOOKBACK, WINDOW, GRID)
    return rows.select("day", "slot", "view", "expiry", "strike", "call", "n", "size", F.round("last", 4).alias("last"))


def garch_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the highest likelihood on the first day of each month. No SQL: an optimiser; tests hold it against simulated series, a finer search and the grid."""
    rows = models.garch_windows(research._features(spark, sf_dir).select("symbol", "date", "ret"), LENGTH)
    out = models.garch_fit(rows, HORIZON)
    return out.select("symbol", "date", *[F.round(c, 5).alias(c) for c in ("alpha", "beta", "vol", "likelihood")])


def slot_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots as a table by day and time of day that batches overwrite."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    prints = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("ts", F.col("value").alias("price"))
    rows = slots.slot_counts(prints, "30 minutes", "1 hour", 5.0).select("n", "total", F.to_date("slot").alias("day"), (F.hour("slot") * 100 + F.minute("slot")).alias("hhmm"))
    return slots.overwrite_partitions(spark, rows, ["day", "hhmm"], "snapshots").select("day", "hhmm", "n", F.round("total", 4).alias("total"))


def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.card_fields(derived(spark, sf_dir, a.CARDS), "card").drop("card")


def work_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.work_logs(derived(spark, sf_dir, a.LOGS), TODAY)


def card_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.team(card_fields(spark, sf_dir))


QUERIES = {f.__name__: f for f in (har_iterated, walk_forward, garch_monthly, pooled_spread, spread_quality, smile_views, streamed_pairs, slot_snapshots, view_prints, card_fields, work_logs, card_team, garch_fits)} | {
    "latest_runs": lambda s, d: catalogue.latest_runs(derived(s, d, a.RUNS)),
    "equal_baseline": lambda s, d: catalogue.equal_baseline(derived(s, d, a.RUNS), "5-LOW"),
    "trial_counts": lambda s, d: catalogue.trial_counts(derived(s, d, a.RUNS), "1996-01-01"),
    "last_week": lambda s, d: catalogue.last_week(derived(s, d, a.RUNS)).withColumn("change", F.round("change", 2)),
}

_SPREAD = f"""z as (select *, (dte > 7)::int + (dte > 14)::int + (dte > 30)::int as bucket, (abs(delta) > 0.5)::int + (abs(delta) > 0.75)::int as tier from ({a.QUOTES}) y), own as (select tier, bucket, count(*) as n, regr_intercept(half, mid) as a, regr_slope(half, mid) as b from z group by 1, 2),
pool as (select tier, regr_intercept(half, mid) as pa, regr_slope(half, mid) as pb from z group by 1), thin as (select tier, min(n) < {THIN} as thin from own group by 1),
m as (select tier, bucket, n, round(case when thin then pa else a end, 6) as a, round(case when thin then pb else b end, 6) as b from own join pool using (tier) join thin using (tier))"""
_VIEWS = f"select o.* replace (o.day || '|' || slot || '|' || view as day) from (select *, hour(ts) * 60 + minute(ts) as mi from ({a.OPTIONS}) r) o join (select unnest(range(1, 9)) as slot) s on true join (values ('decide'), ('fill')) v(view) on case view when 'decide' then mi < slot * 180 - 15 and mi >= slot * 180 - 375 else mi // 180 = slot end"
_CARD = """c as (select doc_id, source || ' study' as title, lang as owner, case doc_id % 3 when 1 then 'Open' else 'Done' end as status, case doc_id % 3 when 0 then 'kept' when 2 then 'dropped, see notes' end as detail, make_date(2024, (1 + doc_id % 9)::int, 11) as started,
case when doc_id % 3 = 1 then 'planned' when doc_id % 4 = 0 then 'run' else 'judged' end as stage from documents)"""


def oracles(daily: str, target: str, har: str) -> dict[str, str]:
    """SQL of the queries above, on the SQL of daily features, forward targets and the regression on lags."""
    f = [f"greatest(intercept + b_rv_d * {'x[22]' if i == 0 else f'f{i}'} + b_rv_w * ({' + '.join([f'f{j}' for j in range(1, i + 1)] + [f'x[{22 - j}]' for j in range(5 - i)])}) / 5 + b_rv_m * ({' + '.join([f'f{j}' for j in range(1, i + 1)] + [f'x[{22 - j}]' for j in range(22 - i)])}) / 22, 0.01) as f{i + 1}" for i in range(4)]
    training = f"""f as ({daily}), g as ({target}), r as (select symbol, date, year(date) * 12 + month(date) as month, target * target / 252 * 1e4 as y, rv_m as a, pow(vix / 100, 2) / 252 * 1e4 as b from f join g using (symbol, date))"""
    grid = ", ".join(f"({x}::double, {y}::double)" for x, y in models.GRID)
    return {
        "har_iterated": f"""with f as ({daily}), h as ({har}), p as (select symbol, date, list(rv) filter (where rv is not null) over (partition by symbol order by date rows 21 preceding) as x from f),
s as (select symbol, date, {', '.join(f)} from p join h using (symbol) where len(x) = 22) select symbol, date, round(sqrt(252 * (f1 + f2 + f3 + f4) / 4 / 1e4), 6) as vol from s""",
        "walk_forward": f"""with {training}, k as (select distinct symbol, month from r), j as (select k.symbol, k.month, y, a, b from k join r on r.symbol = k.symbol and r.month between k.month - 37 and k.month - 2 where y is not null and a is not null and b is not null),
c as (select symbol, month, count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from j group by 1, 2 having count(*) >= 60),
d as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as wb from c)
select r.symbol, r.date, n, round(sqrt(greatest(my - wa * ma - wb * mb + wa * r.a + wb * r.b, 0.1) * 252 / 1e4), 5) as vol from r join d using (symbol, month) where r.a is not null and r.b is not null""",
        "garch_monthly": f"""with recursive f as ({daily}), n as (select symbol, date, ret, lag(date_trunc('month', date)) over (partition by symbol order by date) as pm, list(ret) over (partition by symbol order by date rows {LENGTH - 1} preceding) as x from f where ret is not null),
w as materialized (select symbol, date, x, list_sum(list_transform(x, lambda v: v * v)) / {LENGTH} as v, alpha, beta from n cross join (values {grid}) g(alpha, beta) where len(x) = {LENGTH} and pm is distinct from date_trunc('month', date)),
s as (select symbol, date, x, v, alpha, beta, 0 as i, 0::double as l, v as h from w union all select symbol, date, x, v, alpha, beta, i + 1, l - ln(h) - pow(x[i + 1], 2) / h, v * (1 - alpha - beta) + alpha * pow(x[i + 1], 2) + beta * h from s where i < {LENGTH}),
b as (select * from s where i = {LENGTH} qualify row_number() over (partition by symbol, date order by round(l, 6) desc, alpha, beta) = 1)
select symbol, date, alpha, beta, round(sqrt(252 * (v + (h - v) * (1 - pow(alpha + beta, {HORIZON})) / ({HORIZON} * (1 - alpha - beta)))), 5) as vol from b""",
        "pooled_spread": f"with {_SPREAD} select * from m",
        "spread_quality": f"""with {_SPREAD}, e as (select z.*, greatest(0.02, a + b * mid) as fit from z join m using (tier, bucket))
select tier, bucket, count(*) as n, round(avg(half), 6) as mean_half, round(quantile_cont(half, 0.5), 6) as median_half, round(avg(fit), 6) as mean_fitted, round(quantile_cont(abs(half - fit), 0.5), 6) as median_error from e group by 1, 2""",
        "smile_views": f"""with {options._FITS.replace(a.OPTIONS, _VIEWS)}, k as (select split_part(day, '|', 1)::date as day, split_part(day, '|', 2)::int as slot, split_part(day, '|', 3) as view, dte, a0, n from s),
b as (select *, row_number() over (partition by day, slot, dte order by view desc) as r from k) select day, slot, dte, view || '_smile' as src, round(a0, 5) as a0, n from b where r = 1""",
        "streamed_pairs": f"""with t as (select *, ts::date as day, right_ = 'C' as call from ({a.TAPE}) q), l as (select day, expiry_no, strike, call, ts, arg_max(price, event_id) as price, max(event_id) as id from t group by 1, 2, 3, 4, 5),
j as (select t.*, l.price as other, l.id as other_id, epoch_us(t.ts) - epoch_us(l.ts) as us from t asof join l on t.day = l.day and t.expiry_no = l.expiry_no and t.strike = l.strike and t.call = (not l.call) and t.ts >= l.ts)
select event_id, other_id, round(strike + case when call then price - other else other - price end, 6) as forward from j where us <= 3600000000""",
        "slot_snapshots": f"with k as ({options.ORACLES['print_slots']}) select slot::date as day, (hour(slot) * 100 + minute(slot))::int as hhmm, n, total from k",
        "card_fields": f"with {_CARD} select * from c",
        "work_logs": f"""with l as (select *, regexp_extract_all(text, '(?m)^## ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) as heads, try_strptime('2024 ' || regexp_extract(stem, '([A-Z][a-z]+)[ _-]([0-9]+)', 1) || ' ' || regexp_extract(stem, '([A-Z][a-z]+)[ _-]([0-9]+)', 2), '%Y %B %d')::date as named from ({a.LOGS}) q where trim(text, chr(10) || ' ') <> '')
select owner, sum(greatest(len(heads), 1))::bigint as entries, max(coalesce(list_max(heads), case when named <= date '{TODAY}' then named::varchar when named is not null then (named - interval 1 year)::date::varchar end)) as last from l group by 1""",
        "view_prints": f"""with {forwards.TAPE}, {forwards.clean("09:30", "16:00")}, g as (select t.*, s as slot, (epoch_us(wall) - epoch_us(day::timestamp)) / 6e7 as m from t, unnest({GRID}) u(s)), v as (select *, 'decide' as view from g where m > slot - {LAG + LOOKBACK} and m <= slot - {LAG} union all select *, 'fill' from g where m > slot and m <= slot + {WINDOW})
select day, slot::int as slot, view, expiry, strike, call, count(*) as n, sum(size)::bigint as size, round(arg_max(price, (ts, event_id)), 4) as last from v where (day + to_minutes((slot + case view when 'decide' then -{LAG} else {WINDOW} end)::bigint)) at time zone 'America/New_York' at time zone 'UTC' <= (select max(ts) from t) - interval 2 hour group by all""",
        "card_team": f"with {_CARD} select owner, count(*) as cards, count(*) filter (where stage = 'judged') as judged, max(started) as last from c group by 1",
        "latest_runs": f"select name, multiple, run, ran, config, pnl from ({a.RUNS}) r qualify row_number() over (partition by name, multiple order by ran desc, run desc) = 1",
        "equal_baseline": f"""with r as ({a.RUNS}), l as (select * from r qualify row_number() over (partition by name, multiple order by ran desc, run desc) = 1), b as (select * from r where name like '5-LOW%' qualify row_number() over (partition by config, multiple order by ran, run) = 1)
select l.name, l.multiple, l.run, b.run as baseline from l left join b using (config, multiple)""",
        "trial_counts": f"select split_part(name, '/', 1) as card, count(distinct split_part(name, '/', 2)) as variants, count(*) as trials, count(*) filter (where ran > date '1996-01-01') as late from ({a.RUNS}) r group by 1",
        "last_week": f"with r as (select *, split_part(name, '/', 1) as card from ({a.RUNS}) q), w as (select *, max(ran) over (partition by card) as e from r) select card, count(*) as runs, round(sum(pnl), 2) as change from w where e - ran < 7 group by 1",
    }
