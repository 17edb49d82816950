"""Queries over the tape: clock, clean prints, parity pairs, forwards, closes; and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import forwards
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived

#: Rate; seconds that a pair's prints may lie apart; pairs of the near expiry; condition codes that count; least price; open, close and start of the close's window in minutes.
RATE, WITHIN, NEED, CODES, LEAST = 0.05, 3600.0, 20, [0, 209], 0.05
#: A scan's bounds, in UTC.
WEEK = ("2024-01-08 00:00:00", "2024-01-15 00:00:00")
OPEN, CLOSE, LATE = 9 * 60 + 30, 16 * 60, 15 * 60 + 45


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prints with their day in New York and a numeric condition."""
    rows = derived(spark, sf_dir, a.PRINTS)
    return rows.withColumns({"day": clock.eastern_day(F.col("ts")), "condition": clock.condition_code(F.col("conditions"))})


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored tape: filters on price, condition and time reach its scan."""
    return spark.read.parquet(store.stored_tape(spark, sf_dir, lambda: _prints(spark, sf_dir))).drop("month")


def scanned_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of the stored tape: its month's files, the week's rows, four columns."""
    tape(spark, sf_dir)
    rows = store.scan_day(spark, store.stored_tape(spark, sf_dir, lambda: _prints(spark, sf_dir)), *WEEK, ["event_id", "ts", "condition", "price"])
    return rows.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "condition", F.round("price", 4).alias("price"))


def session(rows: DataFrame, start: int = OPEN, end: int = CLOSE) -> DataFrame:
    return forwards.clean(rows, clock.within(F.col("ts"), F.col("day"), start, end), CODES, LEAST)


def eastern_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir)
    wall = clock.eastern(F.col("ts"))
    return rows.select("event_id", "day", (F.hour(wall) * 100 + F.minute(wall)).alias("hhmm"), "condition", F.round(clock.years(F.col("ts"), F.col("expiry")), 9).alias("years"))


def _pairs(spark: SparkSession, sf_dir: str, start: int = OPEN) -> DataFrame:
    return forwards.pairs(session(tape(spark, sf_dir), start), ["day"], RATE, WITHIN)


def parity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("event_id", "day", "expiry", F.round("fwd", 6).alias("forward"))


def near_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forwards.near_forward(_pairs(spark, sf_dir), ["day"], NEED).select("day", "near", "event_id", F.round("fnear", 6).alias("forward"))


def forward_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward of each clean print's expiry, and the spot, at its time."""
    ex, prs = derived(spark, sf_dir, a.EX_DAYS), store.settle(_pairs(spark, sf_dir))
    near = store.settle(forwards.near_forward(prs, ["day"], NEED))
    rows = session(tape(spark, sf_dir)).select("day", "ts", "expiry", "event_id")
    out = forwards.forward_at(rows, near, forwards.ratios(prs, near, ["day"], RATE, ex), ["day"], RATE, ex)
    return forwards.with_spot(out, RATE, ex).select("event_id", F.round("forward", 5).alias("forward"), F.round("spot", 5).alias("spot"))


def parity_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spot behind the last near forward from 15:45 to 16:00 of each day with enough pairs there (one is enough here, as 15 minutes of the test tape hold few)."""
    near = forwards.near_forward(_pairs(spark, sf_dir, LATE), ["day"], 1, 1)
    last = near.groupBy("day", "near").agg(F.max_by("fnear", F.struct("ts", "call", "event_id")).alias("f"))
    return last.select("day", "near", F.round(F.col("f") * F.exp(-RATE * clock.years(clock.at(F.col("day"), CLOSE), F.col("near"))), 5).alias("close"))


def clean_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contracts of a day with clean prints after the open."""
    return session(tape(spark, sf_dir)).select("day", "expiry", "strike", "call").distinct()


QUERIES = {f.__name__: f for f in (scanned_prints, eastern_tape, clean_contracts, parity_pairs, near_forward, forward_at, parity_close)}


def years(ts: str, expiry: str) -> str:
    return f"((epoch_us(({expiry} + time '16:00') at time zone 'America/New_York' at time zone 'UTC') - epoch_us({ts})) / 1e6 / 31536000)"


def wall(ts: str) -> str:
    return f"({ts} at time zone 'UTC' at time zone 'America/New_York')"


TAPE = f"t0 as (select *, {wall('ts')}::date as day, {wall('ts')} as wall, coalesce(try_cast(nullif(conditions, '') as int), 0) as condition from ({a.PRINTS}) q)"


def clean(start: str, end: str, source: str = "t0", name: str = "t") -> str:
    return f"{name} as (select * replace (case when isodow(expiry) = 6 then expiry - 1 else expiry end as expiry) from {source} where wall > day + time '{start}' and wall <= day + time '{end}' and condition in (0, 209) and price >= 0.05)"


def pairs_sql(keys: str, source: str = "t", name: str = "q") -> str:
    """Pairs by an as-of join for each direction."""
    on = " and ".join(f"x.{k} = y.{k}" for k in [*keys.split(", "), "expiry", "strike"])
    latest = lambda c: f"(select {keys}, expiry, strike, ts, arg_max(price, event_id) as price from {source} where {c} group by all)"
    one = lambda mine, other, sign: f"select x.*, y.ts as ots, {sign} * (x.price - y.price) as cp from (select * from {source} where {mine}) x asof join {latest(other)} y on {on} and x.ts >= y.ts"
    return f"{name} as (select *, strike + cp * exp({RATE} * {years('ts', 'expiry')}) as fwd from ({one('call', 'not call', 1)} union all {one('not call', 'call', -1)}) u where epoch_us(ts) - epoch_us(ots) <= {WITHIN} * 1e6)"


def near_sql(keys: str, need: str, least: str = "5", source: str = "q", name: str = "nf") -> str:
    w = f"(partition by {keys} order by ts, call, event_id rows 19 preceding)"
    return f"""{name}n as (select {keys}, min(expiry) as near from (select {keys}, expiry from {source} where expiry >= day group by all having count(*) >= {need}) g group by all),
{name}r as (select q.*, near, quantile_cont(fwd, 0.5) over {w} as rough from {source} q join {name}n n using ({keys}) where expiry = near),
{name} as (select {keys}, near, ts, call, event_id, quantile_cont(fwd, 0.5) over {w} as fnear from {name}r where abs(strike / rough - 1) <= 0.02 qualify count(*) over {w} >= {least})"""


def _on(keys: str, a_: str, b: str) -> str:
    return " and ".join(f"{a_}.{k} = {b}.{k}" for k in keys.split(", "))


def _carry(ts: str) -> str:
    return f"((fnear * exp(-{RATE} * {years(ts, 'near')}) - coalesce(list_sum(list_transform(list_filter(divs, lambda d: d.ex_date > near and d.ex_date <= expiry), lambda d: d.amount)), 0)) * exp({RATE} * {years(ts, 'expiry')}) / fnear)"


def ratio_sql(keys: str, least: str = "5", source: str = "q", near: str = "nf", name: str = "ra") -> str:
    w = f"(partition by {keys}, expiry order by ts, call, event_id rows 19 preceding)"
    last = f"(select {keys}, ts, arg_max(fnear, (call, event_id)) as fnear, any_value(near) as near from {near} group by {keys}, ts)"
    return f"""ex as (select list({{'ex_date': ex_date, 'amount': amount}}) as divs from ({a.EX_DAYS}) g), {name}l as {last},
{name}b as (select q.*, l.fnear, l.near, divs from {source} q asof join {name}l l on {_on(keys, 'q', 'l')} and q.ts >= l.ts, ex where expiry <> l.near),
{name} as (select {keys}, expiry, ts, call, event_id, quantile_cont(fwd / fnear, 0.5) over {w} as ratio from {name}b where abs(strike / (fnear * {_carry('ts')}) - 1) <= 0.02 qualify count(*) over {w} >= {least})"""


def forward_sql(keys: str, rows: str, name: str = "fa", ratio: str = "ra") -> str:
    """rows with fnear, near and forward; needs ratio_sql before it."""
    return f"""{name}k as (select e.*, l.fnear, l.near from {rows} e asof join {ratio}l l on {_on(keys, 'e', 'l')} and e.ts >= l.ts),
{name}o as (select {keys}, expiry, ts, arg_max(ratio, (call, event_id)) as ratio from {ratio} group by {keys}, expiry, ts),
{name} as (select j.*, fnear * case when expiry = near then 1 else coalesce(ratio, {_carry('ts')}) end as forward
  from (select k.*, o.ratio, divs from {name}k k asof left join {name}o o on {_on(keys, 'k', 'o')} and k.expiry = o.expiry and k.ts >= o.ts, ex) j)"""


_SPOT = f"fnear * exp(-{RATE} * {years('ts', 'near')}) - coalesce(list_sum(list_transform(list_filter(divs, lambda d: d.ex_date > day and d.ex_date <= near), lambda d: d.amount)), 0)"
_SESSION = f"{TAPE}, {clean('09:30', '16:00')}, {pairs_sql('day')}"

ORACLES = {
    "scanned_prints": f"with {TAPE} select event_id, epoch_us(ts) as us, condition, round(price, 4) as price from t0 where ts >= timestamp '{WEEK[0]}' and ts < timestamp '{WEEK[1]}'",
    "eastern_tape": f"with {TAPE} select event_id, day, (hour(wall) * 100 + minute(wall))::int as hhmm, condition, round({years('ts', 'expiry')}, 9) as years from t0",
    "clean_contracts": f"with {TAPE}, {clean('09:30', '16:00')} select distinct day, expiry, strike, call from t",
    "parity_pairs": f"with {_SESSION} select event_id, day, expiry, round(fwd, 6) as forward from q",
    "near_forward": f"with {_SESSION}, {near_sql('day', str(NEED))} select day, near, event_id, round(fnear, 6) as forward from nf",
    "forward_at": f"with {_SESSION}, {near_sql('day', str(NEED))}, {ratio_sql('day')}, {forward_sql('day', 't')} select event_id, round(forward, 5) as forward, round({_SPOT}, 5) as spot from fa",
    "parity_close": f"""with {TAPE}, {clean('15:45', '16:00')}, {pairs_sql('day')}, {near_sql('day', '1', '1')}
select day, near, round(arg_max(fnear, (ts, call, event_id)) * exp(-{RATE} * (epoch_us((near + time '16:00') at time zone 'America/New_York') - epoch_us((day + time '16:00') at time zone 'America/New_York')) / 1e6 / 31536000), 5) as close from nf group by day, near""",
}
