"""The day-grid build: chains of every half-hour slot, on which to decide and on which to fill; and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import models, signals, views
from ..sources import adapters as a
from ..sources import store
from ..sources.adapters import derived
from . import forwards, options, studies

#: Slots from 10:15 to 15:45. Minutes: how stale a decision's prints are, the fill window, the smile's lookback (wider than in production, as the test tape is thin). Pairs of a forward, and of one in the fill window.
GRID, LAG, WINDOW, LOOKBACK, NEED, FEW = studies.GRID, studies.LAG, studies.WINDOW, studies.LOOKBACK, 10, 3
CONTRACT = ["expiry", "strike", "call"]
LOW_DTE, HIGH_DTE, REACH = 1, 60, 0.5
#: Days of the grid after the tape's last; reasons for a skip and their columns.
AFTER, WHY = 3, {"no_trades": "no_trades", "no parity forward": "no_forward", "no smile": "no_smile"}


def _built(spark: SparkSession, sf_dir: str, fills: bool = True) -> tuple[DataFrame, DataFrame]:
    tape = forwards.tape(spark, sf_dir)
    return views.build(tape, forwards.session(tape), CONTRACT, GRID, forwards.RATE, forwards.WITHIN, derived(spark, sf_dir, a.EX_DAYS), LAG, WINDOW, LOOKBACK, NEED, FEW, LOW_DTE, HIGH_DTE, REACH, AFTER, fills)


def slot_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot's contracts with iv, mid, delta and modelled quote, by view and source of the smile; fill rows without any smile have no values."""
    model = models.pooled_spread(studies._quotes(spark, sf_dir), studies.THIN).select("tier", "bucket", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))
    out = signals.half_spread(_built(spark, sf_dir)[0], model, options.EDGES, options.TIERS, 0.02)
    half = F.when(F.col("mid").isNotNull(), F.col("fitted"))
    values = [F.when(F.col("src").isNotNull(), F.round(c, 3)).alias(c) for c in ("mid", "delta")]
    return out.select(*views.VIEW, *CONTRACT, "src", F.round("iv", 4).alias("iv"), *values, F.round("spot", 3).alias("spot"), F.round(F.col("mid") - half, 3).alias("bid"), F.round(F.col("mid") + half, 3).alias("ask"))


def build_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots that the build skipped, and why."""
    return _built(spark, sf_dir, fills=False)[1]


def skipped_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By year: slots, the share of each reason for a skip, and the share of days without any chain."""
    built, log = _built(spark, sf_dir, fills=False)
    days = built.where("view = 'decide'").select("day", "slot").distinct().withColumn("why", F.lit(None).cast("string")).unionByName(log)
    out = days.groupBy(F.year("day").alias("year"), "day").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("why") == w, 1)).alias(c) for w, c in WHY.items()])
    share = lambda c: F.round(F.sum(c) / F.sum("n"), 6).alias(c)
    return out.groupBy("year").agg(F.sum("n").alias("slots"), *[share(c) for c in WHY.values()], F.round(F.avg((sum((F.col(c) for c in WHY.values()), F.lit(0)) == F.col("n")).cast("double")), 6).alias("empty_days"))


QUERIES = {f.__name__: f for f in (slot_chain, build_log, skipped_years)}


def _cdf(x: str) -> str:
    horner = lambda cs: "".join(["("] * (len(cs) - 1)) + repr(cs[0]) + "".join(f" * abs({x}) + {c!r})" for c in cs[1:])
    near = f"exp(-0.5 * {x} * {x}) * {horner(pricing.NUMERATOR)} / {horner(pricing.DENOMINATOR)}"
    return f"(case when abs({x}) > 7.07 then ({x} > 0)::int when {x} > 0 then 1 - {near} else {near} end)"


_R, _K = forwards.RATE, "day, slot, view"
_PICK = "(select x.* replace (case view when 'decide' then 'decide' else 'fill' end as view) from {0} x left join has using (day, slot) where view = 'decide' or (view = 'short') = (has.yes is not null))"
_UTC = lambda minutes: f"((day + to_minutes({minutes})) at time zone 'America/New_York' at time zone 'UTC')"
_FITS = options._FITS.replace(f"o as ({a.OPTIONS})", "o as (select concat(day, '|', slot, '|', view) as day, expiry as dte, strike, call, size, k, iv, 0 as condition from ivs)")
_GREEKS = options._GREEKS.replace(f"o as ({a.OPTIONS})", "oo as (select * exclude (iv), iv as iv0 from ch)").replace("as sign from o)", "as sign from oo)")

_BUILD = f"""with recursive {forwards.TAPE}, {forwards.clean("09:30", "16:00", name="tp")},
vw as (select * from (select tp.*, g as slot, view, (epoch_us(wall) - epoch_us(day::timestamp)) / 6e7 as m from tp, unnest({GRID}) g(g), unnest(['decide', 'short', 'long']) w(view)) z
       where m > 570 and case view when 'decide' then m <= slot - {LAG} when 'short' then m > slot and m <= slot + {WINDOW} else m <= slot + {WINDOW} end),
{forwards.pairs_sql(_K, "vw")}, {forwards.near_sql(_K, f"case view when 'short' then {FEW} else {NEED} end", f"case view when 'short' then {min(FEW, 5)} else {min(NEED, 5)} end")},
{forwards.ratio_sql(_K, f"case view when 'short' then {min(FEW, 5)} else {min(NEED, 5)} end")},
has as (select distinct day, slot, true as yes from nf where view = 'short'), ca as {_PICK.format("ra")}, cal as {_PICK.format("ral")},
dy as (select day, row_number() over (order by day) as i from (select distinct day from tp) z),
cand as (select distinct day, slot, expiry, strike, call from vw where view = 'decide'
  union select b.day, slot, expiry, strike, call from (select distinct day, expiry, strike, call from tp) p join dy a1 on a1.day = p.day join dy b on b.i > a1.i and b.i <= a1.i + 5 join (select distinct day, slot from vw) sl on sl.day = b.day),
li as (select * from (select cand.*, expiry - day as dte, view, {_UTC(f"case view when 'decide' then slot - {LAG} else slot + {WINDOW} end")} as ts from cand, unnest(['decide', 'fill']) w(view)) z where dte between {LOW_DTE} and {HIGH_DTE}),
{forwards.forward_sql(_K, "(select distinct day, slot, view, expiry, ts from li)", "fe", "ca")},
lf as (select * from (select li.*, forward, {forwards._SPOT.replace("'ts'", "'li.ts'").replace("epoch_us(ts)", "epoch_us(li.ts)").replace("day and", "li.day and")} as spot, ln(strike / forward) as k from li join fe on li.day = fe.day and li.slot = fe.slot and li.view = fe.view and li.expiry = fe.expiry) z where abs(k) <= {REACH}),
pr as (select * replace (case view when 'short' then 'fill' else view end as view) from vw where view = 'short' or view = 'decide' and m > slot - {LAG + LOOKBACK}), {forwards.forward_sql(_K, "pr", "fp", "ca")},
g0 as (select *, ln(strike / forward) as k, {forwards.years("ts", "expiry")} as y, price * exp({_R} * {forwards.years("ts", "expiry")}) as grown, price * exp({_R} * {forwards.years("ts", "expiry")}) + case when call then 0 else forward - strike end as goal from fp),
hb as (select day, slot, view, event_id, forward, strike, y, goal, 0.001::double as lo, 5.0::double as hi, 0 as i from g0 where y > 0 and grown > greatest(case when call then forward - strike else strike - forward end, 0)
  union all select day, slot, view, event_id, forward, strike, y, goal, case when above then lo else mid end, case when above then mid else hi end, i + 1
  from (select *, forward * {_cdf("d1")} - strike * {_cdf("d2")} > goal as above from (select *, ln(forward / strike) / (mid * sqrt(y)) + mid * sqrt(y) / 2 as d1, ln(forward / strike) / (mid * sqrt(y)) - mid * sqrt(y) / 2 as d2 from (select *, (lo + hi) / 2 as mid from hb where i < 60) z1) z2) z3),
ivs as (select g0.*, case when (lo + hi) / 2 > 0.0010001 and (lo + hi) / 2 < 4.9999 then (lo + hi) / 2 end as iv from g0 left join (select * from hb where i = 60) hb using (day, slot, view, event_id)),
{_FITS}, sf as (select split_part(day, '|', 1)::date as day, split_part(day, '|', 2)::int as slot, split_part(day, '|', 3) as view, dte as expiry, a0, a1, a2, kmin, kmax from s),
sv as (select *, view || '_smile' as src from sf union all select x.* replace ('fill' as view), 'decide_smile' from sf x where view = 'decide' and not exists (from sf z where z.view = 'fill' and z.day = x.day and z.slot = x.slot and z.expiry = x.expiry)),
ch as (select *, forward as fwd, a0 + kc * (a1 + kc * a2) as iv from (select lf.*, src, a0, a1, a2, least(greatest(k, kmin), kmax) as kc, {forwards.years(_UTC("slot"), "expiry")} as years from lf left join sv using (day, slot, view, expiry) where view = 'fill' or src is not null) z),
ok as (select distinct day, slot from ch where view = 'decide')"""
_LOG = f"""{_BUILD}, gd as (select d::date as day, g as slot from (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp + interval {AFTER} day, interval 1 day)) as d from t0) z, unnest({GRID}) g(g)),
lg as (select gd.*, case when not exists (from t0 where t0.day = gd.day) then 'no_trades' when not exists (from nf where nf.view = 'decide' and nf.day = gd.day and nf.slot = gd.slot) then 'no parity forward' when ok.day is null then 'no smile' end as why from gd left join ok using (day, slot))"""

ORACLES = {
    "slot_chain": f"""{_BUILD},
{_GREEKS.replace("*, fwd * exp(-" + str(options.RATE) + " * years) as spot", "*, fwd * exp(-" + str(options.RATE) + " * years) as gone")},
pm as (select *, case when src is not null then greatest(exp(-{_R} * years) * (fwd * n1 - strike * n2 - put * (fwd - strike)), exp(-{_R} * years) * sign * (fwd - strike), sign * (spot - strike), 0) end as mid, n1 - put as delta from x),
{studies._SPREAD}, fq as (select pm.*, case when mid is not null then greatest(0.02, m.a + m.b * mid) end as half from pm left join m on m.tier = (abs(delta) > 0.5)::int + (abs(delta) > 0.75)::int and m.bucket = (dte > 7)::int + (dte > 14)::int + (dte > 30)::int)
select day, slot::int as slot, view, expiry, strike, call, src, round(iv0, 4) as iv, round(mid, 3) as mid, round(delta, 3) as delta, round(spot, 3) as spot, round(mid - half, 3) as bid, round(mid + half, 3) as ask from fq join ok using (day, slot)""",
    "build_log": f"{_LOG} select day, slot::int as slot, why from lg where why is not null",
    "skipped_years": f"""{_LOG} select year, sum(n)::bigint as slots, round(sum(no_trades) / sum(n), 6) as no_trades, round(sum(no_forward) / sum(n), 6) as no_forward, round(sum(no_smile) / sum(n), 6) as no_smile, round(avg((no_trades + no_forward + no_smile = n)::int), 6) as empty_days
from (select year(day)::int as year, day, count(*) as n, {", ".join(f"count(*) filter (where why = '{w}') as {c}" for w, c in WHY.items())} from lg group by 1, 2) z group by 1""",
}
