"""Queries of the desk tables, and the same rows in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, chains, desk, paths, surface
from ..sources import adapters as a
from ..sources.adapters import derived
from . import market, options, studies, trades

PASSES = 50


def chain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each print's contract valued on its smile: price, greeks, modelled quote."""
    rows = derived(spark, sf_dir, a.OPTIONS)
    rows = surface.smile_iv(rows, surface.smiles(rows, options.KEYS), options.KEYS).where("smile is not null")
    rows = options._valued(rows, "smile").withColumnRenamed("price", "mid")
    half = F.greatest(F.lit(0.02), 0.004 + 0.02 * F.col("mid"))
    return rows.select("event_id", F.round("smile", 5).alias("iv"), *[F.round(c, 4).alias(c) for c in ("mid", "delta", "gamma", "vega", "theta")], F.round(F.greatest(F.col("mid") - half, F.lit(0.0)), 4).alias("bid"), F.round(F.col("mid") + half, 4).alias("ask"))


def lad_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = desk.least_absolute(studies._quotes(spark, sf_dir).select("tier", "bucket", "half", "mid"), ["tier", "bucket"], "half", "mid", PASSES)
    return fit.select("tier", "bucket", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.clean_quotes(derived(spark, sf_dir, a.CHAIN)).where("mid is not null")
    return rows.select("event_id", F.round(desk.margin(F.col("fwd"), F.col("strike"), F.col("mid"), F.col("call")), 4).alias("margin"), desk.hedge_ratio(F.col("iv") - 0.18, 0.02, 0.03).alias("ratio"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By snapshot and forecaster: the expiry nearest to 30 days, its iv at the money, the premium over the last forecast, and the signal; none without an iv. There are five forecasters, one constant list."""
    chain = chains.clean_quotes(derived(spark, sf_dir, a.CHAIN))
    expiry = chains.pick_expiry(chain, market.SNAP, 10, 60, 30)
    atm = surface.atm_iv(chain.join(expiry, [*market.SNAP, "dte"], "left_semi"), [*market.SNAP, "dte"]).where("atm is not null")
    last = studies.har_iterated(spark, sf_dir).groupBy("symbol").agg(F.max_by("vol", "date").alias("vol"))
    every = last.agg(F.collect_list(F.struct("symbol", "vol"))).scalar()
    atm = atm.withColumn("_f", every).select("*", F.explode("_f").alias("_x"))
    premium = F.round(F.col("atm") - F.col("_x.vol"), 6)
    return atm.select("day", "hour", F.col("_x.symbol").alias("forecaster"), "dte", "strike", F.round("atm", 6).alias("atm"), premium.alias("premium"), F.when(premium > 0.012, "short").when(premium < 0.008, "long").otherwise("flat").alias("signal"))


def label_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived(spark, sf_dir, a.CANDIDATES)
    rows = c.select("day", "name", (F.col("name") % 4 == 0).alias("skip"))
    return desk.panel(rows, derived(spark, sf_dir, a.LABELS), ["day", "name"], "day").select("day", "name", "skip", F.round("label", 2).alias("label"))


def pick_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived(spark, sf_dir, a.CANDIDATES).groupBy("day").agg(F.max_by("name", F.struct("score", -F.col("name"))).alias("name"))
    return desk.mix(c.select(F.year("day").alias("year"), (F.col("name") % 8).alias("kind")), "year", "kind").withColumn("share", F.round("share", 6))


def delta_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.delta_profit(trades._rows(spark, sf_dir)).withColumn("delta_pnl", F.round("delta_pnl", 4))


def live_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = paths.book_days(trades._rows(spark, sf_dir), trades._closed(spark, sf_dir))
    return desk.live_book(days).select("call", "days", "up", F.round("last", 4).alias("last"), F.round("drawdown", 4).alias("drawdown"))


def day_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = derived(spark, sf_dir, a.CHAIN).groupBy("day", "hour").agg((F.avg(F.col("iv").isNotNull().cast("double")) >= 0.85).alias("usable"))
    return desk.snapshot_of_day(shots)


def source_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By slot: smiles, and the share that the decide view stood in for."""
    return studies.smile_views(spark, sf_dir).groupBy("slot").agg(F.count(F.lit(1)).alias("smiles"), F.round(F.avg((F.col("src") == "decide_smile").cast("double")), 6).alias("stand_in"))


def card_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = catalogue.card_fields(derived(spark, sf_dir, a.CARDS), "card")
    planned = fields.select("doc_id", F.add_months("started", 1).alias("started"))
    return desk.timeline(fields.where("stage != 'planned'"), planned, "doc_id")


def embargoed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.embargo(derived(spark, sf_dir, a.TRIPS), "1997-01-01", 60).select("trade", "entry", "exit", "forced")


QUERIES = {f.__name__: f for f in (chain_table, lad_spread, margins, decisions, label_panel, pick_mix, delta_profit, live_book, day_snapshots, source_share, card_timeline, embargoed)}


def _lad() -> str:
    fit = "select tier, bucket, (w * uv - u * v) / (w * uu - u * u) as b, (v - (w * uv - u * v) / (w * uu - u * u) * u) / w as a from (select tier, bucket, sum(g) as w, sum(g * mid) as u, sum(g * half) as v, sum(g * mid * mid) as uu, sum(g * mid * half) as uv from {0} group by 1, 2) s"
    steps = [f"l1 as ({fit.format('(select *, 1.0::double as g from z) q')})"]
    for i in range(2, PASSES + 1):
        steps.append(f"l{i} as ({fit.format(f'(select z.*, 1 / greatest(abs(half - a - b * mid), 1e-4) as g from z join l{i - 1} using (tier, bucket)) q')})")
    return f"with z as (select *, (dte > 7)::int + (dte > 14)::int + (dte > 30)::int as bucket, (abs(delta) > 0.5)::int + (abs(delta) > 0.75)::int as tier from ({a.QUOTES}) y), " + ", ".join(steps) + f" select tier, bucket, round(a, 5) as a, round(b, 5) as b from l{PASSES}"


def oracles(views: str, days: str, har: str) -> dict[str, str]:
    """SQL of the queries above, on the SQL of smile views."""
    greeks = options._GREEKS.replace(f"o as ({a.OPTIONS})", "oo as (select j.* replace (a0 + kc * (a1 + kc * a2) as iv0) from (select o.*, s.a0, s.a1, s.a2, least(greatest(o.k, s.kmin), s.kmax) as kc from o join s using (day, dte)) j)").replace("as sign from o)", "as sign from oo)")
    return {
        "chain_table": f"""with {options._FITS.replace("d as (", "d0 as (").replace("from d)", "from d0)")}, {greeks},
y as (select *, exp(-{options.RATE} * years) * (fwd * n1 - strike * n2 - put * (fwd - strike)) as mid from x)
select event_id, round(iv0, 5) as iv, round(mid, 4) as mid, round(n1 - put, 4) as delta, round(p1 / (spot * sd), 4) as gamma, round(spot * p1 * sqrt(years) / 100, 4) as vega, round((-spot * p1 * iv0 / (2 * sqrt(years)) - bond * (n2 - put)) / 365, 4) as theta,
  round(greatest(mid - greatest(0.02, 0.004 + 0.02 * mid), 0), 4) as bid, round(mid + greatest(0.02, 0.004 + 0.02 * mid), 4) as ask from y""",
        "lad_spread": _lad(),
        "margins": f"""with {market._CLEAN} select event_id, round(100 * (mid + greatest(0.2 * fwd - greatest(case when call then strike - fwd else fwd - strike end, 0), 0.1 * case when call then fwd else strike end)), 4) as margin,
  case when iv - 0.18 > 0.03 then 0.0 when iv - 0.18 > 0.02 then 0.5 else 1.0 end::double as ratio from c where mid is not null""",
        "decisions": f"""with {market._CLEAN}, x as (select distinct day, hour, dte from c where dte between 10 and 60), y as (select * from x qualify row_number() over (partition by day, hour order by abs(dte - 30), dte) = 1), m as (select c.*, quantile_cont(fwd, 0.5) over (partition by day, hour) as spot from c join y using (day, hour, dte)),
b as (select day, hour, dte, strike from (select *, row_number() over (partition by day, hour order by abs(strike - spot), strike) as r from m) z where r = 1), g as (select day, hour, dte, strike, avg(iv) as atm from m join b using (day, hour, dte, strike) group by all),
hf as (select symbol, arg_max(vol, date) as vol from ({har}) h group by 1), gp as (select g.*, symbol, round(atm - vol, 6) as premium from g, hf where atm is not null)
select day, hour::int as hour, symbol as forecaster, dte, strike, round(atm, 6) as atm, premium, case when premium > 0.012 then 'short' when premium < 0.008 then 'long' else 'flat' end as signal from gp""",
        "label_panel": f"""with c as (select *, name % 4 = 0 as skip from ({a.CANDIDATES}) q), w as (select day from c group by 1 having bool_and(skip or name % 41 > 0)) select day, name, skip, case when skip then 0 else round(label, 2) end::double as label from c join w using (day)""",
        "pick_mix": f"""with p as (select * from ({a.CANDIDATES}) q qualify row_number() over (partition by day order by score desc, name) = 1), g as (select year(day)::int as year, name % 8 as kind, count(*) as n from p group by 1, 2) select year, kind, n, round(n / sum(n) over (partition by year), 6)::double as share from g""",
        "delta_profit": f"with {trades._PATH}, l as (select *, sign * 100 * delta * (lead(fwd) over (partition by entry order by ts) - fwd) as gain from p) select entry, round(coalesce(sum(gain), 0), 4) as delta_pnl, count(*) as marks from l group by 1",
        "live_book": f"""with k as ({days}), w as (select *, greatest(max(total) over (partition by call order by day rows unbounded preceding), 0) - total as down, total > lag(total, 1, 0) over (partition by call order by day) as up from k)
select call, count(*) as days, count(*) filter (where up) as up, round(arg_max(total, day), 4) as last, round(max(down), 4) as drawdown from w group by 1""",
        "day_snapshots": f"with s as (select day, hour, avg((iv is not null)::int) >= 0.85 as usable from ({a.CHAIN}) c group by 1, 2) select day, hour::int as hour, usable from s qualify row_number() over (partition by day order by not usable, hour) = 1",
        "source_share": f"with v as ({views}) select slot, count(*) as smiles, round(avg((src = 'decide_smile')::int), 6) as stand_in from v group by 1",
        "card_timeline": f"with {studies._CARD} select doc_id, case when stage = 'planned' then (started + interval 1 month)::date else started end as started, case when stage = 'planned' then 'planned' else 'card' end as kind from c",
        "embargoed": f"select trade, entry, least(exit, date '1997-01-01') as exit, exit > date '1997-01-01' as forced from ({a.TRIPS}) t where entry < date '1997-01-01' - 60",
    }
