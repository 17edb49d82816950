"""Queries over option prints: pricing, smiles, forwards, spreads, slots; and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import books, signals, surface
from ..operators.quantiles import quantiles
from ..sources import adapters as a
from ..sources.adapters import derived
from ..streaming import slots

RATE = 0.05
KEYS = ["day", "dte"]
EDGES, TIERS = [7, 14, 30], [0.5, 0.75]


def _valued(rows: DataFrame, sigma: str) -> DataFrame:
    return pricing.valued(rows, F.col("fwd"), F.col("strike"), F.col("years"), RATE, F.col(sigma), F.col("call"))


def option_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(derived(spark, sf_dir, a.OPTIONS), "iv0")
    spot = F.col("fwd") * F.exp(-RATE * F.col("years"))
    least = pricing.price_floor(F.col("fwd"), F.col("strike"), F.col("years"), F.lit(RATE), spot, F.col("call"))
    return rows.select("event_id", *[F.round(c, 6).alias(c) for c in ("price", "delta", "gamma", "vega", "theta")], F.round(least, 6).alias("least"))


def implied_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every print's price; some prices lie at intrinsic value or above what any volatility gives, and some contracts have no time left."""
    rows, n = _valued(derived(spark, sf_dir, a.OPTIONS), "iv0"), F.col("event_id")
    least = F.exp(-RATE * F.col("years")) * F.greatest(F.when(F.col("call"), F.col("fwd") - F.col("strike")).otherwise(F.col("strike") - F.col("fwd")), F.lit(0.0))
    px = F.when(n % 41 == 0, least).when(n % 43 == 0, F.col("fwd") + F.col("strike")).otherwise(F.col("price"))
    left = F.when(n % 47 == 0, 0.0).otherwise(F.col("years"))
    return rows.select("event_id", F.round(pricing.implied(px, F.col("fwd"), F.col("strike"), left, F.lit(RATE), F.col("call")), 4).alias("iv"))


def smile_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = surface.smiles(derived(spark, sf_dir, a.OPTIONS), KEYS)
    return fits.select(*KEYS, F.round("a0", 6).alias("a0"), F.round("a1", 4).alias("a1"), F.round("a2", 3).alias("a2"), F.round("kmin", 6).alias("kmin"), F.round("kmax", 6).alias("kmax"), "n")


def smile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median distance of prints from their smile by condition code."""
    rows = derived(spark, sf_dir, a.OPTIONS)
    held = surface.smile_iv(rows, surface.smiles(rows, KEYS), KEYS)
    held = held.select("condition", F.abs(F.col("iv") - F.col("smile")).alias("off"))
    counts = held.groupBy("condition").agg(F.count("off").alias("n"))
    return counts.join(quantiles(held, ["condition"], "off", [0.5]), "condition", "left").select("condition", F.col("condition").isin(0, 209).alias("allowed"), "n", F.round("q0", 5).alias("median_off"))


def atm_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.atm_iv(derived(spark, sf_dir, a.OPTIONS), KEYS).select(*KEYS, "strike", F.round("atm", 6).alias("atm"))


def fitted_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = derived(spark, sf_dir, a.QUOTES)
    held = signals.half_spread(quotes, books.spread_fit(quotes, EDGES, TIERS), EDGES, TIERS, 0.02)
    buy = F.col("quote") % 2 == 0
    return held.select("quote", F.round("fitted", 10).alias("fitted"), F.round(signals.fill_price(F.col("mid"), F.col("half"), buy, 2.0), 2).alias("fill"), signals.premium_size(F.col("mid"), 5000.0).alias("size"), F.round(signals.fee(F.col("dte"), 0.65, 1.0), 2).alias("fee"))


def print_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    prints = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("ts", F.col("value").alias("price"))
    out = slots.run_available(spark, slots.slot_counts(prints, "30 minutes", "1 hour", 5.0), "slots")
    return out.select(F.col("slot").cast("timestamp_ntz").alias("slot"), "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (option_prices, implied_volatility, smile_fits, smile_errors, atm_iv, fitted_spread, print_slots)}


def _density(x: str) -> str:
    return f"(exp(-0.5 * ({x}) * ({x})) * 0.3989422804014327)"


def _cdf(x: str) -> str:
    """Another way than the operator's: the series of odd powers over double factorials, and 1 or 0 far out, where it no longer tells apart."""
    double = "exp(lgamma(n + 1.5) - lgamma(1.5) + n * ln(2.0))"
    series = f"list_sum(list_transform(range(150), lambda n: exp((2 * n + 1) * ln(greatest(abs({x}), 1e-300)) - ln({double}))))"
    return f"(case when {x} > 8 then 1.0 when {x} < -8 then 0.0 else 0.5 + sign({x}) * {_density(x)} * {series} end)"


def _parabola(source: str) -> str:
    """Least squares by centred moments: another way than the operator's determinants."""
    return f"""
(select *, mv - a1 * mk - a2 * mq as a0 from (select *, (kv * qq - qv * kq) / (kk * qq - kq * kq) as a1, (qv * kk - kv * kq) / (kk * qq - kq * kq) as a2 from (
 select day, dte, count(*) as n, count(distinct strike) as strikes, min(k) as kmin, max(k) as kmax, any_value(mk) as mk, any_value(mq) as mq, any_value(mv) as mv, sum(size * (k - mk) * (k - mk)) as kk,
   sum(size * (k - mk) * (k * k - mq)) as kq, sum(size * (k * k - mq) * (k * k - mq)) as qq, sum(size * (k - mk) * (iv - mv)) as kv, sum(size * (k * k - mq) * (iv - mv)) as qv
 from (select *, sum(size * k) over g / sum(size) over g as mk, sum(size * k * k) over g / sum(size) over g as mq, sum(size * iv) over g / sum(size) over g as mv from {source} window g as (partition by day, dte)) m
 group by 1, 2) n) p where n >= 10 and strikes >= 5)"""


_FITS = f"""o as ({a.OPTIONS}), r as (select * from o where iv is not null and abs(k) <= 0.3 and case when call then k >= -0.05 else k <= 0.05 end), f as {_parabola("r")},
d as (select r.*, abs(iv - (a0 + k * (a1 + k * a2))) as off from r join f using (day, dte)), u as (select *, quantile_cont(off, 0.5) over (partition by day, dte) as usual from d),
t as (select * from u where off <= 3.0 * 1.4826 * usual + 1e-4), h as {_parabola("t")},
s as (select * from h where kmin <= 0 and kmax >= 0 and len(list_filter(range(21), lambda i: a0 + (kmin + (kmax - kmin) * i / 20) * (a1 + (kmin + (kmax - kmin) * i / 20) * a2) <= 0.001)) = 0)"""
_GREEKS = f"""o as ({a.OPTIONS}), v as (select *, fwd * exp(-{RATE} * years) as spot, iv0 * sqrt(years) as sd, {RATE} * strike * exp(-{RATE} * years) as bond, case when call then 0 else 1 end as put, case when call then 1 else -1 end as sign from o),
w as (select *, ln(fwd / strike) / sd + sd / 2 as d1, ln(fwd / strike) / sd - sd / 2 as d2 from v), x as (select *, {_cdf("d1")} as n1, {_cdf("d2")} as n2, {_density("d1")} as p1 from w)"""

ORACLES = {
    "option_prices": f"""with {_GREEKS} select event_id, round(exp(-{RATE} * years) * (fwd * n1 - strike * n2 - put * (fwd - strike)), 6) as price, round(n1 - put, 6) as delta, round(p1 / (spot * sd), 6) as gamma,
  round(spot * p1 * sqrt(years) / 100, 6) as vega, round((-spot * p1 * iv0 / (2 * sqrt(years)) - bond * (n2 - put)) / 365, 6) as theta, round(greatest(exp(-{RATE} * years) * sign * (fwd - strike), sign * (spot - strike), 0), 6) as least from x""",
    "implied_volatility": f"select event_id, case when event_id % 41 > 0 and event_id % 43 > 0 and event_id % 47 > 0 then round(iv0, 4) end as iv from ({a.OPTIONS}) o",
    "smile_fits": f"with {_FITS} select day, dte, round(a0, 6) as a0, round(a1, 4) as a1, round(a2, 3) as a2, round(kmin, 6) as kmin, round(kmax, 6) as kmax, n from s",
    "smile_errors": f"""with {_FITS}, q as (select condition, abs(iv - (a0 + kc * (a1 + kc * a2))) as off from (select o.condition, o.iv, s.*, least(greatest(o.k, s.kmin), s.kmax) as kc from o left join s using (day, dte)) j)
select condition, condition in (0, 209) as allowed, count(off) as n, round(quantile_cont(off, 0.5), 5) as median_off from q group by 1, 2""",
    "atm_iv": f"""with o as ({a.OPTIONS}), m as (select *, quantile_cont(fwd, 0.5) over (partition by day, dte) as mid from o),
b as (select day, dte, strike, row_number() over (partition by day, dte order by abs(strike - mid), strike) as r from m) select day, dte, strike, round(avg(iv), 6) as atm from o join (select day, dte, strike from b where r = 1) using (day, dte, strike) group by all""",
    "fitted_spread": f"""with q as (select *, (dte > 7)::int + (dte > 14)::int + (dte > 30)::int as bucket, (abs(delta) > 0.5)::int + (abs(delta) > 0.75)::int as tier from ({a.QUOTES}) z),
m as (select tier, bucket, round(regr_intercept(half, mid), 6) as a, round(regr_slope(half, mid), 6) as b from q group by all)
select quote, round(greatest(0.02, a + b * mid), 10) as fitted, round(greatest(round_even((mid + case when quote % 2 = 0 then 1 else -1 end * 2 * half) / 0.01, 0) * 0.01, 0.01), 2) as fill, greatest(1, floor(5000 / (mid * 100))::int) as size, round(greatest(dte * 0.65, 1), 2)::double as fee
from q left join m using (tier, bucket)""",
    "print_slots": """with e as (select time_bucket(interval 30 minutes, ts) as slot, value from events where value >= 5)
select slot, count(*) as n, round(sum(value), 4) as total from e group by 1 having slot + interval 30 minutes <= (select max(ts) from events where value >= 5) - interval 1 hour""",
}
