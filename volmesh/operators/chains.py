"""Quote snapshots and contract universes: cleaning, guards, choices of expiry and strike, structures, day features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing


def clean_quotes(chain: DataFrame) -> DataFrame:
    """Prices that are not positive become null; `mid` is the middle of bid and ask, else the last price."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = chain.withColumns({c: positive(c) for c in ("bid", "ask", "last")})
    return rows.withColumn("mid", F.coalesce((F.col("bid") + F.col("ask")) / 2, F.col("last")))


def covered(chain: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Rows of snapshots of which at least `share` have an implied volatility."""
    good = chain.groupBy(*keys).agg(F.avg(F.col("iv").isNotNull().cast("double")).alias("_s")).where(F.col("_s") >= share)
    return chain.join(good.select(*keys), keys, "left_semi")


def tradable(chain: DataFrame) -> DataFrame:
    """Two-sided quotes that are not crossed, with a delta."""
    return chain.where("bid > 0 and ask > bid and delta is not null")


def listed(chain: DataFrame, low: int, high: int, reach: float) -> DataFrame:
    return chain.where(F.col("dte").between(low, high) & (F.abs(F.log(F.col("strike") / F.col("fwd"))) <= reach))


def recent_universe(seen: DataFrame, contract: list[str], days: int = 5) -> DataFrame:
    """day, contract, today, recent: contracts of a day and those of the `days` distinct days before it that had any.

    A contract is sent to the few days on which it counts, and rows meet by day and contract: no range join. Days are numbered over one row a day.
    """
    rows = seen.select("day", *contract).distinct()
    number = rows.select("day").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day")))
    sent = rows.join(number, "day").select(*contract, F.posexplode(F.sequence(F.col("_i"), F.col("_i") + days)).alias("_p", "_i"))
    flags = sent.groupBy("_i", *contract).agg(F.bool_or(F.col("_p") == 0).alias("today"), F.bool_or(F.col("_p") > 0).alias("recent"))
    return flags.join(number, "_i").select("day", *contract, "today", "recent")


def pick_expiry(chain: DataFrame, keys: list[str], low: int, high: int, target: int) -> DataFrame:
    """The days to expiry within [low, high] nearest to the target, of equals the fewer."""
    return chain.where(F.col("dte").between(low, high)).groupBy(*keys).agg(F.min_by("dte", F.struct(F.abs(F.col("dte") - target), F.col("dte"))).alias("dte"))


def pick_strike(chain: DataFrame, keys: list[str]) -> DataFrame:
    """The strike with a mid nearest to the median forward of the group, of equals the lower."""
    spot = chain.groupBy(*keys).agg(F.expr("percentile(fwd, 0.5)").alias("_spot"))
    return chain.where("mid is not null").join(spot, keys).groupBy(*keys).agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("_spot")), F.col("strike"))).alias("strike"))


def by_delta(chain: DataFrame, keys: list[str], targets: list[float], call: bool) -> DataFrame:
    """keys, target, strike, delta, iv, mid: for each target the option whose absolute delta is nearest (then the lower strike, then the later print), one aggregate a target."""
    rows = chain.where((F.col("call") == F.lit(call)) & F.col("delta").isNotNull())
    best = lambda t: F.min_by(F.struct("strike", "delta", "iv", "mid"), F.struct(F.abs(F.abs("delta") - t), F.col("strike"), -F.col("event_id")))
    wide = rows.groupBy(*keys).agg(*[best(t).alias(f"_{i}") for i, t in enumerate(targets)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_{i}").alias("o")) for i, t in enumerate(targets)])).alias("_e")
    return wide.select(*keys, each).select(*keys, "_e.target", "_e.o.*")


#: name: legs of (call, target delta, signed ratio).
STRUCTURES = {
    "put": [(False, 0.25, -1)],
    "strangle": [(False, 0.25, -1), (True, 0.25, -1)],
    "straddle": [(False, 0.5, -1), (True, 0.5, -1)],
    "condor": [(False, 0.25, -1), (False, 0.1, 1), (True, 0.25, -1), (True, 0.1, 1)],
}


def structures(chain: DataFrame, keys: list[str], table: dict[str, list[tuple]] | None = None) -> DataFrame:
    """keys, structure, legs, net: the signed sum of mids of a structure's legs, null where a leg has none."""
    table = table or STRUCTURES
    targets = sorted({t for legs in table.values() for _, t, _ in legs})
    options = by_delta(chain, keys, targets, True).withColumn("call", F.lit(True)).unionByName(by_delta(chain, keys, targets, False).withColumn("call", F.lit(False)))
    price = lambda c, t: F.max(F.when((F.col("call") == F.lit(c)) & (F.col("target") == t), F.col("mid")))
    net = lambda legs: sum((ratio * price(c, t) for c, t, ratio in legs), F.lit(0.0))
    wide = options.groupBy(*keys).agg(*[net(legs).alias(f"_{n}") for n, legs in table.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("structure"), F.lit(len(legs)).alias("legs"), F.col(f"_{n}").alias("net")) for n, legs in table.items()])).alias("_e")
    return wide.select(*keys, each).select(*keys, "_e.*")


def surface_features(chain: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """keys, dte, iv25, iv10, skew, wing, slope, from puts of the nearest expiry of at least `least` days; slope: mean iv of the farthest expiry less that of the nearest."""
    rows = chain.where(F.col("dte") >= least)
    near = rows.groupBy(*keys).agg(F.min("dte").alias("dte"))
    means = rows.groupBy(*keys, "dte").agg(F.avg("iv").alias("_iv")).groupBy(*keys).agg((F.max_by("_iv", "dte") - F.min_by("_iv", "dte")).alias("slope"))
    puts = by_delta(rows.where("iv is not null").join(near, [*keys, "dte"], "left_semi"), [*keys, "dte"], [0.5, 0.25, 0.1], False)
    at = lambda t: F.max(F.when(F.col("target") == t, F.col("iv")))
    iv = puts.groupBy(*keys, "dte").agg(at(0.25).alias("iv25"), at(0.1).alias("iv10"), (at(0.25) - at(0.5)).alias("skew"), (at(0.1) - at(0.25)).alias("wing"))
    return iv.join(means, keys)


def stress_quantity(rows: DataFrame, name: str, budget: float, least: float, k: float) -> DataFrame:
    """rows (net, delta, gamma, move) with `name`: the most contracts n whose crash loss and unhedged gap fit the budget, 0 if none: n * net + min(band, n * delta) * move <= budget, with band = max(least, k * sqrt(n * gamma)), delta and
    gamma for 100. Without a loss (net <= 0) nothing is sold.

    The cost grows with n, and is under the budget if it is with either side of the minimum; each side is solved for n, the band's root as a quadratic in sqrt(n). The whole number is then checked, as
    roots are rounded. Steps are columns, so that each is computed once."""
    loss, move, delta, gamma = F.col("net"), F.col("move"), F.abs("delta") * 100, F.col("_gamma")
    net = F.when(loss > 0, loss)
    rows = rows.withColumn("_gamma", F.abs("gamma") * 100).withColumn("_c", F.col("move") * k * F.sqrt("_gamma"))
    rows = rows.withColumn("_root", (F.sqrt(F.col("_c") * F.col("_c") + 4 * net * budget) - F.col("_c")) / (2 * net))
    rows = rows.withColumn("_n", F.floor(F.greatest(budget / (net + move * delta), F.least((budget - move * least) / net, F.col("_root") * F.col("_root")))))
    cost = lambda n: n * net + F.least(F.greatest(F.lit(least), k * F.sqrt(n * gamma)), n * delta) * move
    rows = rows.withColumns({"_this": cost(F.col("_n")) <= budget, "_more": cost(F.col("_n") + 1) <= budget})
    n = F.greatest(F.when(F.col("_more"), F.col("_n") + 1).when(F.col("_this"), F.col("_n")).otherwise(F.col("_n") - 1), F.lit(0))
    return rows.withColumn(name, F.when(loss > 0, n).otherwise(0).cast("int")).drop("_gamma", "_c", "_root", "_n", "_this", "_more")


def stressed(chain: DataFrame, rate: float, drop: float, vol: float, mult: float) -> DataFrame:
    """Quotes with a volatility, their greeks, spot, `move` (what a crash of `drop` takes off the spot) and `net`: what a sold put loses in it after its hedge, for 100, at the higher of `vol` and `mult` times its volatility, undiscounted."""
    rows = pricing.valued(chain.where("iv is not null"), F.col("fwd"), F.col("strike"), F.col("years"), rate, F.col("iv"), F.col("call")).withColumnRenamed("price", "value")
    rows = rows.withColumn("spot", F.col("fwd") * F.exp(-rate * F.col("years"))).withColumn("move", drop * F.col("spot"))
    keep = {c: f"_{c}" for c in ("delta", "gamma", "vega", "theta")}
    rows = pricing.valued(rows.withColumnsRenamed(keep), F.col("spot") - F.col("move"), F.col("strike"), F.col("years"), 0.0, F.greatest(F.lit(vol), mult * F.col("iv")), F.col("call")).drop(*keep)
    return rows.withColumnsRenamed({v: k for k, v in keep.items()}).withColumn("net", (F.col("price") - F.col("mid")) * 100 - F.abs("delta") * 100 * F.col("move")).drop("price")


def conservative_mark(mid: Column, last: Column, intrinsic: Column, short: Column) -> Column:
    """The mid; without one, a short takes the higher of the last mark and intrinsic value, a long the lower."""
    return F.coalesce(mid, F.when(short, F.greatest(last, intrinsic)).otherwise(F.least(last, intrinsic)))


def hedge_band(gamma: Column, least: float, k: float) -> Column:
    return F.greatest(F.lit(least), k * F.sqrt(gamma))


def candidate_features(chain: DataFrame, keys: list[str], targets: list[float], budget: float, least: float, k: float) -> DataFrame:
    """keys, target, skip, strike, size, iv, iv_rel (against the volatility at the money), moneyness, premium, spread and the credit, vega, theta and gamma of the position as shares of the budget, of the put nearest to each delta target in
    a stressed chain, and a skip row for each group. Size is what the crash budget bears."""
    puts = chain.where(~F.col("call") & F.col("delta").isNotNull())
    cols = ["strike", "spot", "mid", "bid", "ask", "iv", "delta", "gamma", "vega", "theta", "net", "move"]
    best = lambda t: F.min_by(F.struct(*cols), F.struct(F.abs(F.abs("delta") - t), F.col("strike"), -F.col("event_id")))
    wide = puts.groupBy(*keys).agg(F.min_by("iv", F.struct(F.abs(F.log(F.col("strike") / F.col("fwd"))), F.col("strike"), F.col("event_id"))).alias("_atm"), *[best(t).alias(f"_{i}") for i, t in enumerate(targets)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"_{i}").alias("o")) for i, t in enumerate(targets)])).alias("_e")
    got = wide.select(*keys, "_atm", each).select(*keys, "_atm", "_e.target", "_e.o.*")
    got = stress_quantity(got, "size", budget, least, k)
    share = lambda c: F.col("size") * c / budget
    out = {
        "strike": F.col("strike"), "size": F.col("size"), "iv": F.col("iv"), "iv_rel": F.col("iv") - F.col("_atm"), "moneyness": F.log(F.col("strike") / F.col("spot")), "premium": F.col("mid") / F.col("spot"),
        "spread": F.when(F.col("mid") > 0, (F.col("ask") - F.col("bid")) / F.col("mid")), "credit_budget": share(F.col("mid") * 100), "vega_budget": share(F.col("vega") * 100), "theta_budget": share(F.col("theta") * 100),
        "gamma_budget": share(F.abs("gamma") * F.col("spot") * F.col("spot")),
    }
    none = F.lit(None).cast("double")
    skips = wide.select(*keys, none.alias("target"), F.lit(True).alias("skip"), *[(F.lit(None).cast("int") if n == "size" else none).alias(n) for n in out])
    return got.select(*keys, "target", F.lit(False).alias("skip"), *[c.alias(n) for n, c in out.items()]).union(skips)


def iv_at_delta(chain: DataFrame, keys: list[str], targets: list[float]) -> DataFrame:
    """keys and iv_25 and so on: the volatility of puts at an absolute delta, on the line between the nearest deltas below and above it (null without both). Conditional extremes in one aggregation find both."""
    rows = chain.where(~F.col("call") & F.col("delta").isNotNull() & F.col("iv").isNotNull()).groupBy(*keys, F.abs("delta").alias("_d")).agg(F.avg("iv").alias("_v"))
    found = rows.groupBy(*keys).agg(*[x for i, t in enumerate(targets) for x in (F.max(F.when(F.col("_d") <= t, F.struct("_d", "_v"))).alias(f"_lo{i}"), F.min(F.when(F.col("_d") >= t, F.struct("_d", "_v"))).alias(f"_hi{i}"))])

    def at(i: int, t: float) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(lo["_d"] == hi["_d"], lo["_v"]).otherwise(lo["_v"] + (hi["_v"] - lo["_v"]) * (t - lo["_d"]) / (hi["_d"] - lo["_d"]))

    return found.select(*keys, *[at(i, t).alias(f"iv_{round(t * 100)}") for i, t in enumerate(targets)])
