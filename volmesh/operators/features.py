"""Daily features: returns, range-based variance, lags, trend, term structure, percentile rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_day(*keys: str):
    return Window.partitionBy(*keys).orderBy("date")


def full(column: Column, w, n: int) -> Column:
    """Mean of the last n values; null until there are n."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))


def daily_features(bars: DataFrame, indices: DataFrame) -> DataFrame:
    """symbol, date, ret, bad, rv, rv_d, rv_w, rv_m, above50, above200, vix, term, vix_pct, irx. Indices are carried forward to days without them; a rank needs 252 days."""
    w = by_day("symbol")
    span = F.log(F.col("high") / F.col("low"))
    before = w.rowsBetween(-22, -1)
    rows = bars.withColumn("ret", F.log(F.col("close") / F.lag("close").over(w))).withColumn("_hl", span)
    usual = F.when(F.count("_hl").over(before) >= 5, F.expr("percentile(_hl, 0.5)").over(before))
    rows = rows.withColumn("bad", F.coalesce(F.col("_hl") > 20 * usual, F.lit(False)))
    gk = 0.5 * F.col("_hl") * F.col("_hl") - 0.38629436111989061 * F.pow(F.log(F.col("close") / F.col("open")), 2)
    rows = rows.withColumn("rv", F.when(F.col("bad"), F.col("ret") * F.col("ret")).otherwise(gk))
    rows = rows.withColumns({"rv_d": F.col("rv"), "rv_w": full(F.col("rv"), w, 5), "rv_m": full(F.col("rv"), w, 22), "_ma": full(F.col("close"), w, 50), "_ma200": full(F.col("close"), w, 200)})
    rows = rows.join(indices.select("date", "vix", "vix3m", "irx"), "date", "left")
    carried = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(carried) for c in ("vix", "vix3m", "irx")})
    year = w.rowsBetween(-251, 0)
    rows = rows.withColumn("_year", F.collect_list("vix").over(year))
    rank = (F.size(F.filter("_year", lambda x: x < F.col("vix"))) + (F.size(F.filter("_year", lambda x: x == F.col("vix"))) + 1) / 2) / 252
    r6 = lambda c: F.round(c, 6)
    return rows.select(
        "symbol", "date", r6(F.col("ret")).alias("ret"), "bad", *[r6(F.col(c) * 1e4).alias(c) for c in ("rv", "rv_d", "rv_w", "rv_m")], F.when(F.col("_ma").isNotNull(), F.col("close") > F.col("_ma")).alias("above50"),
        F.when(F.col("_ma200").isNotNull(), F.col("close") > F.col("_ma200")).alias("above200"), r6(F.col("irx")).alias("irx"),
        r6(F.col("vix")).alias("vix"), r6(F.col("vix") / F.col("vix3m")).alias("term"), r6(F.when(F.size("_year") == 252, rank)).alias("vix_pct"),
    )


def forward_target(bars: DataFrame, horizon: int) -> DataFrame:
    """Annualised volatility of the next `horizon` returns; null where there are fewer."""
    w = by_day("symbol")
    rows = bars.withColumn("ret", F.log(F.col("close") / F.lag("close").over(w)))
    ahead = w.rowsBetween(1, horizon)
    value = F.sqrt(252 * F.avg(F.col("ret") * F.col("ret")).over(ahead))
    return rows.select("symbol", "date", F.round(F.when(F.count("ret").over(ahead) == horizon, value), 6).alias("target"))


def moving_averages(bars: DataFrame, lengths: list[int]) -> DataFrame:
    """symbol, date, and ma_n and above_n for each length: the mean of the last n closes, null under n, and whether the close is above it."""
    w = by_day("symbol")
    mean = lambda n: F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) == n, F.avg("close").over(w.rowsBetween(1 - n, 0)))
    rows = bars.select("symbol", "date", "close", *[mean(n).alias(f"ma_{n}") for n in lengths])
    return rows.select("symbol", "date", *[c for n in lengths for c in (F.col(f"ma_{n}"), (F.col("close") > F.col(f"ma_{n}")).alias(f"above_{n}"))])


def trend_measures(daily: DataFrame, k: float = 0.5) -> DataFrame:
    """From daily features: 5 and 20-day returns, 5-day index change, efficiency of the 10 days before, a year's beta of index changes on returns (0 under 21 pairs), and a size tilt by the index rank."""
    w = by_day("symbol")
    rows = daily.withColumn("_dv", F.col("vix") - F.lag("vix").over(w))
    total = lambda n: F.when(F.count("ret").over(w.rowsBetween(1 - n, 0)) == n, F.sum("ret").over(w.rowsBetween(1 - n, 0)))
    ten, year = w.rowsBetween(-10, -1), w.rowsBetween(-251, 0)
    path = F.sum(F.abs("ret")).over(ten)
    both = F.when(F.col("_dv").isNotNull(), F.col("ret"))
    pairs, spread = F.count(F.col("ret") * F.col("_dv")).over(year), F.var_samp(both).over(year)
    beta = F.when((pairs < 21) | (spread == 0), 0.0).otherwise(F.covar_samp("_dv", "ret").over(year) / spread)
    return rows.select(
        "symbol", "date", F.round(total(5), 6).alias("ret5"), F.round(total(20), 6).alias("ret20"), F.round(F.col("vix") - F.lag("vix", 5).over(w), 6).alias("vix5"),
        F.round(F.when((F.count("ret").over(ten) == 10) & (path > 0), F.abs(F.sum("ret").over(ten)) / path), 6).alias("efficiency"), F.round(beta, 4).alias("beta"), F.round(1 + k * (2 * F.col("vix_pct") - 1), 6).alias("tilt"),
    )
