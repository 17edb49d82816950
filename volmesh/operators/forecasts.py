"""Volatility forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ols(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """keys, n, intercept, and a coefficient b_x for each x: least squares for each group.

    One aggregation (map-side sums) finds means and covariances; elimination then works on one row a group. Rows with a null anywhere leave first; a regressor without variance of its own makes the group's coefficients null.
    """
    rows = rows.where(" and ".join(f"{c} is not null" for c in [y, *xs]))
    pairs = [(p, q) for i, p in enumerate(xs) for q in [*xs[i:], y]]
    means = [f"_{c}" for c in [y, *xs]]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_{c}") for c in [y, *xs]], *[F.covar_pop(p, q).alias(f"_{p}_{q}") for p, q in pairs])
    at = lambda p, q: F.col(f"_{p}_{q}")
    out = out.select(*keys, "n", *means, *[at(*((p, q) if (p, q) in pairs else (q, p))).alias(f"_{p}_{q}") for p in xs for q in [*xs, y]])
    for i, x in enumerate(xs):
        left = [*xs[i + 1 :], y]
        out = out.select(*keys, "n", *means, *[at(p, q) for p in xs for q in [x, *left] if p != x], *[F.try_divide(at(x, q), at(x, x)).alias(f"_{x}_{q}") for q in left])
        out = out.select(*keys, "n", *means, *[(at(p, q) - at(p, x) * at(x, q) if p != x else at(p, q)).alias(f"_{p}_{q}") for p in xs for q in left])
    fit = F.col(f"_{y}") - sum((at(x, y) * F.col(f"_{x}") for x in xs), F.lit(0.0))
    return out.select(*keys, "n", fit.alias("intercept"), *[at(x, y).alias(f"b_{x}") for x in xs])


def qlike(actual: Column, forecast: Column) -> Column:
    ratio = F.pow(actual / forecast, 2)
    return ratio - F.log(ratio) - 1


def losses(scored: DataFrame) -> DataFrame:
    """Mean and median loss, median bias in points and count by name and fold, and over all folds (fold null)."""
    return scored.groupingSets([["name", "fold"], ["name"]], "name", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"), F.expr("percentile(loss, 0.5)").alias("median_loss"), F.expr("percentile(bias, 0.5)").alias("median_bias"))


def newey_west(gaps: DataFrame, keys: list[str], order: str, value: str, lags: int = 22) -> DataFrame:
    """keys, n, mean, se, t: the standard error of a mean under autocorrelation up to `lags`, with falling weights; t is null at an error of 0."""
    w = Window.partitionBy(*keys)
    rows = gaps.where(F.col(value).isNotNull()).withColumn("_g", F.col(value) - F.avg(value).over(w))
    by = w.orderBy(order)
    near = sum((2 * (1 - k / (lags + 1)) * F.coalesce(F.lag("_g", k).over(by), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    rows = rows.withColumn("_v", F.col("_g") * (F.col("_g") + near))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sqrt(F.greatest(F.avg("_v"), F.lit(0.0)) / F.count(F.lit(1))).alias("se"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("mean") / F.col("se")))


def bias_corrected(forecasts: DataFrame, keys: list[str], horizon: int = 22, years: int = 252) -> DataFrame:
    """forecasts with `corrected`: the forecast times the exponential of the median log error of the last `years` rows whose target had ended; uncorrected without any."""
    frame = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(horizon + years), -(horizon + 1))
    rows = forecasts.withColumn("_e", F.log(F.col("target") / F.col("forecast")))
    return rows.withColumn("corrected", F.col("forecast") * F.exp(F.coalesce(F.expr("percentile(_e, 0.5)").over(frame), F.lit(0.0)))).drop("_e")


def rescored(days: DataFrame, fit: DataFrame, keys: list[str], xs: list[str], lowest: float) -> DataFrame:
    """days with vol: a fit (ols, of variances in 1e-4) scored on any later day without fitting again, annualised, at least `lowest`. Days with an unknown regressor leave."""
    known = days.where(" and ".join(f"{x} is not null" for x in xs)).join(fit.select(*keys, "intercept", *[f"b_{x}" for x in xs]), keys)
    var = sum((F.col(f"b_{x}") * F.col(x) for x in xs), F.col("intercept")) / 1e4
    return known.withColumn("vol", F.sqrt(252 * F.greatest(var, F.lit(lowest * lowest / 252)))).drop("intercept", *[f"b_{x}" for x in xs])
