"""Models fitted over time: iterated and walk-forward regressions, a grid of GARCH(1,1), pooled spread fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def iterate_har(rows: DataFrame, past: str, c: dict[str, Column], horizon: int, least: float) -> DataFrame:
    """rows with `forecast`: the mean of `horizon` one-step forecasts, each from the last value, the mean of the last 5 and the mean of the last 22, where each step's forecast (at least `least`) joins the history. `past` is an array of 22 values, the oldest first."""
    mean = lambda x, n: F.aggregate(F.slice(x, -n, n), F.lit(0.0), lambda s, v: s + v) / n

    def step(h: Column, _: Column) -> Column:
        return F.concat(h, F.array(F.greatest(c["intercept"] + c["d"] * F.element_at(h, -1) + c["w"] * mean(h, 5) + c["m"] * mean(h, 22), F.lit(least))))

    return rows.withColumn("forecast", mean(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col(past), step), horizon))


def walk_forward(rows: DataFrame, keys: list[str], y: str, a: str, b: str, months: int, gap: int) -> DataFrame:
    """keys, month (year * 12 + month), n, intercept, ba, bb: for each month the least squares of y on a and b over the `months` months that end `gap` months before it.

    Sums of products are additive: they are taken by month first, and a fit adds up the months of its window; no row is sent to more than one place.
    """
    vs = {"y": F.col(y), "a": F.col(a), "b": F.col(b)}
    prods = {p: vs[p[0]] * vs[p[1]] for p in ("aa", "ab", "bb", "ay", "by")}
    month = (F.year("date") * 12 + F.month("date")).alias("month")
    full = rows.groupBy(*keys, month).agg(*[F.sum(F.when(sum(vs.values()).isNotNull(), v)).alias(f"_{k}") for k, v in {**vs, **prods}.items()], F.count(sum(vs.values())).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("month").rangeBetween(1 - months - gap, -gap)
    s = {k: F.col(f"_t{k}") for k in ("n", *vs, *prods)}
    out = full.select(*keys, "month", *[F.sum(f"_{k}").over(w).alias(f"_t{k}") for k in s])
    m = {p: s[p] / s["n"] - s[p[0]] / s["n"] * s[p[1]] / s["n"] for p in prods}
    det = m["aa"] * m["bb"] - m["ab"] * m["ab"]
    ba, bb = (m["ay"] * m["bb"] - m["by"] * m["ab"]) / det, (m["by"] * m["aa"] - m["ay"] * m["ab"]) / det
    return out.where("_tn >= 60").select(*keys, "month", F.col("_tn").alias("n"), ((s["y"] - ba * s["a"] - bb * s["b"]) / s["n"]).alias("intercept"), ba.alias("ba"), bb.alias("bb"))


#: The grid of (alpha, beta).
GRID = [(x, y) for x in (0.04, 0.08, 0.12, 0.16) for y in (0.78, 0.82, 0.86, 0.9) if x + y < 0.99]


def garch_windows(returns: DataFrame, length: int) -> DataFrame:
    """symbol, date, _x, _v: on the first day of each month the last `length` returns and their variance around zero."""
    w = Window.partitionBy("symbol").orderBy("date")
    rows = returns.where("ret is not null").withColumns({"_x": F.collect_list("ret").over(w.rowsBetween(1 - length, 0)), "_first": F.coalesce(F.trunc("date", "MM") != F.trunc(F.lag("date").over(w), "MM"), F.lit(True))})
    return rows.where(F.col("_first") & (F.size("_x") == length)).select("symbol", "date", "_x", (F.aggregate("_x", F.lit(0.0), lambda s, x: s + x * x) / length).alias("_v"))


def garch_monthly(returns: DataFrame, length: int, horizon: int) -> DataFrame:
    """symbol, date, alpha, beta, vol: on the first day of each month, of the grid the GARCH(1,1) with the highest likelihood of the last `length` returns, at the variance of that window, and its mean variance over the horizon, annualised.

    Points of the grid are rows, so fits run side by side; a window is an array of fixed length. garch_fit finds the optimum; this is what it starts from.
    """
    rows = garch_windows(returns, length).select("*", F.explode(F.array(*[F.struct(F.lit(x).alias("alpha"), F.lit(y).alias("beta")) for x, y in GRID])).alias("_g")).select("symbol", "date", "_x", "_v", "_g.*")
    alpha, beta, v = F.col("alpha"), F.col("beta"), F.col("_v")

    def step(s: Column, x: Column) -> Column:
        return F.struct((s["l"] - F.log(s["h"]) - x * x / s["h"]).alias("l"), (v * (1 - alpha - beta) + alpha * x * x + beta * s["h"]).alias("h"))

    fits = rows.withColumn("_s", F.aggregate("_x", F.struct(F.lit(0.0).alias("l"), v.alias("h")), step))
    best = fits.groupBy("symbol", "date").agg(F.max_by(F.struct("alpha", "beta", "_v", F.col("_s.h").alias("h")), F.struct(F.round("_s.l", 6), -alpha, -beta)).alias("_b"))
    p = F.col("_b.alpha") + F.col("_b.beta")
    mean = F.col("_b._v") + (F.col("_b.h") - F.col("_b._v")) * (1 - F.pow(p, horizon)) / (horizon * (1 - p))
    return best.select("symbol", "date", F.col("_b.alpha").alias("alpha"), F.col("_b.beta").alias("beta"), F.sqrt(252 * mean).alias("vol"))


def _likelihood(theta: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(minus the log-likelihood, variance after the last return) of windows x (a row each) at theta (a row each): log omega over v, log odds of alpha + beta, log odds of alpha's part of it."""
    theta = np.clip(theta, -40, 40)
    p = 0.9999 / (1 + np.exp(-theta[:, 1]))
    alpha = p / (1 + np.exp(-theta[:, 2]))
    omega, beta = v * np.exp(theta[:, 0]), p - alpha
    h, total = v.copy(), np.zeros(len(v))
    for r in x.T:
        total += np.log(h) + r * r / h
        h = omega + alpha * r * r + beta * h
    return 0.5 * total, h


def maximise(x: np.ndarray, v: np.ndarray, most: int = 600, near: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(omega, alpha, beta of each window, log-likelihoods, next variances): a simplex search of every window at once, from the best point of the grid, until all have converged. A step moves each window's worst corner by reflection, expansion or
    contraction, or shrinks its simplex; windows that stand still are left out."""
    n = len(v)
    odds = lambda q: np.log(q / (1 - q))
    grid = [np.tile([np.log(1 - a - b), odds((a + b) / 0.9999), odds(a / (a + b))], (n, 1)) for a, b in GRID]
    scores = np.array([_likelihood(g, x, v)[0] for g in grid])
    start = np.array(grid)[scores.argmin(0), np.arange(n)]
    corner = np.stack([start, *[start + d for d in 0.5 * np.eye(3)]], 1)  # windows x 4 x 3
    value = np.stack([_likelihood(corner[:, i], x, v)[0] for i in range(4)], 1)
    live = np.arange(n)
    for _ in range(most):
        order = np.argsort(value[live], 1)
        c, f, r, s = np.take_along_axis(corner[live], order[:, :, None], 1), np.take_along_axis(value[live], order, 1), x[live], v[live]
        centre, worst = c[:, :3].mean(1), c[:, 3]
        at = lambda k: centre + k * (centre - worst)
        tries = {k: (at(k), _likelihood(at(k), r, s)[0]) for k in (1.0, 2.0, 0.5, -0.5)}
        one = tries[1.0][1]
        kind = np.where(one < f[:, 0], np.where(tries[2.0][1] < one, 2.0, 1.0), np.where(one < f[:, 2], 1.0, np.where(one < f[:, 3], 0.5, -0.5)))
        best_c, best_f = worst.copy(), f[:, 3].copy()
        for k, (where, score) in tries.items():
            mine = kind == k
            best_c[mine], best_f[mine] = where[mine], score[mine]
        shrink = best_f >= f[:, 3]
        c[:, 3], f[:, 3] = np.where(shrink[:, None], worst, best_c), np.where(shrink, f[:, 3], best_f)
        if shrink.any():
            c[shrink, 1:] = c[shrink, :1] + 0.5 * (c[shrink, 1:] - c[shrink, :1])
            for i in (1, 2, 3):
                f[shrink, i] = _likelihood(c[shrink, i], r[shrink], s[shrink])[0]
        corner[live], value[live] = c, f
        live = live[(np.ptp(f, 1) > near) | (np.ptp(c, 1).max(1) > 1e-5)]
        if not len(live):
            break
    theta = np.clip(corner[np.arange(n), value.argmin(1)], -40, 40)
    low, h = _likelihood(theta, x, v)
    p = 0.9999 / (1 + np.exp(-theta[:, 1]))
    alpha = p / (1 + np.exp(-theta[:, 2]))
    return np.stack([v * np.exp(theta[:, 0]), alpha, p - alpha], 1), -low, h


def garch_fit(windows: DataFrame, horizon: int) -> DataFrame:
    """symbol, date, omega, alpha, beta, likelihood, vol of windows (garch_windows): the GARCH(1,1) of the highest likelihood, from the window's variance on, and its mean variance over the horizon, annualised. An Arrow batch of windows is one array, and all
    of its searches go on side by side. A window of zeros has no parameters."""

    def run(frames):
        for f in frames:
            if len(f):
                x, v = np.stack(f["_x"].to_list()).astype(float), f["_v"].to_numpy(float)
                found, low, h = np.full((len(f), 3), np.nan), np.full(len(f), np.nan), np.full(len(f), np.nan)
                fine = v > 0
                if fine.any():
                    found[fine], low[fine], h[fine] = maximise(x[fine], v[fine])
                yield pd.DataFrame({"symbol": f["symbol"], "date": f["date"], "omega": found[:, 0], "alpha": found[:, 1], "beta": found[:, 2], "likelihood": low, "_h": h})

    fits = windows.select("symbol", "date", "_x", "_v").mapInPandas(run, "symbol string, date date, omega double, alpha double, beta double, likelihood double, _h double")
    p = F.col("alpha") + F.col("beta")
    long = F.col("omega") / (1 - p)
    mean = long + (F.col("_h") - long) * (1 - F.pow(p, horizon)) / (horizon * (1 - p))
    return fits.select("symbol", "date", "omega", "alpha", "beta", "likelihood", F.sqrt(252 * mean).alias("vol"))


def save_model(fit: DataFrame, meta: dict, folder: str) -> None:
    """A model of a row a key, with what is known of it as a whole (one value each) as columns, as a table."""
    fit.withColumn("_meta", F.create_map(*[F.lit(str(x)) for k, v in meta.items() for x in (k, v)])).coalesce(1).write.mode("overwrite").parquet(folder)


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, str]]:
    """(the rows, what is known of the whole) of a stored model; an empty one is an error."""
    rows = spark.read.parquet(folder)
    first = rows.select("_meta").first()
    if first is None:
        raise ValueError(f"no model in {folder}")
    return rows.drop("_meta"), dict(first[0])


def pooled_spread(quotes: DataFrame, least: int) -> DataFrame:
    """tier, bucket, n, a, b: half-spread on mid by tier and bucket; a tier of which a bucket has under `least` quotes has one line for all its buckets. Both fits come from one pass and one small table."""
    fits = quotes.groupingSets([["tier", "bucket"], ["tier"]], "tier", "bucket").agg(F.grouping("bucket").alias("_all"), F.count(F.lit(1)).alias("n"), F.regr_intercept("half", "mid").alias("a"), F.regr_slope("half", "mid").alias("b"))
    w = Window.partitionBy("tier")
    fits = fits.withColumns({"_thin": F.min(F.when(F.col("_all") == 0, F.col("n"))).over(w) < least, "_pool": F.max(F.when(F.col("_all") == 1, F.struct("a", "b"))).over(w)})
    return fits.where("_all = 0").select("tier", "bucket", "n", *[F.when(F.col("_thin"), F.col(f"_pool.{c}")).otherwise(F.col(c)).alias(c) for c in "ab"])


def spread_quality(quotes: DataFrame, model: DataFrame, floor: float) -> DataFrame:
    """tier, bucket, n, mean_half, median_half, mean_fitted, median_error of quotes against a model of few rows."""
    fitted = F.greatest(F.lit(floor), F.col("a") + F.col("b") * F.col("mid"))
    rows = quotes.join(model.select("tier", "bucket", "a", "b"), ["tier", "bucket"]).withColumn("_f", fitted)
    return rows.groupBy("tier", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("half").alias("mean_half"), F.avg("_f").alias("mean_fitted")).join(_median(rows, "half", "median_half"), ["tier", "bucket"]).join(_median(rows.withColumn("_off", F.abs(F.col("half") - F.col("_f"))), "_off", "median_error"), ["tier", "bucket"])


def _median(rows: DataFrame, value: str, name: str) -> DataFrame:
    return quantiles(rows, ["tier", "bucket"], value, [0.5]).withColumnRenamed("q0", name)
