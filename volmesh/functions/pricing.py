"""Option pricing on a forward as column expressions inside code generation; only the search for an implied volatility is a vectorised UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Hart's rational approximation of the normal distribution function to double precision (numerator and denominator, highest power first; edges).
NUMERATOR = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
MIDDLE, FAR, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.5066282746310002
LOW, HIGH, STEPS, SETTLED = 0.001, 5.0, 60, 1e-14


def normal_density(x: Column) -> Column:
    return F.exp(-0.5 * x * x) * 0.3989422804014327


def _horner(x, coefficients):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def _tail(x, e):
    """Of |x| and exp(-x * x / 2): the distribution function at -|x|, near and far; columns or arrays."""
    near = e * _horner(x, NUMERATOR) / _horner(x, DENOMINATOR)
    return near, e / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / ROOT_TWO_PI


def normal_cdf(x: Column) -> Column:
    """Normal distribution function to about 1e-15; neither Spark nor DuckDB has one."""
    size = F.abs(x)
    near, far = _tail(size, F.exp(-0.5 * size * size))
    tail = F.when(size > FAR, 0.0).when(size < MIDDLE, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def cdf_of(x: np.ndarray) -> np.ndarray:
    """normal_cdf of an array."""
    size = np.minimum(np.abs(x), FAR)
    near, far = _tail(size, np.exp(-0.5 * size * size))
    tail = np.where(np.abs(x) > FAR, 0.0, np.where(size < MIDDLE, near, far))
    return np.where(x > 0, 1 - tail, tail)


def valued(rows: DataFrame, fwd: Column, strike: Column, years: Column, rate: float, sigma: Column, call: Column) -> DataFrame:
    """rows with price (discounted, of a call or put on a forward) and delta, gamma, vega, theta (per share, volatility point and calendar day).

    The steps are columns of their own, so that each is computed once and compiled; inlined, the code would grow beyond what Java compiles. A put is the call less parity."""
    rows = rows.withColumn("_sd", sigma * F.sqrt(years)).withColumn("_d1", F.log(fwd / strike) / F.col("_sd") + F.col("_sd") / 2).withColumn("_d2", F.col("_d1") - F.col("_sd"))
    rows = rows.withColumns({"_n1": normal_cdf(F.col("_d1")), "_n2": normal_cdf(F.col("_d2")), "_p1": normal_density(F.col("_d1"))})
    gone, put = F.exp(-rate * years), F.when(call, 0.0).otherwise(1.0)
    spot, root = fwd * gone, F.sqrt(years)
    return rows.withColumns({
        "price": gone * (fwd * F.col("_n1") - strike * F.col("_n2") - put * (fwd - strike)),
        "delta": F.col("_n1") - put,
        "gamma": F.col("_p1") / (spot * F.col("_sd")),
        "vega": spot * F.col("_p1") * root / 100,
        "theta": (-spot * F.col("_p1") * sigma / (2 * root) - rate * strike * gone * (F.col("_n2") - put)) / 365,
    }).drop("_sd", "_d1", "_d2", "_n1", "_n2", "_p1")


@F.pandas_udf(DoubleType())
def implied(value: pd.Series, fwd: pd.Series, strike: pd.Series, years: pd.Series, rate: pd.Series, call: pd.Series) -> pd.Series:
    """Volatility in [0.001, 5]; null for nulls, for prices that no volatility in there gives, at or below intrinsic value, or at no time left.

    Newton's steps inside a bracket that each step narrows; a step that leaves it is a halving. All run over a whole Arrow batch at once, prices that have settled drop out, and there are at most as many steps as halvings would take."""
    value, fwd, strike, years, rate = (x.to_numpy(float, na_value=np.nan) for x in (value, fwd, strike, years, rate))
    call = call.to_numpy(bool, na_value=False)
    with np.errstate(all="ignore"):
        grown = np.exp(rate * years)
        goal = value * grown + np.where(call, 0.0, fwd - strike)  # as an undiscounted call
        log, root = np.log(fwd / strike), np.sqrt(years)

        def worth(sigma, at):
            spread = sigma * root[at]
            upper = log[at] / spread + spread / 2
            return fwd[at] * cdf_of(upper) - strike[at] * cdf_of(upper - spread), fwd[at] * np.exp(-0.5 * upper * upper) * 0.3989422804014327 * root[at]

        fine = (years > 0) & (value * grown > np.maximum(np.where(call, fwd - strike, strike - fwd), 0)) & (goal > worth(LOW, slice(None))[0]) & (goal < worth(HIGH, slice(None))[0])
        at = np.flatnonzero(fine)
        out, low, high, sigma = np.full(len(goal), np.nan), np.full(len(at), LOW), np.full(len(at), HIGH), np.full(len(at), 0.2)
        for _ in range(STEPS):
            price, slope = worth(sigma, at)
            over = price - goal[at]
            low, high = np.where(over > 0, low, sigma), np.where(over > 0, sigma, high)
            step = sigma - over / slope
            step = np.where((step > low) & (step < high), step, (low + high) / 2)
            out[at] = step
            open_ = np.abs(step - sigma) > SETTLED * sigma
            at, low, high, sigma = at[open_], low[open_], high[open_], step[open_]
            if not len(at):
                break
    return pd.Series(out)


def price_floor(fwd: Column, strike: Column, years: Column, rate: Column, spot: Column, call: Column) -> Column:
    """The higher of the discounted and the exercise-now intrinsic value, at least 0."""
    sign = F.when(call, 1).otherwise(-1)
    return F.greatest(F.exp(-rate * years) * sign * (fwd - strike), sign * (spot - strike), F.lit(0.0))
