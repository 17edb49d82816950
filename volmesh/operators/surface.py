"""Forwards and volatility smiles from option prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rolling_median(column: str, w, rows: int, least: int | Column) -> Column:
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(column).over(frame) >= least, F.expr(f"percentile({column}, 0.5)").over(frame))


def _parabola(rows: DataFrame, keys: list[str]) -> DataFrame:
    """a0, a1, a2 of the size-weighted parabola of iv in k for each group, from sums of powers in one pass."""
    w, k, v = F.col("size"), F.col("k"), F.col("iv")
    s = rows.groupBy(*keys).agg(
        *[F.sum(w * F.pow(k, p)).alias(f"s{p}") for p in range(5)], *[F.sum(w * v * F.pow(k, p)).alias(f"t{p}") for p in range(3)],
        F.count(F.lit(1)).alias("n"), F.countDistinct("strike").alias("strikes"), F.min("k").alias("kmin"), F.max("k").alias("kmax"),
    )
    c = {x: F.col(x) for x in s.columns}
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    a = [[c[f"s{i + j}"] for j in range(3)] for i in range(3)]
    with_t = lambda col: [[c[f"t{i}"] if j == col else a[i][j] for j in range(3)] for i in range(3)]
    whole = det(a)
    return s.select(*keys, "n", "strikes", "kmin", "kmax", *[F.when(whole > 1e-18, det(with_t(j)) / whole).alias(f"a{j}") for j in range(3)])


def smile_at(k: Column, a0: Column, a1: Column, a2: Column) -> Column:
    return a0 + k * (a1 + k * a2)


def smiles(prints: DataFrame, keys: list[str], trades: int = 10, strikes: int = 5, reach: float = 0.3, inside: float = 0.05, trim: float = 3.0) -> DataFrame:
    """keys, a0, a1, a2, kmin, kmax, n: a parabola for each group of prints, fitted again without prints beyond `trim` robust deviations.

    A group counts if it has enough trades and strikes before and after the trim, spans k = 0 and stays above 0.001 at 21 points of its range.
    """
    rows = prints.where(F.col("iv").isNotNull() & (F.abs("k") <= reach) & F.when(F.col("call"), F.col("k") >= -inside).otherwise(F.col("k") <= inside))
    enough = (F.col("n") >= trades) & (F.col("strikes") >= strikes) & F.col("a0").isNotNull()
    first = _parabola(rows, keys).where(enough).select(*keys, "a0", "a1", "a2")
    off = rows.join(first, keys).withColumn("_off", F.abs(F.col("iv") - smile_at(F.col("k"), F.col("a0"), F.col("a1"), F.col("a2")))).drop("a0", "a1", "a2")
    usual = off.groupBy(*keys).agg(F.expr("percentile(_off, 0.5)").alias("_usual"))
    kept = off.join(usual, keys).where(F.col("_off") <= trim * 1.4826 * F.col("_usual") + 1e-4)
    fitted = _parabola(kept, keys).where(enough & (F.col("kmin") <= 0) & (F.col("kmax") >= 0))
    point = lambda i: smile_at(F.col("kmin") + (F.col("kmax") - F.col("kmin")) * i / 20, F.col("a0"), F.col("a1"), F.col("a2")) > 0.001
    return fitted.where(F.forall(F.sequence(F.lit(0), F.lit(20)), point)).select(*keys, "a0", "a1", "a2", "kmin", "kmax", "n")


def smile_iv(prints: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """prints with `smile`: the group's parabola at k, held at the ends of its range; null without a fit."""
    k = F.least(F.greatest(F.col("k"), F.col("kmin")), F.col("kmax"))
    return prints.join(fitted, keys, "left").withColumn("smile", smile_at(k, F.col("a0"), F.col("a1"), F.col("a2"))).drop("a0", "a1", "a2", "kmin", "kmax", "n")


def atm_iv(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Mean iv at the strike nearest to the median forward (the lower of two), null if none is known there."""
    middle = chain.groupBy(*keys).agg(F.expr("percentile(fwd, 0.5)").alias("_mid"))
    rows = chain.join(middle, keys)
    best = rows.groupBy(*keys).agg(F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("_mid")), F.col("strike"))).alias("strike"))
    return chain.join(best, [*keys, "strike"], "left_semi").groupBy(*keys, "strike").agg(F.avg("iv").alias("atm"))
