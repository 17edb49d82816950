"""Exact quantiles of few large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, q0, q1 and so on: the interpolated quantiles of value at the shares; nulls don't count.

    Equal values are counted first, with map-side sums. An approximate sketch cuts each group into bins, which are counted; only the few bins that hold a
    wanted rank are then ranked, each by itself. The sketch decides how work is cut, never the result.
    """
    vals = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    at = [k / CUTS for k in range(1, CUTS)]
    edges = vals.groupBy(*keys).agg(F.percentile_approx("_v", at, 1000).alias("_e"), F.sum("_c").alias("_n"))  # a row a group
    binned = vals.join(edges, keys).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("_v")))).drop("_e")
    bins = binned.groupBy(*keys, "_b", "_n").agg(F.sum("_c").alias("_m"))  # at most CUTS rows a group
    bins = bins.withColumn("_before", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_m"))
    position = lambda p: p * (F.col("_n") - 1)
    holds = F.lit(False)
    for p in shares:
        holds = holds | ((F.col("_before") <= F.ceil(position(p))) & (F.col("_before") + F.col("_m") > F.floor(position(p))))
    wanted = binned.join(bins.where(holds).select(*keys, "_b", "_before"), [*keys, "_b"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    ranked = wanted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    of = lambda rank: F.max(F.when((F.col("_from") <= rank) & (F.col("_to") > rank), F.col("_v")))
    out = ranked.groupBy(*keys, "_n").agg(*[x for i, p in enumerate(shares) for x in (of(F.floor(position(p))).alias(f"_l{i}"), of(F.ceil(position(p))).alias(f"_h{i}"))])
    return out.select(*keys, *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (position(p) - F.floor(position(p)))).alias(f"q{i}") for i, p in enumerate(shares)])
