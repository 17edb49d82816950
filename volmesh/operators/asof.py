"""As-of joins: the latest right row at or before (or strictly before) each left row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str, name: str, strict: bool = False, tolerance: Column | None = None) -> DataFrame:
    """left with `name`, right's `value` at the last `on` not after left's (before it, if strict), for equal `by`.

    Both sides go through one shuffle by `by` and one sort: a union with a running last() instead of a join on an inequality. Of right rows
    at one instant the largest value counts. tolerance: a boolean Column over left's `on` and `_at` (the right row's), outside of which the value is null.
    """
    keys = [*by, on]
    payload = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*payload).alias("_row") if payload else F.lit(1).alias("_row"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.where(F.col(value).isNotNull()).select(*keys, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(1 if strict else 0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(on, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v").alias("v"), F.col(on).alias("at"))), ignorenulls=True).over(w)
    rows = a.unionByName(b).withColumn("_hit", hit).where(F.col("_row").isNotNull()).withColumn("_at", F.col("_hit.at"))
    got = F.col("_hit.v") if tolerance is None else F.when(tolerance, F.col("_hit.v"))
    return rows.select(*keys, *([F.col(f"_row.{c}").alias(c) for c in payload]), got.alias(name))
