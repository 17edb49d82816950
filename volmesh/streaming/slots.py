"""Streaming forms: event-time slots of clean prints."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import clock
from ..sources import store


def slot_counts(prints: DataFrame, slot: str, late: str, least: float) -> DataFrame:
    """Count and sum of clean prints by slot of event time, once a slot is closed; prints later than `late` after the newest are dropped."""
    clean = prints.where(F.col("price") >= least).withColumn("ts", F.col("ts").cast("timestamp"))
    return clean.withWatermark("ts", late).groupBy(F.window("ts", slot)).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")).select(F.col("window.start").alias("slot"), "n", "total")


def _order(at: Column, event: Column) -> Column:
    """The order of (at, event) as one number, an event without an id first: with a struct in its buffer an aggregation sorts all its rows, which are eight for a print here; with numbers it hashes them."""
    return F.unix_micros(at).cast("decimal(18,0)") * F.lit(Decimal(1 << 65)) + F.coalesce(event.cast("decimal(19,0)"), F.lit(Decimal(-(1 << 63) - 1)))


def view_prints(prints: DataFrame, lag: int, lookback: int, window: int, grid: list[int], late: str = "2 hours") -> DataFrame:
    """day, slot, view, contract, n, size, last of a stream of prints (ts, event_id, day, contract, price, size): for each slot, the prints of the `lookback` minutes up to `lag` minutes before it (decide), and of the `window` minutes after it
    (fill), by contract, with the last price. Slots lie `step` apart on the clock, so each view is a sliding window of event time; its state is a sum and a last price a contract, kept until the watermark passes the window's
    end. A print that comes later than that is dropped. Bounds are (start, end] as in the batch views: event time is a microsecond earlier.
    """
    step = grid[1] - grid[0]
    timed = prints.withColumn("_at", (F.col("ts") - F.expr("interval 1 microsecond")).cast("timestamp")).withWatermark("_at", late)
    timed = timed.withColumn("_order", _order(F.col("_at"), F.col("event_id")))
    folders = {}
    for view, length, ends in (("decide", lookback, -lag), ("fill", window, window)):
        start = (grid[0] + ends - length) % step
        by = timed.groupBy(F.window("_at", f"{length} minutes", f"{step} minutes", f"{start} minutes").alias("_w"), "day", "expiry", "strike", "call")
        sums = by.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max_by("price", "_order").alias("last"))
        wall = clock.eastern(F.col("_w.end").cast("timestamp_ntz"))
        slot = (F.hour(wall) * 60 + F.minute(wall) - ends).alias("slot")
        folders[view] = run_available(prints.sparkSession, sums.select("day", slot, F.lit(view).alias("view"), "expiry", "strike", "call", "n", "size", "last"), f"views-{view}")
    return folders["decide"].unionByName(folders["fill"]).where(F.col("slot").isin(grid))


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what its source has now and returns what the sink got. Sink and state lie in the folder of spark.checkpoint.dir; a restart goes on from there."""
    folder = store.fresh(spark, name)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def paired_prints(prints: DataFrame, keys: list[str], within: float, late: str) -> DataFrame:
    """keys, event_id, other_id, gap: each print (keys, ts, event_id, call, price) with the latest opposite print of its keys that came at most `within` seconds before it; gap is call less put.

    A key's state is its last call and its last put, and a print gives one row at most. A batch's prints of a key are arrays, in order of time with the two of its state; a print that comes
    after a later one of its key was taken meets what its own batch and the state know by its time. A key that is silent for as long as the watermark allows is forgotten."""
    out = StructType([prints.schema[k] for k in keys]).add("event_id", "long").add("other_id", "long").add("gap", "double")
    state_schema = "c_us long, c_id long, c_price double, p_us long, p_id long, p_price double"

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))[["us", "event_id", "call", "price"]].assign(new=True)
        if state.exists:
            c_us, c_id, c_price, p_us, p_id, p_price = state.get
            held = [(u, i, c, p, False) for u, i, c, p in ((c_us, c_id, True, c_price), (p_us, p_id, False, p_price)) if u is not None]
            rows = pd.concat([rows, pd.DataFrame(held, columns=rows.columns)]) if held else rows
        rows = rows.sort_values(["us", "event_id"])
        us, event, call, price, new = (rows[c].to_numpy() for c in rows)
        call, new = call.astype(bool), new.astype(bool)
        # the last print of each side by the end of each instant: prints of one instant meet each other
        at = np.arange(len(us))
        end = np.searchsorted(us, us, side="right") - 1
        calls, puts = (np.maximum.accumulate(np.where(side, at, -1)) for side in (call, ~call))
        other = np.where(call, puts[end], calls[end])
        meets = new & (other >= 0) & (us - us[other] <= within * 1e6)
        one, two = at[meets], other[meets]
        gap = np.where(call[one], 1, -1) * (price[one] - price[two])
        last = []
        for k in (calls[-1], puts[-1]):
            last += [int(us[k]), int(event[k]), float(price[k])] if k >= 0 else [None] * 3
        state.update(tuple(last))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["us"].max() // 1000)) + int(within * 1000))
        yield pd.DataFrame({**{k: [v] * len(one) for k, v in zip(keys, key)}, "event_id": event[one], "other_id": event[two], "gap": gap}, columns=[f.name for f in out])

    timed = prints.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy(*keys).applyInPandasWithState(step, out, state_schema, "append", "EventTimeTimeout")


def overwrite_partitions(spark: SparkSession, stream: DataFrame, parts: list[str], name: str) -> DataFrame:
    """Runs a stream over what its source has now into partitions that each batch replaces, so that a batch that runs twice leaves one copy; returns the table."""
    folder = store.fresh(spark, name)

    def put(batch: DataFrame, _: int) -> None:
        batch.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{folder}/rows")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
