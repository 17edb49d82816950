"""Tables in the folder that driver and executors share: settled results, extracts, snapshots by day and slot, logs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import publishable


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder of the first use; a temporary folder serves only a local master, where there is one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_volmesh_store", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark._volmesh_store = at
    return at


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's name; an open scope deletes the folder when it ends."""
    folder = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    for made in spark.__dict__.get("_volmesh_scopes", [])[-1:]:
        made.append(folder)
    return folder


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What the library writes inside (settled steps, snapshots, logs, models) is deleted at the end; results must be written elsewhere or read before. Stored tapes stay for the session."""
    scopes = spark.__dict__.setdefault("_volmesh_scopes", [])
    before = spark.sparkContext.getCheckpointDir()
    scopes.append([])
    spark.sparkContext.setCheckpointDir(fresh(spark, "settled"))
    try:
        yield
    finally:
        for folder in scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark.sparkContext.setCheckpointDir(before or shared(spark))


def settle(df: DataFrame) -> DataFrame:
    """The rows, written once and read by all that follows: for results that several later steps start from."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: as settle, for large steps that later ones read some columns of."""
    folder = fresh(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bundle(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Raw sources by name; nothing is read before a source is used."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def extract(rows: DataFrame, keep: Column, columns: list[str], order: list[str], folder: str) -> DataFrame:
    """The rows of one security, some of their columns, in order, as a table of its own; the filter and the columns reach the scan."""
    rows.where(keep).select(*columns).orderBy(*order).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


#: Bytes of a row group of a tape: a scan's tasks take whole groups, so that a file of one group would be one task's work.
GROUP = 4 << 20


def save_tape(rows: DataFrame, folder: str, ts: str = "ts") -> None:
    """A tape in partitions of months; a month is as many files as its size asks for."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).hint("rebalance", "month").write.mode("overwrite").option("parquet.block.size", GROUP).partitionBy("month").parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored_tape(spark: SparkSession, source: str, build: Callable[[], DataFrame]) -> str:
    """The folder of a source's tape: written by the session's first use of it, scanned by all."""
    tapes = spark.__dict__.setdefault("_volmesh_tapes", {})
    if source not in tapes or not exists(spark, f"{tapes[source]}/_SUCCESS"):
        folder = f"{shared(spark)}/tape-{uuid.uuid4().hex}"
        save_tape(build(), folder)
        tapes[source] = folder
    return tapes[source]


def scan_day(spark: SparkSession, folder: str, start: str, end: str, columns: list[str]) -> DataFrame:
    """Prints with start <= ts < end (UTC instants as text), in order: months are pruned, bounds and columns reach the scan."""
    months = F.col("month").between(start[:7], end[:7])
    rows = spark.read.parquet(folder).where(months & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return rows.select(*columns).orderBy("ts")


def save_snapshots(rows: DataFrame, folder: str) -> None:
    """Rows with day and hhmm, as partitions of those; days and slots that are written again are replaced, others stay."""
    rows.hint("rebalance", "day", "hhmm").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hhmm").parquet(folder)


def snapshots(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Union of snapshot tables; a column that one of them lacks is null there."""
    out = spark.read.parquet(folders[0])
    for f in folders[1:]:
        out = out.unionByName(spark.read.parquet(f), allowMissingColumns=True)
    return out


def at_time(table: DataFrame, hhmm: int) -> DataFrame:
    """All days at one grid time: a filter on a partition column."""
    return table.where(F.col("hhmm") == hhmm)


def as_of(asked: DataFrame, table: DataFrame, ts: str, rows: str = "n") -> DataFrame:
    """asked (ts) with the key (day, hhmm) of the latest snapshot at or before it, else of the latest of all, and how many rows it has.

    Snapshots are few (slots of days): their keys are aggregated first, and only keys meet the asked times, by day and then by the last key of the days before. The last step adds one row, the newest key."""
    keys = table.groupBy("day", "hhmm").agg(F.count(F.lit(1)).alias(rows))
    of_day = keys.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hhmm", rows))).alias("_k"))
    newest = keys.agg(F.max(F.struct("day", "hhmm", rows)).alias("_all"))
    days = asked.select(F.to_date(ts).alias("_d")).distinct().join(of_day.withColumnRenamed("day", "_d"), "_d", "full_outer")
    w = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    last = F.when(F.col("_k").isNotNull(), F.struct(F.col("_d").alias("day"), F.element_at("_k", -1)["hhmm"].alias("hhmm"), F.element_at("_k", -1)[rows].alias(rows)))
    days = days.withColumn("_before", F.last(last, ignorenulls=True).over(w))
    minute = F.hour(ts) * 100 + F.minute(ts)
    got = asked.withColumn("_d", F.to_date(ts)).join(days, "_d", "left").withColumn("_t", F.filter("_k", lambda k: k["hhmm"] <= minute))
    here = F.when(F.size("_t") > 0, F.struct(F.col("_d").alias("day"), F.element_at("_t", -1)["hhmm"].alias("hhmm"), F.element_at("_t", -1)[rows].alias(rows)))
    got = got.withColumn("_s", F.coalesce(here, "_before")).crossJoin(F.broadcast(newest)).withColumn("_s", F.coalesce("_s", "_all"))  # one row
    return got.select(*asked.columns, "_s.day", "_s.hhmm", F.col(f"_s.{rows}").alias(rows))


def open_days(days: DataFrame, built: DataFrame) -> DataFrame:
    """Days that are not built yet."""
    return days.join(built.select("day").distinct(), "day", "left_anti")


def append(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """An append-only log with the columns of all its writers."""
    return spark.read.option("mergeSchema", True).parquet(folder)


def publish(rows: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """Those of the columns that the rows have as JSON lines: floating ones rounded to 4, what is not finite null, nulls written. Returned as a reader sees them, days as text; a table without rows has its columns."""
    tidy = publishable(rows.select(*[c for c in columns if c in rows.columns]))
    tidy.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
    kinds = [f"`{f.name}` {'string' if f.dataType.typeName() in ('date', 'timestamp', 'timestamp_ntz') else f.dataType.simpleString()}" for f in tidy.schema.fields]
    return rows.sparkSession.read.schema(", ".join(kinds)).json(folder)
