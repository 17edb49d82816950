"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one Python group holds.
GROUP_BYTES = 2 << 20
#: Shuffle partitions that buckets are dealt to, at most; beyond it a partition holds several buckets, one after another.
MOST_PARTITIONS = 4096
#: Stands for a null id where an id takes part in an order: before every other.
NULL_ID = -(1 << 63)
#: Bytes of a row group of a step's table: a scan's tasks take whole groups.
ROW_GROUP = 4 << 20
#: Folders of the steps that passing() deletes.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. A temporary folder serves only a local master, where there is one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_volmesh_dir", None) or tempfile.mkdtemp(prefix="volmesh-")
        spark._volmesh_dir = at
    return at


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in any store that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The context's checkpoint folder, in the shared folder if none is set yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, in the partitions that they had: lineage ends here and a lost executor costs nothing before it. For joins of joins, see step."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def step(df: DataFrame, stays: bool = False) -> DataFrame:
    """As cut, but a Parquet table, whose size the planner takes from its files. A checkpoint keeps the estimate from before it, which for a join is the product of its sides': over rounds of joins
    that number's digits multiply, until the driver's memory is full of them. In passing() the table is deleted at the end, unless it stays."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/step-{uuid.uuid4().hex}"
    made = _PASSING.get()
    if made is not None and not stays:
        made.append(folder)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that step writes inside are deleted at the end; what is read later must stay."""
    made: list[str] = []
    outer = _PASSING.set(made)
    try:
        yield
    finally:
        _PASSING.reset(outer)
        for folder in made:
            remove(spark, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(column: Column | str) -> Column:
    """A long that is never null; null ids come first."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def whole(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of a row as one struct, so that helper columns beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)])


def fields(df: DataFrame, columns: list[str]) -> StructType:
    return StructType([df.schema[c] for c in columns])


def group_count(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many groups of about group_bytes of text there are; at least one a shuffle partition."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // group_bytes))


def with_groups(docs: DataFrame, groups: int, id_col: str = "doc_id", text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """(_g, _key, _th, text, row): group, id, hash of the text, the text, and the carried columns as one struct. Rows that share id and text share the first three, so
    no group is hot unless rows repeat wholly."""
    th, key = text_hash(F.col(text_col)), id_key(id_col)
    rest = [] if not carried else [whole(docs, carried).alias("row")]
    return docs.select(F.pmod(F.xxhash64(key, th), F.lit(groups)).cast("int").alias("_g"), key.alias("_key"), th.alias("_th"), F.col(text_col).alias("text"), *rest)


def dealt(rows: DataFrame, buckets: int, column: str = "_b", *order: str) -> DataFrame:
    """rows by bucket: each bucket in one partition of at most MOST_PARTITIONS, there one after another (in the given order)."""
    count = min(buckets, MOST_PARTITIONS)
    return rows.repartitionById(count, F.pmod(F.col(column), F.lit(count))).sortWithinPartitions(column, *order)


def by_key(batches, keys: list[str]):
    """(key, table) of every group, from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(k[:, lo].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def one_chunk(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column
