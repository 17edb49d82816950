"""Two-pass external shuffle into shards with equal counts.

Pass one scatters rows uniformly into buckets that fit in memory, by a seeded hash. Pass two shuffles each bucket (Fisher-Yates, seeded
by the bucket) and writes it. Buckets in order are then one uniform shuffle of all rows, and shards are equal slices of that order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .shared import MOST_PARTITIONS, by_key, dealt, id_key, shared_dir, table, text_hash, whole

SHARDS, SEED, BUCKET_BYTES = 8, 20240229, 16 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of n places that only n, seed and bucket decide (numpy's shuffle is Fisher-Yates)."""
    order = np.arange(n)
    np.random.Generator(np.random.Philox(key=[seed, bucket])).shuffle(order)
    return order


def _collapsed(batches, by: list[str], exact: bool):
    """The batches with _n, how often each row follows itself: wholly repeated rows are held once, however many there are."""
    for b in batches:
        if not b.num_rows:
            continue
        first = np.ones(b.num_rows, dtype=bool)
        if exact:
            first[1:] = np.any([(x := b.column(c).to_numpy())[1:] != x[:-1] for c in by], axis=0)
        at = np.flatnonzero(first)
        n = pa.array(np.diff([*at, b.num_rows]))
        kept = b if len(at) == b.num_rows else b.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*kept.columns, n], names=[*b.schema.names, "_n"])


def _shuffle(seed: int, exact: bool):
    def run(batches):
        for (bucket,), t in by_key(_collapsed(batches, ["_b", "_key", "_th", "_all"], exact), ["_b"]):
            order = np.repeat(np.arange(t.num_rows), t.column("_n").to_numpy())  # rows come sorted, so what a lost task does again comes out alike
            order = order[fisher_yates(len(order), seed, bucket)]
            t = t.select(["_b", "size", "row"])
            place = pa.array(np.arange(len(order), dtype=np.int64))
            for at in range(0, len(order), 512):
                part = t.take(pa.array(order[at : at + 512])).append_column("_place", place[at : at + 512])
                yield from part.combine_chunks().to_batches()

    return run


def shuffle_to_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes docs in a uniformly shuffled order to a Parquet table in folder (each bucket a run of rows in one file) and returns its rows with size (UTF-8 bytes of the text plus 1),
    shard and slot (place in the shard, gapless from 0). Shards' counts are at most one apart, the larger ones first.

    Null and empty texts have size 1. Rows are scattered by seed, id and text, so rows with one id spread by their texts, and a null id is an id. Wholly repeated rows share a bucket,
    which holds them once with their number; they are interchangeable. An empty table gives an empty table, and a text longer than bucket_bytes is held whole. An input
    column named size, shard or slot is replaced; other names don't matter.
    """
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    parts = min(buckets, MOST_PARTITIONS)
    kinds = dict(docs.dtypes)
    hashed = [c for c in carried if "map<" not in kinds[c]]  # maps have no hash; with one, rows are never taken for repeated
    rows = docs.select(size.alias("size"), id_key(id_col).alias("_key"), text_hash(F.col(text_col)).alias("_th"), F.xxhash64(*[F.col(f"`{c}`") for c in hashed]).alias("_all"), whole(docs, carried).alias("row"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "_key", "_th"), F.lit(buckets)).cast("int"))
    schema = StructType([rows.schema["_b"], rows.schema["size"], rows.schema["row"]]).add("_place", LongType())
    dealt(rows, buckets, "_b", "_key", "_th", "_all").mapInArrow(_shuffle(seed, len(hashed) == len(carried)), schema).write.mode("overwrite").parquet(folder)
    written = spark.read.schema(schema).parquet(folder)
    # rows before each bucket: those of the partitions before (one row each, at most MOST_PARTITIONS), then those of the buckets before in its partition
    counts = written.groupBy("_b").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_p", F.pmod("_b", F.lit(parts)))
    inside = Window.partitionBy("_p").orderBy("_b")
    whole_parts = counts.groupBy("_p").agg(F.sum("_rows").alias("_of")).select("_p", (F.sum("_of").over(Window.orderBy("_p")) - F.col("_of")).alias("_base"), F.sum("_of").over(Window.partitionBy()).alias("_all"))
    before = counts.withColumn("_in", F.sum("_rows").over(inside) - F.col("_rows")).join(whole_parts, "_p").select("_b", (F.col("_base") + F.col("_in")).alias("_before"), "_all")
    placed = written.join(before, "_b").withColumn("_at", F.col("_before") + F.col("_place"))
    each, over = F.expr(f"_all div {shards}"), F.col("_all") % shards
    large = over * (each + 1)  # rows of the shards with one more
    shard = F.when(F.col("_at") < large, F.expr(f"_at div (_all div {shards} + 1)")).otherwise(over + F.expr(f"(_at - (_all % {shards}) * (_all div {shards} + 1)) div greatest(_all div {shards}, 1)"))
    placed = placed.withColumn("_shard", shard.cast("int"))
    slot = F.col("_at") - (F.col("_shard") * each + F.least(F.col("_shard"), over))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in carried], "size", F.col("_shard").alias("shard"), slot.cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_to_shards(docs, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
