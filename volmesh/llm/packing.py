"""Packing of token sequences, shortest pack first over the histogram of lengths.

Documents become pieces of at most `size` tokens. Only the histogram of piece lengths (at most `size` numbers) reaches the driver, where
lengths are placed longest first, each into the shortest pack that has room, updating counts of packing patterns. A piece then
finds its place by its rank among the pieces of its length: ranks are dealt over salted parts of each length, so no length is one task.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_alphabet, ids_of, loaded
from .shared import cut, partitions, table

SIZE = 1024


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, piece lengths) of each packing pattern. Lengths are placed longest first into the shortest packs with room for them."""
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        rooms = sorted((r for r in by_room if r >= length and by_room[r]), reverse=True)
        made: list[tuple[int, list[int]]] = []
        for room in rooms:
            while left and by_room[room]:
                times, pack = by_room[room].pop()
                fits = room // length  # of this length, several may go into a pack
                use = min(times, -(-left // fits))
                each = min(fits, left)
                full = left // each if each else 0
                full = min(use, full)
                made.append((full, pack + [length] * each))
                left -= full * each
                if times > full:
                    by_room[room].append((times - full, pack))
                if full == 0:
                    break
            if not left:
                break
        each = size // length
        if left >= each:
            made.append((left // each, [length] * each))
            left -= left // each * each
        if left:
            made.append((1, [length] * left))
        for times, pack in made:
            by_room.setdefault(size - sum(pack), []).append((times, pack))
    return [x for room in sorted(by_room) for x in by_room[room]]


def _places(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset): what each place of a pattern takes."""
    taken: dict[int, int] = {}
    sequence, out = 0, []
    for times, pack in patterns(histogram, size):
        offset = 0
        for length in pack:
            lo = taken.get(length, 0)
            out.append((length, lo, lo + times, sequence, offset))
            taken[length] = lo + times
            offset += length
        sequence += times
    return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of the JSON file as an encoder of tiktoken, which gives the ids of the tokenizers library at four times its speed."""
    spec, to_byte = json.load(open(path, encoding="utf-8")), byte_alphabet()
    ranks = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={x["content"]: x["id"] for x in spec.get("added_tokens", [])})


def _ids(path: str, text: str) -> np.ndarray:
    """The ids of a text. tiktoken's regex engine gives up on runs of several 100,000 white spaces; such texts go to the exact encoder of bpe.py."""
    try:
        return np.array(_encoder(path).encode(text, allowed_special="all"), dtype="<u4")
    except ValueError:
        return np.frombuffer(ids_of(text, *loaded(path)), dtype="<u4")


def _pieces(path: str, size: int, end: int, with_ids: bool):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    ids = np.append(_ids(path, text or ""), np.uint32(end))
                    for start in range(0, len(ids), size):
                        part = ids[start : start + size]
                        rows.append((doc, start, len(part), zlib.crc32(part), len(ids), part.astype(np.int32) if with_ids else None))
                cols = {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(("doc_id", "start", "length", "ids_crc32", "doc_tokens"))}
                if with_ids:
                    cols["ids"] = pa.array([r[5] for r in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (and ids).

    A document is the ids of its text, then `end`; null and empty texts are that one id. Pieces are cut every `size` ids. Pieces of a sequence
    lie without gaps from offset 0. An empty table gives an empty table; texts may be of any length. Other columns of docs are not read. padded is what the sequence fills: its own length if that is a power of two, else `size`. Repeated
    rows are packed once each; equal lengths are interchangeable, so which goes where follows the order in which pieces were written.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    pieces = cut(slim.mapInArrow(_pieces(vocabulary, size, end, with_ids), schema))
    # the pieces are files now, so their numbers stay
    salts = max(16, partitions(docs.sparkSession))
    pieces = pieces.withColumn("_n", F.monotonically_increasing_id()).withColumn("_salt", F.pmod(F.xxhash64("_n"), F.lit(salts)).cast("int"))
    counts = cut(pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_n")) - 1
    ranked = pieces.withColumn("_rank", rank).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    rows = _places(histogram, size)
    total: dict[int, list[int]] = {}
    for length, lo, hi, seq, offset in rows:
        total.setdefault(seq, [0])[0] += length
    where = docs.sparkSession.createDataFrame([(*r, total[r[3]][0]) for r in rows], "length long, lo long, hi long, seq long, offset long, filled long")
    # at most one row for each length of each pattern; there are fewer patterns than twice the lengths, of which there are `size`
    out = ranked.join(F.broadcast(where) if len(rows) <= 64 * size else where, (ranked["length"] == where["length"]) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).drop(where["length"])
    power = F.expr("bit_count(filled) = 1")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("seq") + F.col("_rank") - F.col("lo")).alias("sequence_id"), "offset", F.when(power, F.col("filled")).otherwise(size).alias("padded"), *(["ids"] if with_ids else []))


def op4_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
