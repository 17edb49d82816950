"""WARC archives in Zstandard with a dictionary: written by the tasks of a Spark job, as rows of whole archives, and read back.

An archive begins with a skippable frame that holds the dictionary, built from records of the archive; each record follows as a frame of
its own, so that any record can be read alone. Of equal payloads one record is the response, and others are revisits that refer to it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_key, shared_dir, table

#: The skippable frame that holds a dictionary, and the frame of compressed data.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes from which on equal payloads are stored once; bytes of an archive before compression; of its dictionary and the records it is built from.
REVISIT_BYTES, ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 1000, 16 << 20, 64 << 10, 4 << 20, 6
DATE = "2000-01-01T00:00:00Z"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or with refers_to (an id, or False for none) a revisit record."""
    about = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = about + (payload if refers_to is False else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is False else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not False:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The records, each a frame, behind the dictionary that is built from them. Where too few or too small records give no trained one, the bytes of records themselves serve."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = [r[:65536] for r in records[::step]]
    try:
        built = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, sample)) // 10)), sample, k=200, d=8)
    except zstandard.ZstdError:
        built = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    head, packer = built.as_bytes(), zstandard.ZstdCompressor(level=LEVEL, dict_data=built, write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(head)) + head + b"".join(map(packer.compress, records))


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends."""
    checked = data[at + 4] & 4
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        if block & 1:
            return at + (4 if checked else 0)


def records(data: bytes):
    """The records of an archive."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic == DICTIONARY_MAGIC:
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = _frame_end(view, at)
            yield unpack.decompress(view[at:end])
            at = end
        else:
            raise ValueError(f"not a frame at byte {at}")


def parse(r: bytes) -> dict:
    """Headers (lower-case names), page_id, refers_to, and the payload; a payload that doesn't match its digest is an error."""
    head, _, rest = r.partition(b"\r\n\r\n")
    h = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(h["content-length"])]
    about, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None
    out = {"page_id": number(h["warc-record-id"]), "record_type": h["warc-type"], "url": h.get("warc-target-uri"), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to": number(h.get("warc-refers-to")), "payload_bytes": int(about.rpartition(b"Content-Length: ")[2])}
    if out["record_type"] == "response" and (hashlib.sha1(payload).hexdigest() != out["payload_digest"] or len(payload) != out["payload_bytes"]):
        raise ValueError(f"record {h['warc-record-id']}: the payload doesn't match its digest")
    return out | {"payload": payload if out["record_type"] == "response" else None}


def _write(archive_bytes: int):
    def run(batches):
        held, size, seen = [], 0, set()

        def full():
            data = archive(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.UUID(bytes=hashlib.md5(data).digest())}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], names=["archive", "records", "content"])

        for b in batches:
            for page, url, html, digest, top in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "top"))):
                payload = (html or "").encode()
                first = page == top and (page, digest) not in seen
                if page == top and len(payload) >= REVISIT_BYTES:  # rows alike in id and payload lie side by side: one is the response
                    seen = {(page, digest)}
                held.append(record(page, url, payload, digest, False if first or len(payload) < REVISIT_BYTES else top))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield full()
                    held, size = [], 0
        if held:
            yield full()

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as archives, to a Parquet table of (archive, records, content) in folder, and returns that table.

    Spark writes the table, so folder may be in any store that Spark reaches; files() copies archives out of it. Of records with equal payloads of
    REVISIT_BYTES or more the one with the largest page_id is the response; null ids are smaller than all others. Among rows alike in id and payload
    one is the response. Null and empty html are an empty payload, html may be of any length, and an empty table gives no archives. Other columns are ignored, whatever their names.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    marked = slim.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("_key", id_key("page_id"))
    small = marked.select("_key", "digest", F.octet_length("html").alias("_n")).groupBy("_key", "digest").agg(F.max("_n").alias("_n"))
    top = small.where(f"_n >= {REVISIT_BYTES}").groupBy("digest").agg(F.max("_key").alias("_top"))
    told = small.join(top, "digest", "left").select("_key", "digest", F.coalesce("_top", "_key").alias("_top"))
    rows = marked.join(told, ["_key", "digest"]).withColumn("top", F.when(F.col("_top") == F.lit(-(1 << 63)), None).otherwise(F.col("_top")))
    rows = rows.repartition("_key", "digest").sortWithinPartitions("_key", "digest").select("page_id", "url", "html", "digest", "top")
    rows.mapInArrow(_write(archive_bytes), "archive string, records long, content binary").write.mode("overwrite").parquet(folder)
    return pages.sparkSession.read.parquet(folder)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record: page_id, url, record_type, payload_digest, payload_bytes (of the full payload, also of revisits), refers_to, archive, and with payloads the payload (null for revisits)."""
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("archive").to_pylist(), b.column("content").to_pylist()):
                got = []
                for r in records(data):
                    got.append(parse(r))
                    if len(got) == 512:
                        yield batch(name, got)
                        got = []
                yield batch(name, got)

    def batch(name, got):
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], kinds.get(c, pa.string())) for c in names] + [pa.array([name] * len(got), pa.string())], names=[*names, "archive"])

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, " + "payload binary, " * payloads + "archive string"
    return archives.select("archive", "content").mapInArrow(run, schema)


def files(archives: DataFrame, folder: str) -> None:
    """Copies each archive to a file in folder, which must be a mounted path that all executors share."""

    def run(rows):
        for r in rows:
            with open(f"{folder}/{r.archive}", "wb") as f:
                f.write(r.content)

    archives.foreachPartition(run)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    written = write_archives(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
t as (select html, max(page_id) as top from p where n >= 1000 group by 1)
select p.page_id, n::bigint as payload_bytes, sha1(p.html) as payload_digest,
  case when n < 1000 or top = page_id then 'response' else 'revisit' end as record_type,
  case when n >= 1000 and top <> page_id then top end as refers_to
from p left join t on n >= 1000 and p.html = t.html
"""
