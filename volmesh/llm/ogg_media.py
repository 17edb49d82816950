"""Media columns in Ogg: lossless storage of bytes as 8-bit samples, and a demultiplexer that checks what it reads.

A stored stream holds two logical streams, their pages interleaved: one of sample packets, and one with a checksum packet for each of
those. The reader verifies page checksums, puts packets together from lacing values across pages, separates the streams by serial
number and derives each packet's time from granule positions.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .shared import fields, table

SAMPLES, CHECKS = 1, 2  # serial numbers
RATE, PACKET, PAD = 8000, 4000, 64
_HEADER = struct.Struct("<4sBBqIIIB")
_SAMPLE_HEAD, _CHECK_HEAD = struct.Struct("<8sII"), struct.Struct("<8sI")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 04C11DB7, most significant bit first, from 0: zlib's mirrored CRC of the mirrored bytes, without its inversions."""
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule reached, page) of a logical stream of (packet, granule at its end); the first packet has a page of its own."""
    out, lacing, body, flags, done, size = [], bytearray(), [], _FIRST, -1, 0
    reached = 0

    def flush(last: bool):
        nonlocal lacing, body, flags, done
        out.append((reached, _page(serial, len(out), flags | (_LAST if last else 0), done, bytes(lacing), b"".join(body))))
        lacing, body, done = bytearray(), [], -1

    for k, (packet, granule) in enumerate(packets):
        at = 0
        flags = _FIRST if not out else 0 if not lacing else flags
        while True:
            room = 255 - len(lacing)
            size = len(packet) - at
            full = min(room, size // 255)
            lacing += b"\xff" * full
            body.append(packet[at : at + 255 * full])
            at += 255 * full
            if full < room:
                lacing.append(len(packet) - at)
                body.append(packet[at:])
                done = reached = granule
                break
            flush(False)
            flags = _CONTINUED
        if k == len(packets) - 1 or not out:
            flush(k == len(packets) - 1)
            flags = 0
        elif len(lacing) == 255:
            flush(False)
            flags = 0
    return out


def store(data: bytes) -> bytes:
    """data, padded with zeros to a positive multiple of PAD bytes, as an Ogg stream."""
    data = data + b"\0" * (-len(data) % PAD or (PAD if not data else 0))
    cuts = range(0, len(data), PACKET)
    parts = [data[i : i + PACKET] for i in cuts]
    ends = [min(i + PACKET, len(data)) for i in cuts]
    samples = _pages(SAMPLES, [(_SAMPLE_HEAD.pack(b"PCM8mono", RATE, PACKET), 0), *zip(parts, ends)])
    checks = _pages(CHECKS, [(_CHECK_HEAD.pack(b"CRC32idx", SAMPLES), 0), *((struct.pack("<II", zlib.crc32(p), len(p)), e) for p, e in zip(parts, ends))])
    # first pages lead; the others follow in order of the time they reach
    return samples[0][1] + checks[0][1] + b"".join(p for _, _, p in sorted([(g, 0, p) for g, p in samples[1:]] + [(g, 1, p) for g, p in checks[1:]], key=lambda x: x[:2]))


class _Stream:
    def __init__(self):
        self.packets: list[bytes] = []
        self.ends: list[int] = []  # granule at each packet's end, -1 until known
        self.open: list[bytes] = []
        self.pages, self.over = 0, False


def demultiplex(media: bytes) -> dict[int, _Stream]:
    """The logical streams by serial number. A wrong checksum, page number or flag, or a stream without its last page, is an error."""
    streams: dict[int, _Stream] = {}
    at = 0
    while at < len(media):
        mark, version, flags, granule, serial, number, crc, segments = _HEADER.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError(f"page at byte {at}: wrong checksum")
        s = streams.setdefault(serial, _Stream())
        if number != s.pages or s.over or bool(flags & _FIRST) != (number == 0) or bool(flags & _CONTINUED) != bool(s.open):
            raise ValueError(f"page at byte {at}: out of place")
        s.pages, s.over = s.pages + 1, bool(flags & _LAST)
        first = len(s.packets)
        for size in _whole(lacing):
            s.open.append(media[start : start + size[0]])
            start += size[0]
            if size[1]:
                s.packets.append(b"".join(s.open))
                s.ends.append(-1)
                s.open = []
        if len(s.packets) > first:
            s.ends[-1] = granule
        at = end
    for s in streams.values():
        if s.open or not s.over:
            raise ValueError("a stream has no end")
    return streams


def _whole(lacing: bytes) -> list[tuple[int, bool]]:
    """(bytes, whether the packet ends) of each packet's share in a page."""
    out, size, inside = [], 0, False
    for v in lacing:
        size, inside = size + v, True
        if v < 255:
            out.append((size, True))
            size, inside = 0, False
    if inside:
        out.append((size, False))
    return out


def times(stream: _Stream) -> list[int]:
    """Granule at the end of each sample packet: given for the last packet that ends on a page, and counted back from it for those before."""
    ends = list(stream.ends)
    for i in range(len(ends) - 2, 0, -1):
        if ends[i] < 0:
            ends[i] = ends[i + 1] - len(stream.packets[i + 1])
    return ends


def read(media: bytes) -> dict:
    """payload, start and end (seconds) of each sample packet, and numbers of the stream. Packets that don't match their checksum packet are an error."""
    streams = demultiplex(media)
    s, c = streams[SAMPLES], streams[CHECKS]
    kind, rate, _ = _SAMPLE_HEAD.unpack(s.packets[0])
    if kind != b"PCM8mono" or _CHECK_HEAD.unpack(c.packets[0]) != (b"CRC32idx", SAMPLES):
        raise ValueError("unknown streams")
    if [struct.pack("<II", zlib.crc32(p), len(p)) for p in s.packets[1:]] != c.packets[1:]:
        raise ValueError("a sample packet doesn't match its checksum")
    payload = b"".join(s.packets[1:])
    ends = times(s)[1:]
    if ends and (ends[-1] != len(payload) or any(e - len(p) != b for p, e, b in zip(s.packets[1:], ends, [0, *ends]))):
        raise ValueError("granule positions don't follow the samples")
    return {"payload": payload, "ends": [e / rate for e in ends], "streams": len(streams), "pages": s.pages + c.pages, "packets": len(s.packets) + len(c.packets), "duration_ms": ends[-1] * 1000 // rate if ends else 0}


def feature(got: dict) -> str:
    """Counts of the stream, and sums over the samples about their middle (128): mean and power in thousandths, crossings, loudest packet."""
    x = np.frombuffer(got["payload"], np.uint8).astype(np.int64) - 128
    n = len(x)
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    power = np.add.reduceat(x * x, np.arange(0, n, PACKET))
    return f"streams={got['streams']};pages={got['pages']};packets={got['packets']};ms={got['duration_ms']};mean={int(x.sum()) * 1000 // n};power={int(power.sum()) * 1000 // n};crossings={crossings};loudest={int(power.argmax())}"


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col, and n_bytes (of the text in UTF-8) and media: the text's bytes, zero-padded, as an Ogg stream. Null counts as empty; equal texts
    give equal media; repeated rows each get their row. An empty table gives an empty table; texts may be of any length. Input columns of these names are replaced; other
    names don't matter."""
    carried = [c for c in docs.columns if c not in (text_col, "n_bytes", "media")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                raw = [(t or "").encode() for t in b.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_pydict({c: b.column(c) for c in carried} | {"n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array(map(store, raw), pa.binary())})

    return docs.select(*[F.col(f"`{c}`") for c in [*carried, text_col]]).mapInArrow(run, fields(docs, carried).add("n_bytes", "long").add("media", "binary"))


def read_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows, and payload (bytes read back), packet_ends (seconds) and feature. Null media gives nulls. Input columns of these names are replaced."""
    carried = [c for c in rows.columns if c not in ("payload", "packet_ends", "feature")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                got = [None if m is None else read(m) for m in b.column(media_col).to_pylist()]
                pick = lambda f: [None if g is None else f(g) for g in got]  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({c: b.column(c) for c in carried} | {"payload": pa.array(pick(lambda g: g["payload"]), pa.binary()), "packet_ends": pa.array(pick(lambda g: g["ends"]), pa.list_(pa.float64())), "feature": pa.array(pick(feature), pa.string())})

    return rows.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(run, fields(rows, carried).add("payload", "binary").add("packet_ends", ArrayType(DoubleType())).add("feature", "string"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_media(to_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    tail = F.crc32(F.expr(f"substring(payload, -{PAD}, {PAD})"))
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature"
    )
