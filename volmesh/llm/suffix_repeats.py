"""Suffix-array deduplication: bytes covered by a 200-byte string that also starts anywhere else go, at every place.

Each start of a 200-byte string belongs to its anchor: the leftmost of the 64-byte grams in it with the smallest hash. Equal strings have
equal anchors at equal distances, so only stretches that share an anchor's gram need be compared; one stretch holds the starts of an
anchor and the bytes that they reach (336 at most). Stretches that are equal as a whole are counted by their hashes. Where a gram has
different stretches, one of each goes to an enhanced suffix array: the suffixes whose first 200 bytes occur again, in order, with the
lengths of their common prefixes. A scan with a stack finds the common-prefix intervals, and those with different bytes to the left are the
maximal repeats, each with all its occurrences. Equal texts are one row throughout.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import partitions, remove, shared_dir, table, whole

LENGTH, GRAM = 200, 64
#: Bits for the bytes of a stretch, beside its start.
SIZE_BITS = 20
#: Bytes that are hashed at a time.
SLICE = 1 << 20
#: Bytes of stretches in one suffix array; a gram is not cut.
BLOCK = 4 << 20
#: Bytes of text in a bucket, and buckets at most (Spark takes 100,000).
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000
#: A gram with more different stretches than this is answered by counting the hashes of its strings, so that no task holds them all.
HOT = 1 << 15
_U = np.uint64
_BASE = int(tn.BASE) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, _U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = tn.mix(np.arange(1, 257, dtype=_U) * tn.BASE)


class _Sums:
    """Hashes of any part of some bytes: differences of running sums, moved to a common power."""

    def __init__(self, data: np.ndarray, up: np.ndarray, down: np.ndarray):
        self.down = down
        self.total = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.total[1:])

    def part(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return tn.mix((self.total[hi] - self.total[lo]) * self.down[lo] ^ (hi - lo).astype(_U))

    def each(self, n: int) -> np.ndarray:
        m = len(self.total) - n
        return tn.mix((self.total[n:] - self.total[:m]) * self.down[:m])


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w consecutive keys."""
    a = np.concatenate([key, np.full(-len(key) % w, _U(2**64 - 1))]).reshape(-1, w)
    m = len(key) - w + 1
    from_left = np.minimum.accumulate(a, axis=1).ravel()
    from_right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[:m], from_left[w - 1 : w - 1 + m])


def stretches(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, gram's hash, stretch's hash, start in the text, bytes) of every stretch; data holds the texts end to end, bounds where each begins and the end."""
    up, down = _powers(_BASE, SLICE + length), _powers(_INVERSE, SLICE + length)
    size = length - gram + 1
    out = []
    for at in range(0, max(len(data) - length + 1, 0), SLICE):
        part = data[at : at + SLICE + length - 1]
        sums = _Sums(part, up, down)
        h = sums.each(gram)
        low = _U((1 << 22) - 1)
        best = _least((h & ~low) | np.arange(len(h), dtype=_U), size)
        text = np.searchsorted(bounds, np.arange(at, at + len(best)), side="right") - 1
        fine = np.arange(at, at + len(best)) + length <= bounds[text + 1]
        first = fine.copy()
        first[1:] &= ~fine[:-1] | (best[1:] != best[:-1]) | (text[1:] != text[:-1])
        last = fine.copy()
        last[:-1] &= ~fine[1:] | first[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last) + length
        p = (best[lo] & low).astype(np.int64)
        out.append((text[lo], h[p], sums.part(lo, hi), at + lo - bounds[text[lo]], hi - lo))
    if not out:
        return tuple(np.zeros(0, dtype=k) for k in (np.int64, _U, _U, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each value begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return body, off - off[0]


def _send(length: int, gram: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            text, g, x, start, size = stretches(*_bytes_of(b.column("text")), length, gram)
            at = pa.array(text)
            cells = [b.column("k1").take(at), b.column("k2").take(at), pa.array(g.view(np.int64)), pa.array(x.view(np.int64)), pa.array(start << SIZE_BITS | size)]
            yield pa.RecordBatch.from_arrays(cells, names=["k1", "k2", "g", "x", "at"])

    return run


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> list[np.ndarray]:
    """The bytes from start to end as big-endian words, at least most bytes; 0 stands beyond the end."""
    eight = np.ndarray(len(data) - 7, dtype=">u8", buffer=data, strides=(1,))
    out = []
    for k in range(0, most, 8):
        left = end - start - k
        word = np.zeros(len(start), dtype=_U)
        live = np.flatnonzero(left > 0)
        beyond = _U(64) - _U(8) * np.minimum(left[live], 8).astype(_U)
        word[live] = eight[start[live] + k].astype(_U) & ~((_U(1) << beyond) - _U(1))
        out.append(word)
    return out


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    n = np.full(len(x), 8)
    live = np.flatnonzero(x)
    rest, lead = x[live], np.zeros(len(live), dtype=np.int64)
    for bits in (32, 16, 8):
        empty = rest >> _U(64 - bits) == 0
        lead += np.where(empty, bits // 8, 0)
        rest = np.where(empty, rest << _U(bits), rest)
    n[live] = lead
    return n


def _suffix_array(contexts: list[bytes], of: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(context, start in it, byte to the left or -1, common prefix with the next suffix) of the suffixes in order. Only suffixes are held whose first length bytes occur
    again in a context of the same class, and not with one and the same byte to the left everywhere: those are inside a longer repeat, as are all intervals below them."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    data = np.frombuffer(b"".join(contexts) + bytes(8), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    starts = np.maximum(sizes - length + 1, 0)
    ctx = np.repeat(np.arange(len(contexts)), starts)
    at = np.arange(len(ctx)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[ctx]
    if not len(at):
        return (np.zeros(0, dtype=np.int64),) * 4
    sums = _Sums(data, _powers(_BASE, len(data)), _powers(_INVERSE, len(data)))
    _, kind, count = np.unique(sums.part(at, at + length) ^ tn.mix(of[ctx]), return_inverse=True, return_counts=True)
    left = np.where(at > begin[ctx], data[np.maximum(at - 1, 0)].astype(np.int64), -1)
    low, high = np.full(len(count), 256), np.full(len(count), -1)
    np.minimum.at(low, kind, left)
    np.maximum.at(high, kind, left)
    keep = np.flatnonzero((count[kind] > 1) & ((low != high) | (low == -1))[kind])
    at, ctx, kind, left = at[keep], ctx[keep], kind[keep], left[keep]
    end = (begin + sizes)[ctx]
    tail = _words(data, at + length, end, int((end - at).max(initial=length)) - length)
    order = np.lexsort((ctx, *tail[::-1], kind))
    at, ctx, kind, left, end = at[order], ctx[order], kind[order], left[order], end[order]
    common, alike = np.zeros(max(len(at) - 1, 0), dtype=np.int64), np.ones(max(len(at) - 1, 0), dtype=bool)
    for word in tail:
        lead = _leading_zero_bytes(word[order][1:] ^ word[order][:-1])
        common += np.where(alike, lead, 0)
        alike &= lead == 8
    rest = end - at - length
    return ctx, at - begin[ctx], left, np.where(kind[1:] == kind[:-1], length + np.minimum(common, np.minimum(rest[1:], rest[:-1])), 0)


def _intervals(lcp: np.ndarray):
    """(common prefix, first, last) of every interval of suffixes that share more bytes than their neighbours: they open where the common prefix grows and close where it shrinks."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > value:
            size, first = stack.pop()
            yield size, first, i
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(contexts: list[bytes], of: np.ndarray | None = None, length: int = LENGTH):
    """(bytes, contexts, starts) of every maximal repeat: a string of at least length bytes at two places or more in contexts of one class (of; all by default), which no
    further byte on either side extends at all its places. All its places are given, as arrays; a context's edge counts as a byte of its own."""
    ctx, start, left, lcp = _suffix_array(contexts, np.zeros(len(contexts), dtype=_U) if of is None else of, length)
    for size, first, last in _intervals(lcp):
        lefts = left[first : last + 1]
        if lefts.min() == -1 or lefts.min() != lefts.max():
            yield size, ctx[first : last + 1], start[first : last + 1]


def _compare(length: int):
    def run(batches):
        """For the stretches of each gram, in order of grams: what the maximal repeats cover of each."""
        held, of, xs, total = [], [], [], 0

        def answer():
            g = np.array(of, dtype=np.int64)
            lo, hi = np.full(len(held), 1 << 30), np.zeros(len(held), dtype=np.int64)
            for size, c, s in maximal_repeats(held, g.view(_U), length):
                np.minimum.at(lo, c, s)
                np.maximum.at(hi, c, s + size)
            found = np.flatnonzero(hi)
            return pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (g, np.array(xs, dtype=np.int64), lo, hi)], names=["g", "x", "lo", "hi"])

        for b in batches:
            for g, x, body in zip(b.column("g").to_pylist(), b.column("x").to_pylist(), b.column("body").to_pylist()):
                if total > BLOCK and g != of[-1]:
                    yield answer()
                    held, of, xs, total = [], [], [], 0
                held.append(body)
                of.append(g)
                xs.append(x)
                total += len(body)
        if held:
            yield answer()

    return run


def _counted(stretch: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many stretches, without a task that holds them: strings that occur twice, by two 64-bit hashes, counted before they are shuffled."""
    string = F.expr(f"substring(body, o + 1, {length})")
    each = stretch.select("g", "x", "body", F.explode(F.sequence(F.lit(0), F.octet_length("body") - length)).alias("o")).select("g", "x", "o", F.xxhash64(string).alias("h1"), F.xxhash64(F.lit(7), string).alias("h2"))
    twice = each.groupBy("g", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return each.join(twice, ["g", "h1", "h2"]).groupBy("g", "x").agg(F.min("o").cast("long").alias("lo"), (F.max("o") + length).cast("long").alias("hi"))


def _cut(length: int):
    def run(batches):
        for b in batches:
            size, gone_bytes, spans, kept = [], [], [], []
            for text, n, places in zip(b.column("text"), b.column("n").to_pylist(), b.column("spans")):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if len(text.as_py()) else np.zeros(0, dtype=np.uint8)
                at = places.values.to_numpy() if places.is_valid else np.zeros(0, dtype=np.int64)
                if n > 1 and len(data) >= length:
                    at = np.array([len(data)])  # an equal text stands elsewhere
                edge = np.zeros(len(data) + 2, dtype=np.int32)
                np.add.at(edge, (at >> 32) + 1, 1)
                np.add.at(edge, (at & 0xFFFFFFFF) + 1, -1)
                gone = np.cumsum(edge) > 0
                turn = np.flatnonzero(gone[1:] != gone[:-1])
                size.append(len(data))
                gone_bytes.append(int(gone.sum()))
                spans.append([{"from": a, "to": z} for a, z in turn.reshape(-1, 2).tolist()])
                kept.append(data[~gone[1:-1]].tobytes())
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            cells = [b.column("k1"), b.column("k2"), pa.array(size, pa.int64()), pa.array(gone_bytes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["k1", "k2", "n_bytes", "n_removed", "removed", "kept"])

    return run


def _keys(text: str):
    body = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")


def remove_repeated_bytes(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs without text_col, and n_bytes, n_removed, removed (array of [from, to) in bytes of UTF-8, maximal) and kept (the other bytes, as binary: a cut may fall inside a character).

    A byte goes if it lies in a string of `length` bytes of one text that also starts anywhere else, in the same text or another, earlier or later; overlaps count.
    All strings are judged on the input. Null texts are empty; texts of fewer bytes lose nothing. Ids play no part, so null or tied ids don't matter; rows with equal texts are one text at several places, and
    lose everything if it has `length` bytes. An empty table gives an empty table; texts may be of any length. Input columns named like an output are replaced; other
    names don't matter. Equal texts, grams and strings are told by 64 bits of hash and more (stretches by 128), within a gram.
    """
    spark = docs.sparkSession
    folder, name = f"{shared_dir(spark)}/suffix-{uuid.uuid4().hex}", f"suffix_{uuid.uuid4().hex}"

    def kept(df: DataFrame, what: str) -> DataFrame:
        df.write.parquet(f"{folder}/{what}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{what}")

    texts = docs.select(*_keys(text_col), F.coalesce(text_col, F.lit("")).alias("text")).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.any_value("text").alias("text"))
    # in buckets by key, a multiple of the shuffle partitions in number: the two joins below bring their rows to the texts, and no text is shuffled again
    parts, total = partitions(spark), docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(parts * max(1, -(-total // (BUCKET_BYTES * parts))), MOST_BUCKETS // parts * parts or MOST_BUCKETS)
    texts.write.bucketBy(buckets, "k1", "k2").format("parquet").option("path", f"{folder}/texts").saveAsTable(name)
    texts = spark.table(name)
    every = kept(texts.select("k1", "k2", "text").mapInArrow(_send(length, gram), "k1 long, k2 long, g long, x long, at long"), "stretches")
    # the small side of each join is written before it, so that Spark can split a gram or stretch with very many places
    again = kept(every.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.min("x") < F.max("x")).alias("several")).where("n > 1").drop("n"), "again")
    places = kept(every.join(again, "g"), "places")
    kinds = kept(places.groupBy("g", "x").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "at")).alias("one"), F.any_value("several").alias("several")), "kinds")
    asked = kinds.where("several").select("g", "x", "one.*")
    asked = asked.join(kept(asked.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "counts"), "g")
    body = F.expr(f"substring(cast(text as binary), cast(shiftright(at, {SIZE_BITS}) as int) + 1, cast(at & {(1 << SIZE_BITS) - 1} as int))")
    stretch = asked.join(texts.select("k1", "k2", "text"), ["k1", "k2"]).select("g", "x", "m", body.alias("body"))
    few = stretch.where(F.col("m") <= hot).drop("m").repartition("g").sortWithinPartitions("g", "x").mapInArrow(_compare(length), "g long, x long, lo long, hi long")
    covered = kept(few.unionByName(_counted(stretch.where(F.col("m") > hot), length)), "covered")
    size = F.col("at").bitwiseAND((1 << SIZE_BITS) - 1)
    whole_ = F.col("times") > 1
    known = kept(kinds.select("g", "x", "times").join(covered, ["g", "x"], "left").where(whole_ | F.col("hi").isNotNull()), "known")
    for what in ("stretches", "again", "kinds", "counts", "covered"):  # what the result still reads stays: texts, places, known
        remove(spark, f"{folder}/{what}")
    start = F.shiftright("at", SIZE_BITS)
    span = F.shiftleft(start + F.when(whole_, 0).otherwise(F.col("lo")), 32) + start + F.when(whole_, size).otherwise(F.col("hi"))
    spans = places.select("g", "x", "k1", "k2", "at").join(known, ["g", "x"]).groupBy("k1", "k2").agg(F.collect_list(span).alias("spans"))
    schema = "k1 long, k2 long, n_bytes long, n_removed long, removed array<struct<`from`: long, `to`: long>>, kept binary"
    found = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "n", "spans").mapInArrow(_cut(length), schema)
    carried = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_removed", "removed", "kept")]
    rows = docs.select(whole(docs, carried).alias("row"), *_keys(text_col)) if carried else docs.select(F.lit(0).alias("row"), *_keys(text_col))
    return rows.join(found, ["k1", "k2"]).select(*[F.col("row").getField(c).alias(c) for c in carried], "n_bytes", "n_removed", "removed", "kept")


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB.
ORACLE_SQL = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, p, substr(h, 2 * p + 1, 2 * 1199) as h from t, unnest(range(0, length(h) // 2, 1000)) as u(p)),
w as (select doc_id, p + i as i, md5(substr(h, 2 * i + 1, 400)) as s from c, unnest(range(0, least(1000, length(h) // 2 - 199))) as u(i)),
f as (select doc_id, i from (select doc_id, i, count(*) over (partition by s) as n from w) where n > 1),
b as (select *, case when i > lag(i) over (partition by doc_id order by i) + 200 then 1 else 0 end as new from f),
r as (select doc_id, min(i) as lo, max(i) + 200 as hi from (select *, sum(new) over (partition by doc_id order by i) as k from b) group by doc_id, k),
p as (select r.doc_id, lo, hi, coalesce(lag(hi) over (partition by r.doc_id order by lo), 0) as past, h from r join t on r.doc_id = t.doc_id),
k as (select doc_id, count(*) as n_spans, sum(hi - lo) as gone, max(hi) as last, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' order by lo) as kept from p group by doc_id)
select t.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from t left join k on t.doc_id = k.doc_id
"""
