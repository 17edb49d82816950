"""Substring deduplication: words covered by a 20-word window that also starts earlier in the corpus go.

Rabin-Karp hashes of all windows are rolled over the words of a group of documents at a time. A group sends, for each bucket of the
hash range, its distinct hashes with the document of each one's first occurrence (so a passage that a third of all documents share
is one entry a group, however often it occurs there). A bucket counts each hash over all groups and tells the groups, one bit an
entry, which of theirs start earlier elsewhere. The groups turn windows into maximal intervals and cut them out. Groups are formed
by a hash of id and text, so the same shuffle of the texts serves both passes and entries need not be named in the reply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import textnum as tn
from .shared import GROUP_BYTES, by_key, dealt, group_count, one_chunk, partitions, table, with_groups

WINDOW = 20


class _Windows:
    """The windows of one group: rows in order of (id, hash of text), repeated rows once."""

    def __init__(self, t: pa.Table, n: int, buckets: int):
        key, th = (one_chunk(t.column(c)).to_numpy(zero_copy_only=False) for c in ("_key", "_th"))
        order = np.lexsort((th, key))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (key[order][1:] == key[order][:-1]) & (th[order][1:] == th[order][:-1])
        self.place = np.empty(len(order), dtype=np.int64)  # of each row, among the rows kept here
        self.place[order] = np.cumsum(~same) - 1
        self.rows = order[~same]
        self.key = key[self.rows]
        self.words = tn.split(one_chunk(t.column("text")).take(pa.array(self.rows)))
        self.start, count = tn.runs(self.words.first, n)
        h = tn.rolling(tn.word_hashes(self.words), n)[self.start]
        self.doc = np.repeat(np.arange(len(count), dtype=np.int32), count)
        by = np.argsort(h, kind="stable")
        new = np.ones(len(by), dtype=bool)
        new[1:] = h[by][1:] != h[by][:-1]
        self.repeated = np.ones(len(by), dtype=bool)  # here, earlier
        self.repeated[by[new]] = False
        self.sent = np.flatnonzero(~self.repeated)
        self.h = h[self.sent]
        bucket = (tn.mix(self.h) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        self.sent, self.h = self.sent[by], self.h[by]
        self.bounds = np.searchsorted(bucket[by], np.arange(buckets + 1))


_ENTRIES = "_b int, _g int, n int, doc_key binary, per_doc binary, hash binary"
_REPLY = "_g int, _b int, bits binary"


def _entries(n: int, buckets: int):
    def send(t: pa.Table) -> pa.Table:
        w = _Windows(t, n, buckets)
        g = t.column("_g")[0].as_py()
        rows = []
        for b in np.flatnonzero(np.diff(w.bounds)):
            lo, hi = w.bounds[b], w.bounds[b + 1]
            doc, per = np.unique(w.doc[w.sent[lo:hi]], return_counts=True)  # entries are in order of documents
            rows.append((int(b), g, int(hi - lo), w.key[doc].astype("<i8").tobytes(), per.astype("<u4").tobytes(), w.h[lo:hi].astype("<u8").tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({c.split()[0]: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(_ENTRIES.split(", "))})

    return send


def _count(batches):
    """For each bucket in turn: which entries have an equal one in an earlier document."""
    for _, t in by_key(batches, ["_b"]):
        yield _earlier(t)


def _earlier(t: pa.Table) -> pa.RecordBatch:
    n = t.column("n").to_numpy()
    h = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for c in t.column("hash").chunks for x in c])
    key = np.concatenate([np.repeat(np.frombuffer(k.as_buffer(), "<i8"), np.frombuffer(p.as_buffer(), "<u4")) for a, c in zip(t.column("doc_key").chunks, t.column("per_doc").chunks) for k, p in zip(a, c)])
    g = np.repeat(t.column("_g").to_numpy(), n)
    by = np.argsort(h, kind="stable")
    eq = h[by][1:] == h[by][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] |= eq
    twice[:-1] |= eq
    by = by[twice]
    by = by[np.lexsort((g[by], key[by], h[by]))]
    later = np.zeros(len(by), dtype=bool)
    later[1:] = h[by][1:] == h[by][:-1]
    flag = np.zeros(len(h), dtype=bool)
    flag[by[later]] = True
    ends = np.cumsum(n)
    rows = [(int(gi), int(bi), np.packbits(f).tobytes()) for gi, bi, e, k in zip(t.column("_g").to_numpy(), t.column("_b").to_numpy(), ends, n) if (f := flag[e - k : e]).any()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["_g", "_b", "bits"])


def _remove(n: int, buckets: int, carried: bool, layout: bool):
    def cut_out(t: pa.Table, reply: pa.Table) -> pa.Table:
        w = _Windows(t, n, buckets)
        gone = w.repeated.copy()
        for b, bits in zip(reply.column("_b").to_pylist(), reply.column("bits")):
            lo, hi = w.bounds[b], w.bounds[b + 1]
            gone[w.sent[lo:hi]] |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=hi - lo).astype(bool)
        words = len(w.words.start)
        edge = np.zeros(words + 1, dtype=np.int64)
        at = w.start[gone]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
        covered = np.cumsum(edge)[:words] > 0
        first = w.words.first
        # maximal intervals, as word numbers in their document
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begins = covered.copy()
        begins[1:] &= ~covered[:-1] | (doc[1:] != doc[:-1])
        stops = covered.copy()
        stops[:-1] &= ~covered[1:] | (doc[1:] != doc[:-1])
        lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        spans = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(lo, first).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((x - first[doc[lo]]).astype(np.int64)) for x in (lo, hi)], names=["from", "to"]),
        )
        total = np.concatenate([[0], np.cumsum(covered)])
        out = {"row": one_chunk(t.column("row"))} if carried else {}
        at = pa.array(w.place)
        out |= {"n_words": pa.array(np.diff(first)).take(at), "n_removed": pa.array(total[first[1:]] - total[first[:-1]]).take(at), "removed": spans.take(at), "kept_text": tn.joined(w.words, ~covered).take(at)}
        if layout:
            out["kept_text"] = pc.if_else(pc.equal(out["n_removed"], 0), one_chunk(t.column("text")).fill_null(""), out["kept_text"])
        return pa.table(out)

    return cut_out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES, layout: bool = False) -> DataFrame:
    """docs without text_col, and n_words, n_removed, removed (array of [from, to) in words, maximal) and kept_text (kept words joined by one space;
    with layout a text that loses nothing stays as it is).

    A window is `window` consecutive words of one row; it goes if its words also start earlier: at a smaller id, or before in the
    same row. All windows are judged on the input. Null and empty texts, and texts of fewer words, lose nothing; kept_text of a null is "". An empty table gives
    an empty table. Texts may be of any length; rows go to groups by a hash, so a long text shares its group with others, and wholly repeated rows share one, which grows with them. A null id comes before all others. Rows
    alike in id and text count as one document and get the same result; rows alike in id only are told apart by a hash of the text (ties
    between them go by that hash). Input columns named like an output are replaced; other names don't matter. Equal windows are told by 64-bit
    hashes: among N windows a wrong match has a chance of about N*N / 2**65.
    """
    groups = group_count(docs, text_col, group_bytes)
    buckets = max(partitions(docs.sparkSession), groups // 4)
    carried = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "removed", "kept_text")]
    rows = with_groups(docs, groups, id_col, text_col, carried)
    # both passes read the same shuffle of the rows
    entries = rows.groupBy("_g").applyInArrow(_entries(window, buckets), _ENTRIES)
    reply = dealt(entries, buckets).mapInArrow(_count, _REPLY)
    spans = ArrayType(StructType().add("from", LongType()).add("to", LongType()))
    schema = StructType([rows.schema["row"]] if carried else []).add("n_words", LongType()).add("n_removed", LongType()).add("removed", spans).add("kept_text", StringType())
    out = rows.groupBy("_g").cogroup(reply.groupBy("_g")).applyInArrow(_remove(window, buckets, bool(carried), layout), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in carried], "n_words", "n_removed", "removed", "kept_text")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select doc_id, i, list_aggregate(list_slice(words, i, i + 19), 'string_agg', ' ') as s
        from w, unnest(range(1, len(words) - 18)) as u(i)),
f as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, i + j as p from f, unnest(range(0, 20)) as u(j)),
one as (select doc_id, p, words[p] as word from w, unnest(range(1, len(words) + 1)) as u(p)),
kept as (select one.doc_id, count(*) as n, string_agg(word, ' ' order by one.p) as t
         from one anti join gone on one.doc_id = gone.doc_id and one.p = gone.p group by 1)
select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
"""
