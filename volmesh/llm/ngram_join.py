"""Near-duplicate documents by the Jaccard similarity of their word n-grams, by vertical partitioning.

1. Each text becomes the set of 64-bit hashes of its n-grams; the order of the hashes is the global n-gram order. Texts with equal
   sets form a class, of which one text goes on.
2. Screening, exact. Two sets with J >= t share at least L(n) of the first n - ceil(t n) + L(n) n-grams of each (L(n): a quarter of
   the smaller size). Buckets of the order count in how many classes each of these n-grams occurs; a group of documents sends an
   n-gram once, with its count. Ordered by that count, rarest first, a pair still shares one of the first (all - L + 1), and for text
   that is not a near copy these all occur once. So nearly all documents leave here, however many share a passage with them.
3. What is left is linked through those rare n-grams, in runs of sizes that allow links, into regions that no link can leave.
4. In each region the n-gram order is cut into fragments. Each fragment counts partial overlaps of pairs by itself, a block of members
   and a block of pivots at a time, and the counts are then summed per pair over the fragments.
   Regions of many documents aren't compared pair by pair: some pivots are compared with all members, linked members merge, and
   the last round compares those outside the largest merged set with all members whose set differs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .components import components
from .shared import GROUP_BYTES, NULL_ID, by_key, dealt, group_count, id_key, one_chunk, partitions, passing, step, table, text_hash, whole, with_groups

WORDS = 5
PERCENT = 80
FRAGMENTS = 4
#: Regions of more members get so many pivots first. Members that one block of a fragment holds.
SMALL_REGION, PIVOTS, BLOCK = 64, 32, 512
#: Counts are kept up to this; an n-gram in more classes is as good as one in so many.
MOST = 255
SETS = "key long, th long, n long, cid long"


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after another, and where each text's begin. Lower-cases A-Z."""
    w = tn.split(texts, lower=True)
    h = tn.word_hashes(w)
    count = np.diff(w.first)
    at, per = tn.runs(w.first, words)
    grams = tn.mix(tn.rolling(h, words)[at])
    doc = np.repeat(np.arange(len(count)), per)
    for d in np.flatnonzero((count > 0) & (count < words)):  # the whole sequence; its length is part of the hash
        x = np.uint64(count[d])
        for v in h[w.first[d] : w.first[d + 1]]:
            x = tn.mix(np.array([x]) * tn.BASE + v)[0]
        grams, doc = np.append(grams, x), np.append(doc, d)
    by = np.lexsort((grams, doc))
    grams, doc = grams[by], doc[by]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(count) + 1))


def _needed(n, percent: int):
    """Of n n-grams, how many a partner must share at least."""
    return -(-percent * n // 100)


def _share(n):
    return np.maximum(1, n // 4)


def _prefix(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first n-grams are looked at, and how many of them a partner must have among its own."""
    return np.minimum(n, n - _needed(n, percent) + _share(n)), _share(_needed(n, percent))


def _sets(words: int, text_col: str):
    def classes(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):  # arrays over words are ten times the text
                b = whole.slice(at, 1024)
                grams, first = shingles(b.column(text_col), words)
                n = np.diff(first)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tn.mix(grams ^ tn.BASE))])
                cid = tn.mix((total[first[1:]] - total[first[:-1]]) ^ (n.astype(np.uint64) * tn.BASE)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_th"), pa.array(n.astype(np.int64)), pa.array(cid)], names=["key", "th", "n", "cid"])

    return classes


class _Prefixes:
    """A group's class representatives, in order of class, with the distinct first n-grams that they send to each bucket."""

    def __init__(self, t: pa.Table, reps: pa.Table, text_col: str, words: int, percent: int, buckets: int):
        key, th = (one_chunk(t.column(c)).to_numpy() for c in ("_key", "_th"))
        place = {k: i for i, k in enumerate(zip(key.tolist(), th.tolist()))}
        cid = reps.column("cid").to_numpy()
        by = np.argsort(cid, kind="stable")
        rows = np.array([place[k] for k in zip(reps.column("key").to_numpy()[by].tolist(), reps.column("th").to_numpy()[by].tolist())], dtype=np.int64)
        self.cid = cid[by]
        self.grams, self.first = shingles(one_chunk(t.column(text_col)).take(pa.array(rows)), words)
        self.n = np.diff(self.first)
        self.size, self.least = _prefix(self.n, percent)
        at = np.arange(int(self.size.sum())) + np.repeat(self.first[:-1] - (np.cumsum(self.size) - self.size), self.size)
        self.doc = np.repeat(np.arange(len(self.n)), self.size)
        self.gram, self.where, count = np.unique(self.grams[at], return_inverse=True, return_counts=True)
        self.count = np.minimum(count, MOST).astype(np.uint8)
        bucket = (tn.mix(self.gram) % np.uint64(buckets)).astype(np.int64)
        self.by = np.argsort(bucket, kind="stable")
        self.bounds = np.searchsorted(bucket[self.by], np.arange(buckets + 1))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


_ENTRIES = "_b int, _g int, n int, gram binary, count binary"
_REPLY = "_g int, _b int, count binary"
_FOUND = "_b int, n int, gram binary, cid binary, size binary, own long, set binary"


def _entries(text_col, words, percent, buckets):
    def send(t: pa.Table, reps: pa.Table) -> pa.Table:
        if not reps.num_rows:
            return _table([], _ENTRIES)
        p, g = _Prefixes(t, reps, text_col, words, percent, buckets), t.column("_g")[0].as_py()
        rows = []
        for b in np.flatnonzero(np.diff(p.bounds)):
            own = p.by[p.bounds[b] : p.bounds[b + 1]]
            rows.append((int(b), g, len(own), p.gram[own].astype("<u8").tobytes(), p.count[own].tobytes()))
        return _table(rows, _ENTRIES)

    return send


def _count(batches):
    """For each bucket in turn: in how many classes each entry's n-gram occurs. A group whose entries all occur once gets no answer."""
    for _, t in by_key(batches, ["_b"]):
        yield from _totals(t).to_batches()


def _totals(t: pa.Table) -> pa.Table:
    gram = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for c in t.column("gram").chunks for x in c])
    count = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for c in t.column("count").chunks for x in c])
    by = np.argsort(gram, kind="stable")
    new = np.ones(len(by), dtype=bool)
    new[1:] = gram[by][1:] != gram[by][:-1]
    total = np.minimum(np.add.reduceat(count[by].astype(np.int64), np.flatnonzero(new)), MOST).astype(np.uint8)
    out = np.empty(len(by), dtype=np.uint8)
    out[by] = total[np.cumsum(new) - 1]
    n = t.column("n").to_numpy()
    ends = np.cumsum(n)
    rows = [(int(g), int(b), x.tobytes()) for g, b, e, k in zip(t.column("_g").to_numpy(), t.column("_b").to_numpy(), ends, n) if (x := out[e - k : e]).max() > 1]
    return _table(rows, _REPLY)


def _found(text_col, words, percent, buckets):
    """Documents whose rarest n-grams occur elsewhere: those n-grams by bucket (set: null), and the whole sets (_b: -1)."""

    def rare(t: pa.Table, reps: pa.Table, reply: pa.Table) -> pa.Table:
        if not reps.num_rows or not reply.num_rows:
            return _table([], _FOUND)
        p = _Prefixes(t, reps, text_col, words, percent, buckets)
        total = np.ones(len(p.gram), dtype=np.int64)
        for b, x in zip(reply.column("_b").to_pylist(), reply.column("count")):
            total[p.by[p.bounds[b] : p.bounds[b + 1]]] = np.frombuffer(x.as_buffer(), np.uint8)
        df = total[p.where]
        by = np.lexsort((p.gram[p.where], df, p.doc))
        rank = np.arange(len(by)) - np.repeat(np.cumsum(p.size) - p.size, p.size)
        take = by[(rank < np.repeat(p.size - p.least + 1, p.size)) & (df[by] > 1)]
        gram, doc = p.gram[p.where][take], p.doc[take]
        rows = []
        bucket = (tn.mix(gram) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[b] : bounds[b + 1]]
            rows.append((int(b), len(own), gram[own].astype("<u8").tobytes(), p.cid[doc[own]].astype("<i8").tobytes(), p.n[doc[own]].astype("<u4").tobytes(), None, None))
        for d in np.unique(doc):
            rows.append((-1, int(p.n[d]), None, None, None, int(p.cid[d]), p.grams[p.first[d] : p.first[d + 1]].astype("<u8").tobytes()))
        return _table(rows, _FOUND)

    return rare


def _runs(percent: int):
    """For each bucket in turn: the documents of an n-gram in order of size, cut where the next one is too large for a link; those of a run are linked to its smallest id."""

    def links(batches):
        for _, t in by_key(batches, ["_b"]):
            yield of_bucket(t)

    def of_bucket(t: pa.Table) -> pa.RecordBatch:
        gram, cid, size = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in t.column(name).chunks for x in c]) for name, kind in (("gram", "<u8"), ("cid", "<i8"), ("size", "<u4")))
        by = np.lexsort((cid, size, gram))
        gram, cid, size = gram[by], cid[by], size[by].astype(np.int64)
        near = (gram[1:] == gram[:-1]) & (100 * size[:-1] >= percent * size[1:])
        run = np.concatenate([[0], np.cumsum(~near)]).astype(np.int64)[: len(gram)]
        lowest = np.minimum.reduceat(cid, np.flatnonzero(np.concatenate([[True], ~near])[: len(gram)]))[run]
        pairs = np.unique(np.stack([lowest, cid], axis=1)[lowest != cid], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return links


def _parts(fragments: int):
    """(cid, n) sets cut at fixed points of the n-gram order."""
    edges = [np.uint64((v << 64) // fragments) for v in range(1, fragments)]

    def cut_sets(frames):
        for t in frames:
            out = []
            for cid, n, s in zip(t.cid, t.n, t.set):
                x = np.frombuffer(s, "<u8")
                at = [0, *np.searchsorted(x, edges), len(x)]
                out += [(cid, n, v, s[8 * at[v] : 8 * at[v + 1]]) for v in range(fragments)]
            yield pd.DataFrame(out, columns=["cid", "n", "v", "part"])

    return cut_sets


_COUNTS = "region long, block int, chunk int, v int, who binary, counts binary"


def _overlaps(batches):
    """For one block of members and one of pivots, in one fragment: the partial overlap of every pair, as a matrix; with the first fragment goes who they are."""
    out = []
    for (region, block, chunk, v), t in by_key(batches, ["region", "block", "chunk", "v"]):
        is_pivot = one_chunk(t.column("pivot")).to_numpy(zero_copy_only=False)
        cid, n, label = (t.column(c).to_numpy() for c in ("cid", "n", "label"))
        parts = [np.frombuffer(x.as_buffer(), "<u8") for x in one_chunk(t.column("part"))]
        members, pivots = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)  # both in order of cid
        size = np.array([len(parts[m]) for m in members])
        own = np.concatenate([parts[m] for m in members]) if len(members) else np.zeros(0, "<u8")
        grams, own = np.unique(own, return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(size)])
        counts = np.zeros((len(pivots), len(members)), dtype="<u4")
        for i, p in enumerate(pivots):
            mark = np.zeros(len(grams) + 1, dtype=np.int64)
            at = np.searchsorted(grams, parts[p])
            hit = at < len(grams)
            hit[hit] = grams[at[hit]] == parts[p][hit]
            mark[at[hit]] = 1
            total = np.concatenate([[0], np.cumsum(mark[own])])
            counts[i] = total[edge[1:]] - total[edge[:-1]]
        who = np.concatenate([[len(members)], *(x[y] for y in (members, pivots) for x in (cid, n, label))]).astype("<i8").tobytes() if v == 0 else None
        out.append((region, block, chunk, v, who, counts.tobytes()))
        if len(out) == 256:
            yield from _table(out, _COUNTS).to_batches()
            out = []
    yield from _table(out, _COUNTS).to_batches()


def _sums(percent: int):
    """Sums the partial overlaps of each pair over the fragments, and gives the pairs that link and don't share a label yet."""

    def links(batches):
        for _, t in by_key(batches, ["region", "block", "chunk"]):
            who = np.frombuffer(next(x for x in t.column("who") if x.is_valid).as_buffer(), "<i8")
            m = int(who[0])
            p = (len(who) - 1) // 3 - m
            cid, n, label = (who[1 + k * m : 1 + (k + 1) * m] for k in range(3))
            cid_p, n_p, label_p = (who[1 + 3 * m + k * p : 1 + 3 * m + (k + 1) * p] for k in range(3))
            both = sum(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for c in t.column("counts").chunks for x in c).reshape(p, m)
            every = n_p[:, None] + n[None, :] - both
            i, j = np.nonzero((100 * both >= percent * every) & (label_p[:, None] != label[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(cid_p[i]), pa.array(cid[j])], names=["a", "b"])

    return links


def _links(parts: DataFrame, members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pivots' links to members with another label. members: cid, region, label, block; pivots: cid, region, label, chunk."""
    blocks = step(members.select("region", "block").distinct())
    chunks = step(pivots.select("region", "chunk").distinct())
    left = members.join(chunks.hint("merge"), "region").select("cid", "region", "label", "block", "chunk", F.lit(False).alias("pivot"))
    right = pivots.join(blocks.hint("merge"), "region").select("cid", "region", "label", "block", "chunk", F.lit(True).alias("pivot"))
    rows = left.union(right).join(parts.hint("merge"), "cid").select("region", "block", "chunk", "v", "pivot", "cid", "n", "label", "part")
    place = ["region", "block", "chunk"]
    counts = rows.repartition(*place, "v").sortWithinPartitions(*place, "v", "pivot", "cid").mapInArrow(_overlaps, _COUNTS)
    return counts.repartition(*place).sortWithinPartitions(*place).mapInArrow(_sums(percent), "a long, b long")


def _regions(parts: DataFrame, regions: DataFrame, percent: int) -> DataFrame:
    """All links' components over classes, as edges. regions: node, label of the regions from step 3."""
    who = step(regions.select(F.col("node").alias("cid"), F.col("label").alias("region")))
    # small sides of joins by region are written first: a join of two plain shuffles is one whose hot keys Spark splits at run time
    count = step(who.groupBy("region").agg(F.count(F.lit(1)).alias("members")))
    state = step(who.join(count.hint("merge"), "region").withColumn("label", F.col("cid")))
    spread = F.xxhash64("cid")
    block = F.pmod(spread, F.ceil(F.col("members") / BLOCK)).cast("int")
    found = None
    big = state.where(f"members > {SMALL_REGION}")
    if not big.isEmpty():
        hashed = big.select("cid", "region", "label", F.xxhash64("cid").alias("h"), F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(PIVOTS)).alias("slot"))
        pivots = step(hashed.groupBy("region", "slot").agg(F.min_by(F.struct("cid", "label"), "h").alias("p")).select("p.cid", "region", "p.label", F.lit(0).alias("chunk")))
        found = step(_links(parts, big.select("cid", "region", "label", block.alias("block")), pivots, percent))
        merged = components(found).withColumnRenamed("node", "cid").withColumnRenamed("label", "now")
        state = step(state.join(merged.hint("merge"), "cid", "left").select("cid", "region", "members", F.coalesce("now", "cid").alias("label")))
    sizes = state.groupBy("region", "label").agg(F.count(F.lit(1)).alias("k"))
    top = step(sizes.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("top")))
    pivots = step(state.join(top.hint("merge"), "region").where("label != top").select("cid", "region", "label", block.alias("chunk")))
    open_ = step(pivots.select("region").distinct())
    members = step(state.join(open_.hint("merge"), "region", "left_semi").select("cid", "region", "label", block.alias("block")))
    links = _links(parts, members, pivots, percent)
    return links if found is None else found.union(links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, group_bytes: int = GROUP_BYTES, fragments: int = FRAGMENTS) -> DataFrame:
    """One row per row of docs: key (the id), th (hash of the text), n_shingles, component_id, the smallest id that links reach, and root, a name of the component (null without n-grams).

    A-Z is lower-cased; a set holds the distinct n-grams of `words` words, or the whole sequence where there are fewer words. Null and
    empty texts have no n-grams, link with nothing, and are their own component. Two rows link when 100 * common >= percent * all.
    Rows that share an id but not the text are told apart by th; wholly equal rows are one class. A null id counts only where a
    component has no other (component_id is then null). An empty table gives an empty table; texts may be of any length. Rows go to groups by a hash of id and text, so a long
    text shares its group with others, and wholly repeated rows share one, which grows with them. Other columns of docs are not read, whatever their names. n-grams and classes are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    groups = group_count(slim, "text", group_bytes)
    rows = with_groups(slim, groups)
    sets = step(rows.mapInArrow(_sets(words, "text"), SETS))
    with passing(spark):
        g = F.pmod(F.xxhash64("key", "th"), F.lit(groups)).cast("int")
        reps = sets.where("n > 0").groupBy("cid").agg(F.min_by(F.struct("key", "th"), F.struct("key", "th")).alias("r")).select(F.col("r.key").alias("key"), F.col("r.th").alias("th"), "cid")
        reps = step(reps.select(g.alias("_g"), "key", "th", "cid"))
        buckets = max(partitions(spark), groups // 4)
        args = ("text", words, percent, buckets)
        entries = rows.groupBy("_g").cogroup(reps.groupBy("_g")).applyInArrow(_entries(*args), _ENTRIES)
        reply = dealt(entries, buckets).mapInArrow(_count, _REPLY)
        # three inputs meet by group: the classes travel as rows of the reply, told by a null count
        told = reply.select("_g", "_b", "count", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("th"), F.lit(None).cast("long").alias("cid"))
        told = told.unionByName(reps.select("_g", F.lit(-1).alias("_b"), F.lit(None).cast("binary").alias("count"), "key", "th", "cid"))
        rare = _found(*args)

        def split_reply(t: pa.Table, r: pa.Table) -> pa.Table:
            own = pc.less(r.column("_b"), 0)
            return rare(t, r.filter(own), r.filter(pc.invert(own)))

        found = step(rows.groupBy("_g").cogroup(told.groupBy("_g")).applyInArrow(split_reply, _FOUND))
        runs = dealt(found.where("_b >= 0"), buckets).mapInArrow(_runs(percent), "a long, b long")
        regions = components(runs)
        whole = found.where("_b < 0").select(F.col("own").alias("cid"), "n", "set")
        parts = step(whole.join(regions.select(F.col("node").alias("cid")).hint("merge"), "cid", "left_semi").mapInPandas(_parts(fragments), "cid long, n long, v int, part binary"))
        linked = components(_regions(parts, regions, percent)).withColumnRenamed("node", "cid").withColumnRenamed("label", "root")
        best = step(_lowest(sets, linked), stays=True)
    return _with_component(sets, best)


def _lowest(sets: DataFrame, linked: DataFrame) -> DataFrame:
    """Of each class its smallest id and its component's name."""
    low = F.min(F.when(F.col("key") != NULL_ID, F.col("key")))
    best = sets.where("n > 0").groupBy("cid").agg(low.alias("low")).join(linked.hint("merge"), "cid", "left")
    return best.withColumn("root", F.coalesce("root", "cid"))


def _with_component(sets: DataFrame, best: DataFrame) -> DataFrame:
    of_root = step(best.groupBy("root").agg(F.min("low").alias("component_id")))
    of_class = best.join(of_root.hint("merge"), "root").select("cid", "component_id", "root")
    out = sets.join(of_class.hint("merge"), "cid", "left")
    own = F.when(F.col("key") != NULL_ID, F.col("key"))
    return out.select("key", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("root"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest (id, hash of text) stays, rows without n-grams (null and empty texts) all
    stay; of rows alike in id and text one. An empty table gives an empty table; columns come back as they are, whatever their names."""
    found = near_duplicates(docs, id_col, text_col, **settings)
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("key", "th")).alias("r")).select("r.key", "r.th")
    stay = first.union(found.where("root is null").select("key", "th").distinct())
    rows = docs.select(id_key(id_col).alias("key"), text_hash(F.col(text_col)).alias("th"), whole(docs).alias("row"))
    rows = rows.join(stay, ["key", "th"], "left_semi")
    once = F.row_number().over(Window.partitionBy("key", "th").orderBy("key"))
    return rows.withColumn("once", once).where("once = 1").select("row.*")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("key").alias("doc_id"), "n_shingles", "component_id")


#: The same rows in DuckDB.
ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, list_aggregate(list_slice(words, i, i + 4), 'string_agg', ' ') as g
      from w, unnest(range(1, greatest(len(words) - 3, 2))) as u(i) where len(words) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n n1 on n1.doc_id = x join n n2 on n2.doc_id = y where 100 * c >= 80 * (n1.n + n2.n - c)),
e as (select x, y from l union select y, x from l),
r as (select doc_id as x, doc_id as root from documents union select e.y, r.root from r join e on e.x = r.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from documents d left join n on n.doc_id = d.doc_id join (select x, min(root) as component_id from r group by 1) m on m.x = d.doc_id
"""
