"""A trie of conversations by turns, from adaptive radix trees.

A turn is a fixed-width big-endian id (128 bits of hash of role and text, and the text's bytes), so a conversation is a byte string, and only
byte depths that are multiples of that width are nodes of the trie. Conversations are dealt by ranges of these strings and come in order; each
range grows one tree, with nodes of 4, 16, 48 or 256 children and compressed paths. Only nodes on the way to a range's first or last string
can have members in other ranges: those go, in order, through one pass that holds a stack of them; all others are whole where they are.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_key, partitions, remove, shared_dir, table

#: Bytes of a turn's id.
WIDTH = 20
#: Bytes of ids that one tree holds.
RANGE_BYTES = 8 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


class _Node:
    """A path of bytes below the parent's, what ends there, and children by their next byte: up to 16 in two sorted lists, up to 48 behind an index of bytes, beyond that by the byte itself."""

    __slots__ = ("path", "ends", "layout", "index", "children")

    def __init__(self, path: bytes, ends=None):
        self.path, self.ends, self.layout, self.index, self.children = path, ends, 4, bytearray(), []

    def child(self, byte: int):
        if self.layout <= 16:
            i = bisect_left(self.index, byte)
            return self.children[i] if i < len(self.index) and self.index[i] == byte else None
        if self.layout == 48:
            return self.children[self.index[byte] - 1] if self.index[byte] else None
        return self.children[byte]

    def put(self, byte: int, node: _Node) -> None:
        if self.layout <= 16:
            i = bisect_left(self.index, byte)
            if i < len(self.index) and self.index[i] == byte:
                self.children[i] = node
                return
            if len(self.index) < self.layout:
                self.index.insert(i, byte)
                self.children.insert(i, node)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                places = bytearray(256)
                for k, b in enumerate(self.index):
                    places[b] = k + 1
                self.layout, self.index = 48, places
            self.put(byte, node)
        elif self.layout == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.index[byte] = len(self.children)
            else:
                self.children = [self.children[k - 1] if k else None for k in self.index]
                self.layout, self.index = 256, bytearray()
                self.put(byte, node)
        else:
            self.children[byte] = node

    def in_order(self) -> list[_Node]:
        if self.layout == 48:
            return [self.children[k - 1] for k in self.index if k]
        return [c for c in self.children if c is not None]


class RadixTree:
    """Byte strings and what is known of each."""

    def __init__(self):
        self.root = _Node(b"")

    def add(self, key: bytes, ends) -> None:
        node, at, above = self.root, 0, None
        while True:
            path = node.path
            if key.startswith(path, at):
                at += len(path)
                if at == len(key):
                    node.ends = ends
                    return
                below = node.child(key[at])
                if below is None:
                    node.put(key[at], _Node(key[at:], ends))
                    return
                above, node = node, below
                continue
            same = next(i for i in range(len(path)) if at + i == len(key) or path[i] != key[at + i])
            upper = _Node(path[:same])
            node.path = path[same:]
            upper.put(path[same], node)
            above.put(path[0], upper)
            if at + same == len(key):
                upper.ends = ends
            else:
                upper.put(key[at + same], _Node(key[at + same :], ends))
            return


_NODE = "open boolean, part int, seq long, id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, size long, ends string"
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_KINDS = [pa.bool_(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]


def _id(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


def _nodes(tree: RadixTree, first: bytes, last: bytes, part: int) -> list[list]:
    """The tree's nodes at whole turns. Those on the way to first or last are open: their sums are of what is closed below them, without their own share."""
    rows: list[list] = []

    def is_open(key: bytes, depth: int) -> bool:
        return first.startswith(key[: depth * WIDTH]) or last.startswith(key[: depth * WIDTH])

    # each entry: [node, bytes above it, children to come, members, smallest member, a key, children, leaves, saved, rows that wait for their parent]
    stack = [[tree.root, -1, None, 0, 1 << 63, None, 0, 0, 0, []]]
    key_above = [b""]
    while True:
        now = stack[-1]
        node = now[0]
        if now[2] is None:
            key_above.append(key_above[-1] + node.path)
            now[5] = key_above[-1]
            now[2] = iter(node.in_order())
            if node.ends:
                now[4], now[3] = node.ends[:2]
        below = next(now[2], None)
        if below is not None:
            stack.append([below, len(now[5]), None, 0, 1 << 63, None, 0, 0, 0, []])
            continue
        _, above, _, n, low, key, children, leaves, saved, waiting = stack.pop()
        key_above.pop()
        for depth in range(len(key) // WIDTH, (above // WIDTH if above >= 0 else -1), -1):
            ends = node.ends[2] if node.ends and depth * WIDTH == len(key) else None
            size = int.from_bytes(key[depth * WIDTH - 4 : depth * WIDTH], "big") if depth else 0
            opened = is_open(key, depth)
            up = bool(depth) and is_open(key, depth - 1)
            if opened:  # what is below it and open as well counts later
                row = [True, part, 0, _id(key[: depth * WIDTH]), _id(key[: (depth - 1) * WIDTH]) if depth else None, low, depth, None, n, children, leaves, saved, size, ends]
                rows.append(row)
                children, leaves, saved, waiting = 0, 0, 0, []
                continue
            leaves = leaves if children else 1
            saved += (n - 1) * size
            row = [False, part, 0, None, _id(key[: (depth - 1) * WIDTH]) if up else None, low, depth, None, n, children, leaves, saved, size, ends or NO_ENDS]
            rows.append(row)
            for w in waiting:
                w[7] = low
            children, waiting = 1, [] if up else [row]
        if not stack:
            break
        up = stack[-1]
        up[3] += n
        up[4] = min(up[4], low)
        up[6] += children
        up[7] += leaves
        up[8] += saved
        up[9] += waiting
    # parents before their children, branches in order of keys, as the pass over open nodes needs them
    for seq, row in enumerate(sorted((r for r in rows if r[0]), key=lambda r: (not first_path(r, first), r[6]))):
        row[2] = seq
    return rows


def first_path(row: list, first: bytes) -> bool:
    """Whether an open node lies on the way to the first key."""
    return row[6] * WIDTH <= len(first) and row[3] == _id(first[: row[6] * WIDTH])


def _grow(batches):
    """One tree over a range of strings in order; equal strings are one key with its smallest conversation, their number and the hash of their ids."""
    tree, key, first, low, n, ends = RadixTree(), None, None, 0, 0, None
    for b in batches:
        for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist()):
            if k != key:
                if key is not None:
                    tree.add(key, (low, n, ends.hexdigest()))
                else:
                    first = k
                key, low, n, ends = k, c, 0, hashlib.sha256()
            ends.update(f"{',' if n else ''}{c}".encode())
            n += 1
    if key is None:
        return
    tree.add(key, (low, n, ends.hexdigest()))
    rows = _nodes(tree, first, key, TaskContext.get().partitionId())
    for at in range(0, len(rows), 8192):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 8192]), _KINDS)], names=_NAMES)


def _join_open(batches):
    """Sums of open nodes over all ranges. A stack holds the nodes on the way to the last string so far; one that leaves it is whole."""
    stack: list[list] = []
    done: list[list] = []

    def leave():
        row = stack.pop()
        row[10] = row[10] if row[9] else 1
        row[11] += (row[8] - 1) * row[12]
        row[13] = row[13] or NO_ENDS
        if stack:
            up = stack[-1]
            up[9] += 1
            up[10] += row[10]
            up[11] += row[11]
        done.append(row)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _KINDS)], names=_NAMES)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in _NAMES)):
            depth = row[6]
            if depth < len(stack) and stack[depth][3] == row[3]:
                had = stack[depth]
                had[5] = min(had[5], row[5])
                for i in (8, 9, 10, 11):
                    had[i] += row[i]
                had[13] = had[13] or row[13]
                continue
            while len(stack) > depth:
                leave()
            stack.append(list(row))
        if len(done) > 8192:
            yield out()
            done.clear()
    while stack:
        leave()
    if done:
        yield out()


def _rebuild(batches):
    """(conv_id, key) of every conversation: the first h turns of its block's first one, then its own after h. A block's first one comes first."""
    base_of, base, convs, keys = None, [], [], []
    for (c, block, h), t in by_key(batches, ["conv_id", "block", "h"]):
        ids = [struct.pack(">qqI", *x) for x in zip(*(t.column(c).to_pylist() for c in ("h1", "h2", "size")))]
        if block != base_of:
            base_of, base = block, []
        if c == block:
            base = ids[:9]
        convs.append(c)
        keys.append(b"".join(base[:h] + ids[h:]))
        if len(convs) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(keys, pa.binary())], names=["conv_id", "key"])
            convs, keys = [], []
    if convs:
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(keys, pa.binary())], names=["conv_id", "key"])


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, key): conversations of rows (conv_id, turn, role, text) that share beginnings. With b = c - c % 5 (the remainder has the sign of c), conversation c begins with
    the first crc32(c) % 9 turns of b (fewer if it has fewer, none if it is absent), and its own turns after as many follow."""
    c = F.col("conv_id").cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = rows.where("conv_id is not null").select(c.alias("conv_id"), (c - c % 5).alias("block"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h"), "turn", role.alias("role"), text.alias("text"))
    dealt = base.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    lean = dealt.select("conv_id", "block", "h", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.octet_length("text").alias("size"))
    return lean.mapInArrow(_rebuild, "conv_id long, key binary")


def trie(keys: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of the trie of keys (conv_id, key: ids of WIDTH bytes, the last four of each the bytes of its text): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0, and conversations without turns end there. Equal conversations are members of the same nodes; an empty table has no nodes. A conversation's ids are held by one task, which
    also hashes the ids of equal conversations as they come. The pass over open nodes is one task that reads two paths a range, whatever the ranges hold.
    """
    spark = keys.sparkSession
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    keys.select("conv_id", "key").write.parquet(f"{folder}/keys")
    keys = spark.read.schema("conv_id long, key binary").parquet(f"{folder}/keys")
    total = keys.agg(F.sum(F.octet_length("key") + 16)).first()[0] or 0
    ranges = max(partitions(spark), -(-total // range_bytes))
    keys.repartitionByRange(ranges, "key").sortWithinPartitions("key", "conv_id").mapInArrow(_grow, _NODE).write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema(_NODE).parquet(f"{folder}/nodes")
    nodes.where("open").repartition(1).sortWithinPartitions("part", "seq").mapInArrow(_join_open, _NODE).write.parquet(f"{folder}/open")
    remove(spark, f"{folder}/keys")
    opened = spark.read.schema(_NODE).parquet(f"{folder}/open")
    known = opened.select(F.col("id").alias("parent"), F.col("conv_id").alias("_of"))
    waiting = nodes.where("not open and parent is not null").unionByName(opened).join(known, "parent", "left").withColumn("parent_conv_id", F.col("_of")).drop("_of")
    out = nodes.where("not open and parent is null").unionByName(waiting)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The same rows in DuckDB; crc32 is spelled out, bit by bit.
ORACLE_SQL = r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
           from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as b,
        xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: list_concat([256 + ascii(substr(conv_id::varchar, i, 1))::bigint], list_transform(range(8), lambda j: 0::bigint))))),
          lambda a, x: case when x > 0 then xor(a, x - 256) else xor(a >> 1, case when a & 1 = 1 then 3988292384::bigint else 0::bigint end) end), 4294967295::bigint) % 9 as h
      from (select distinct conv_id from t)),
r as (select c.conv_id, 0 as own, k, role, text from c join t on t.conv_id = b where k <= h union all select c.conv_id, 1, k, role, text from c join t on t.conv_id = c.conv_id where k > h),
p as (select *, row_number() over w as depth, md5(string_agg(md5(role || chr(1) || md5(text)), '' ) over w) as node from r window w as (partition by conv_id order by own, k)),
m as (select conv_id, depth, node, strlen(text) as size from p union all select conv_id, 0, 'root', 0 from c),
l as (select conv_id, max(depth) as len from m group by 1),
n as (select node, depth, min(m.conv_id) as conv_id, count(*) as n_convs, max(size) as size, string_agg(case when len = depth then m.conv_id::varchar end, ',' order by m.conv_id) as ends from m join l on m.conv_id = l.conv_id group by node, depth),
u as (select n.*, q.node as parent, pn.conv_id as parent_conv_id from n left join m q on q.conv_id = n.conv_id and q.depth = n.depth - 1 left join n pn on pn.node = q.node and pn.depth = q.depth),
k as (select parent, depth - 1 as depth, count(*) as n_children from u where depth > 0 group by all),
v as (select u.*, coalesce(n_children, 0) as n_children from u left join k on u.node = k.parent and u.depth = k.depth),
s as (select a.node, a.depth, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * v.size) as saved from v join m a on a.conv_id = v.conv_id and a.depth <= v.depth group by 1, 2)
select v.conv_id, v.depth::bigint as depth, parent_conv_id, n_convs, n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from v join s on v.node = s.node and v.depth = s.depth
"""
