"""Conversation repair: the cheapest edits that make a damaged conversation take turns, found by a bidirectional Dijkstra search.

The lattice has a node for each number of rows consumed and each state of the machine for `(s?(ua)+)?`. Keep, Rerole and Delete consume a
row, Insert adds one. A forward and a reverse heap grow until their least costs together exceed the best crossing, so all crossings of
that cost are known; of these the one with the least concatenated audit wins. Long conversations are cut into blocks of rows, whose
tables of least cost and audit from state to state are joined in pairs.

Spark deals rows by conversation, in order of turns, twice. The first pass sees a byte and a 128-bit hash of each row, never its text; the second reads the
audit first and hashes the texts as they come, so a conversation of any length is streamed through its task.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import id_key, table

#: Rows of a conversation in one lattice.
BLOCK = 64
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
FINAL = (START, AFTER_ASSISTANT)
#: State after a role's initial; roles not named here are out of order in that state.
NEXT = ({"s": AFTER_SYSTEM, "u": AFTER_USER}, {"u": AFTER_USER}, {"a": AFTER_ASSISTANT}, {"u": AFTER_USER})
#: What Rerole and Insert make in each state: the one role of user and assistant that may come.
MADE = tuple(n["u"] if "u" in n else n["a"] for n in NEXT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row in the lattice: its role's initial (upper case where its text is truncated), or - where it must go.
GONE = "-"


def steps(rows: str, i: int, state: int):
    """(letter, cost, rows consumed, state) of every edit from a node."""
    yield "I", INSERT, i, MADE[state]
    if i < len(rows):
        yield "D", DELETE, i + 1, state
        if rows[i] != GONE:
            late = TRUNCATED if rows[i].isupper() else 0
            yield "R", REROLE + late, i + 1, MADE[state]
            if rows[i].lower() in NEXT[state]:
                yield "K", late, i + 1, NEXT[state][rows[i].lower()]


def steps_back(rows: str, i: int, state: int):
    """(letter, cost, rows consumed, state) of every edit into a node, by the node it comes from."""
    for before in range(4):
        for at in (i, i - 1):
            if at >= 0:
                for letter, cost, j, after in steps(rows, at, before):
                    if j == i and after == state:
                        yield letter, cost, at, before


@lru_cache(maxsize=1 << 16)
def search(rows: str, begin: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state begin to one of ends over all rows; of equal costs the least audit.

    Labels are ordered by cost, then by rows consumed, as Keep may cost nothing but always consumes a row; so a label is final when it leaves its heap. Two audits
    of one cost to one node are never the beginning of one another, so the least audit goes through the least audits of its parts.
    """
    n = len(rows)
    best: list[dict] = [{}, {}]  # of each side, node: (cost, audit), final
    seen: list[dict] = [{(0, begin): (0, "")}, {(n, e): (0, "") for e in ends}]
    heaps: list[list] = [[(0, 0, begin)], [(0, 0, e) for e in sorted(ends)]]
    least = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= least:
        side = heaps[1][0][0] < heaps[0][0][0]
        cost, i, state = heapq.heappop(heaps[side])
        node = (n - i if side else i, state)
        if node in best[side] or seen[side][node][0] < cost:
            continue
        label = best[side][node] = seen[side][node]
        if node in seen[not side]:
            least = min(least, cost + seen[not side][node][0])
        for letter, more, i, state in (steps_back if side else steps)(rows, *node):
            new = (cost + more, letter + label[1] if side else label[1] + letter)
            if (i, state) not in best[side] and new < seen[side].get((i, state), (float("inf"), "")):
                if new[0] < seen[side].get((i, state), (float("inf"),))[0]:
                    heapq.heappush(heaps[side], (new[0], n - i if side else i, state))
                seen[side][i, state] = new
                if (i, state) in seen[not side]:
                    least = min(least, new[0] + seen[not side][i, state][0])
    found = [(label[0] + best[1][node][0], label[1] + best[1][node][1]) for node, label in best[0].items() if node in best[1]]
    found += [best[0][n, e] for e in ends if (n, e) in best[0]]
    found += [best[1][0, begin]] if (0, begin) in best[1] else []
    for node, label in best[0].items():
        for letter, more, i, state in steps(rows, *node):
            if (i, state) in best[1]:
                rest = best[1][i, state]
                found.append((label[0] + more + rest[0], label[1] + letter + rest[1]))
    return min(found, default=None)


def _joined(a: dict, b: dict) -> dict:
    """The table of two blocks, one after the other."""
    out: dict = {}
    for (s, m), (cost, audit) in a.items():
        for (m2, e), (more, rest) in b.items():
            if m == m2 and cost + more <= out.get((s, e), (float("inf"),))[0]:
                out[s, e] = min(out.get((s, e), (float("inf"), "")), (cost + more, audit + rest))
    return out


def repair(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a whole conversation."""
    if len(rows) <= BLOCK:
        return search(rows, START, FINAL)
    tables = [{(s, e): found for s in range(4) for e in range(4) if (found := search(rows[k : k + BLOCK], s, (e,)))} for k in range(0, len(rows), BLOCK)]
    while len(tables) > 1:
        tables = [_joined(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return min(tables[0][START, e] for e in FINAL if (START, e) in tables[0])


def _by_conversation(batches):
    """The batches cut where a conversation begins: (whether it begins here, batch)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column("_c").to_numpy(), b.column("_null").cast(pa.int64()).to_numpy()])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(key[:, lo].tolist())
            yield now != last, now, b.slice(lo, hi - lo)
            last = now


_FOUND = "_c long, _null boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


class _Faults:
    """What is known of one conversation: a byte and a hash of each row."""

    def __init__(self):
        self.rows, self.seen, self.last = [], set(), ""
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, b: pa.RecordBatch) -> None:
        for turn, initial, blank, cut, *key in zip(*(b.column(c).to_pylist() for c in ("turn", "initial", "blank", "cut", "h1", "h2"))):
            if turn is not None and turn != self.turn:
                self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
            self.illegal += bool(self.rows) and self.last + initial not in ("su", "ua", "au")
            self.last = initial
            repeated = tuple(key) in self.seen
            self.seen.add(tuple(key))
            self.blank += blank
            self.duplicate += repeated and not blank
            cut = cut and not repeated and not blank
            self.truncated += cut
            letter = initial if initial in ("s", "u", "a") else "x"
            self.rows.append(GONE if blank or repeated else letter.upper() if cut else letter)

    def row(self) -> list:
        cost, audit = repair("".join(self.rows))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit]


def _find(batches):
    now, held, keys, rows = None, None, [], []

    def out():
        cells = list(zip(*rows))
        kinds = [pa.int64()] * 6 + [pa.string()]
        arrays = [pa.array([k[0] for k in keys], pa.int64()), pa.array([bool(k[1]) for k in keys]), *[pa.array(c, k) for c, k in zip(cells, kinds)]]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    for new, key, b in _by_conversation(batches):
        if new:
            if held:
                keys.append(now)
                rows.append(held.row())
                if len(keys) == 1024:
                    yield out()
                    keys, rows = [], []
            now, held = key, _Faults()
        held.add(b.filter(b.column("there")))
    if held:
        keys.append(now)
        rows.append(held.row())
        yield out()


class _Writer:
    """The SHA-256 of one conversation's repaired rows, each as role:text, joined by line feeds."""

    def __init__(self, audit: str):
        self.audit, self.k, self.state, self.sum, self.any = audit, 0, START, hashlib.sha256(), False
        self.inserts()

    def put(self, role: str, text: bytes) -> None:
        self.sum.update((b"\n" if self.any else b"") + role.encode() + b":" + text)
        self.state, self.any = NEXT[self.state][role[0]], True

    def made(self) -> str:
        return "user" if MADE[self.state] == AFTER_USER else "assistant"

    def inserts(self) -> None:
        while self.audit[self.k : self.k + 1] == "I":
            self.put(self.made(), b"")
            self.k += 1

    def row(self, role: str, text: pa.Scalar) -> None:
        letter = self.audit[self.k]
        self.k += 1
        if letter != "D":
            self.put(role if letter == "K" else self.made(), text.as_py().encode())
        self.inserts()


def _write(batches):
    """What was found of each conversation, which comes before its rows, and the sum of its rows."""
    heads, sums, now = [], [], None

    def out():
        return pa.RecordBatch.from_arrays([pa.concat_arrays(heads), pa.array([x.sum.hexdigest() for x in sums])], names=["found", "repaired_sha256"])

    for new, _, b in _by_conversation(batches):
        if new:
            if len(heads) == 1024:
                yield out()
                heads, sums = [], []
            heads.append(b.column("found").slice(0, 1))
            sums.append(_Writer(heads[-1][0].as_py()["audit"]))
            b = b.slice(1)
        for role, text in zip(b.column("role").to_pylist(), b.column("text")):
            sums[-1].row(role, text)
    if heads:
        yield out()


def repair_chats(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, and there, by default true): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are in order of turn, null first, then of role, text. Each row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier),
    truncated (the last such character is not . ! or ?). A null role or text is one space. Rows that are not there only name their conversation: one without other rows has
    zeros, an empty audit and the hash of an empty string. A null conversation is one of its own. An empty table gives an empty table; texts may be of any length, and a conversation of any
    length is streamed (17 bytes a row and the audit are held). Other columns are ignored. Seen rows are told by 128 bits of hash within a conversation.
    """
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    word = r"[^\x20\x09-\x0D]"
    body, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    base = rows.select(id_key(conv_col).alias("_c"), F.col(conv_col).isNull().alias("_null"), F.col("turn").cast("long").alias("turn"), role.alias("role"), body.alias("text"), there.alias("there"))
    order = ["_c", "_null", F.asc_nulls_first("turn"), "role", "text"]
    lean = base.repartition("_c", "_null").sortWithinPartitions(*order).select(
        "_c", "_null", "turn", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(word)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), "there",
    )
    found = lean.mapInArrow(_find, _FOUND)
    heads = found.select("_c", "_null", F.lit(0).alias("_tail"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*_NAMES).alias("found"))
    tails = base.where("there").select("_c", "_null", F.lit(1).alias("_tail"), "turn", "role", "text", F.lit(None).cast(heads.schema["found"].dataType).alias("found"))
    both = heads.unionByName(tails).repartition("_c", "_null").sortWithinPartitions("_c", "_null", "_tail", *order[2:])
    schema = StructType([both.schema["found"]]).add("repaired_sha256", "string")
    out = both.select("_c", "_null", "found", "role", "text").mapInArrow(_write, schema)
    return out.select(F.when(~F.col("found._null"), F.col("found._c")).cast(rows.schema[conv_col].dataType).alias(conv_col), *[F.col(f"found.{c}") for c in _NAMES[2:]], "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """conversations with there (false where the row is dropped), damaged by crc32 of `conv_id:turn` modulo 20; a null is one space there."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = one("text")
    damaged = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), damaged.alias("text"), (kind != 0).alias("there"), copies.alias("_copy")).drop("_copy")


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: The same rows in DuckDB: crc32 spelled out bit by bit, and the cheapest edits row by row, each state with its least audit after up to two inserts.
ORACLE_SQL = r"""
with recursive k as (select conv_id, turn, role, text, concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')) as named from conversations),
c as (select *, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(named) + 1), lambda i: list_concat([256 + ascii(substr(named, i, 1))::bigint], list_transform(range(8), lambda j: 0::bigint))))),
  lambda a, x: case when x > 0 then xor(a, x - 256) else xor(a >> 1, case when a & 1 = 1 then 3988292384::bigint else 0::bigint end) end), 4294967295::bigint) % 20 as kind from k),
d as (select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role, case kind when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text
  from c, unnest(case when kind = 3 then [0, 1] else [0] end) as u(j) where kind <> 0),
o as (select *, row_number() over w as i, substr(role, 1, 1) as l, lag(substr(role, 1, 1)) over w as before, 
  not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut from d window w as (partition by conv_id order by turn nulls first, role, text)),
g as (select *, i > min(i) over (partition by conv_id, role, text) as again from o),
f as materialized (select *, blank or again as gone, cut and not blank and not again as late from g),
n as materialized (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate, count(*) filter (where late) as truncated,
  count(*) filter (where i > 1 and before || l not in ('su', 'ua', 'au')) as illegal from f group by 1),
r as (select conv_id, 0::bigint as i, st, cost, audit from n, (values ('', 0, ''), ('u', 2, 'I'), ('a', 4, 'II')) v(st, cost, audit)
  union all
  select conv_id, i, st, cost, audit from (
    select conv_id, i, case when j = 0 then st when (j = 1) = (st = 'u') then 'a' else 'u' end as st, cost + 2 * j as cost, audit || repeat('I', j) as audit from (
      select r.conv_id, f.i, case e when 'D' then r.st when 'K' then f.l else case when r.st = 'u' then 'a' else 'u' end end as st, r.cost + case e when 'D' then 3 when 'R' then 2 + late::int else late::int end as cost, r.audit || e as audit
      from r join f on f.conv_id is not distinct from r.conv_id and f.i = r.i + 1, unnest(['D', 'K', 'R']) q(e)
      where e = 'D' or not gone and (e = 'R' or r.st || f.l in ('s', 'u', 'su', 'ua', 'au'))) x, unnest([0, 1, 2]) y(j)) z
  qualify row_number() over (partition by conv_id, st order by cost, audit) = 1),
b as (select n.*, r.cost, r.audit from n join r on r.conv_id is not distinct from n.conv_id and r.i = n.n where st in ('', 'a') qualify row_number() over (partition by n.conv_id order by r.cost, r.audit) = 1),
p as (select conv_id, k, substr(audit, k, 1) as e, length(replace(substr(audit, 1, k), 'I', '')) as i, length(replace(substr(audit, 1, k), 'D', '')) as m from b, unnest(range(1, length(audit) + 1)) u(k)),
s as (select p.*, f.role, f.text, max(case when m = 1 and e = 'K' and f.l = 's' then 1 else 0 end) over (partition by p.conv_id) as sys from p left join f on f.conv_id is not distinct from p.conv_id and f.i = p.i and p.e <> 'I'),
t as (select conv_id, string_agg(case when e = 'K' then role when (m - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by k) as t from s where e <> 'D' group by 1)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join b on b.conv_id is not distinct from a.conv_id left join t on t.conv_id is not distinct from a.conv_id
"""
