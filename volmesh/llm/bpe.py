"""Byte-level BPE by backtracking: longest token matches, checked against a table of compatible pairs, give the exact merges.

For each pre-token one pass of an Aho-Corasick automaton finds the longest token at every position. The encoder takes the longest
match, and keeps it if it is compatible with the token before: two tokens are compatible if merging their joined bytes leaves exactly
the two. Otherwise it tries the next shorter token that is a prefix, and where none is left it takes back the token before. A
sequence whose neighbours are all compatible is the one that the merges give. A position that was given up is never tried again, so
the steps grow with the length. Decoding reads token bytes from one table by offsets.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .shared import fields, table

#: The pre-tokenizer of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a Python worker remembers, none longer than so many characters.
REMEMBERED, REMEMBERED_CHARS = 700_000, 40
NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable in Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        to_byte = byte_alphabet()
        raw = lambda s: "".join(chr(to_byte[c]) for c in s)  # noqa: E731  Latin-1: a character for each byte
        self.id = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}  # of a pair: when it merges, and into what
        self.halves: dict[int, tuple[int, int, int]] = {}
        for when, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.id[a + b]
            self.rank[self.id[a], self.id[b]] = (when, made)
            self.halves.setdefault(made, (self.id[a], self.id[b], when))
        self.text = {i: s for s, i in self.id.items()}
        self.size = {i: len(s) for i, s in self.text.items()}
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.compatible: dict[int, bool] = {}
        self.reach = {i for i in self.text if i not in self.halves or self._whole(i)}
        self.automaton = ahocorasick.Automaton()
        for i in self.reach:
            self.automaton.add_word(self.text[i], i)
        self.automaton.make_automaton()
        self.shorter = {}
        for i in self.reach:
            s = self.text[i]
            self.shorter[i] = next((j for k in range(len(s) - 1, 0, -1) if (j := self.id.get(s[:k])) in self.reach), None)
        size = max([*self.text, *self.special.values()]) + 1
        parts = [b""] * size
        for i, s in self.text.items():
            parts[i] = s.encode("latin-1")
        for s, i in self.special.items():
            parts[i] = s.encode()
        self.table = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that are in turn at the token's right (left) end while it is built, and when each is merged into the next."""
        got = self._edges.get((token, right))
        if got is None:
            got, t, until = [], token, NEVER
            while True:
                got.append((t, until))
                if t not in self.halves:
                    break
                a, b, until = self.halves[t]
                t = b if right else a
            got.reverse()
            self._edges[token, right] = got
        return got

    def _whole(self, token: int) -> bool:
        """Whether a token's own bytes merge into it: its halves are whole, and nothing crosses their border before they meet."""
        a, b, when = self.halves[token]
        return self._apart(a, b, when) and all(x not in self.halves or self._whole(x) for x in (a, b))

    def _apart(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether no merge crosses the border of two tokens before `until`."""
        x, y = self._edge(left, True), self._edge(right, False)
        i = j = 0
        while True:
            (a, when_a), (b, when_b) = x[i], y[j]
            cross = self.rank.get((a, b))
            if cross and cross[0] < until and cross[0] < when_a and cross[0] <= when_b:  # of equal pairs the left one merges first
                return False
            if when_a >= until and when_b >= until or when_a == when_b == NEVER:
                return True
            if when_a <= when_b:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        k = left << 20 | right
        got = self.compatible.get(k)
        if got is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            got = self.compatible[k] = self._apart(left, right)
        return got

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        s = piece if piece.isascii() else piece.encode().decode("latin-1")
        n = len(s)
        longest = [0] * n
        size, known, fits, shorter = self.size, self.compatible.get, self.fits, self.shorter
        for end, i in self.automaton.iter(s):  # ends ascend, so the last match from a position is its longest
            longest[end - size[i] + 1] = i
        token = longest[0]
        if size[token] == n:
            return [token]
        out: list[int] = []
        closed = set()
        at, last = 0, -1
        while True:
            end = at + size[token]
            if end not in closed and (last < 0 or (known(last << 20 | token) or fits(last, token))):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
                continue
            token = shorter[token]
            if token is None:
                closed.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def parts(self, text: str):
        """(part, whether it is a special token) of a text."""
        if self.specials is None or not self.specials.search(text):
            return [(text, False)]
        return [(x, x in self.special) for x in self.specials.split(text) if x]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        to = np.cumsum(size) - size
        return self.table[np.arange(int(size.sum())) + np.repeat(start - to, size)]


class _Remembered(dict):
    """Pre-token to its ids as 32-bit integers."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        got = array("i", self.bpe.encode_piece(piece)).tobytes()
        if len(self) < REMEMBERED and len(piece) <= REMEMBERED_CHARS:
            self[piece] = got
        return got


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[Bpe, _Remembered]:
    """Once a Python worker."""
    bpe = Bpe(path)
    return bpe, _Remembered(bpe)


def ids_of(text: str | None, bpe: Bpe, memory: _Remembered) -> bytes:
    if not text:
        return b""
    got = memory.__getitem__
    return b"".join([np.int32(bpe.special[x]).tobytes() if special else b"".join(map(got, bpe.pieces(x))) for x, special in bpe.parts(text)])


def _text_array(body: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts from bytes; what is not UTF-8 becomes U+FFFD, as decode(errors="replace") does."""
    begins = body[bounds[:-1][bounds[:-1] < len(body)]]
    raw = body.tobytes()
    try:
        raw.decode()
        whole = not ((begins & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if not whole:
        return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(bounds[:-1], bounds[1:])], pa.string())
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(raw)).cast(pa.string())


def _encode(path: str, text_col: str, carried: list[str], decoded: bool):
    def run(batches):
        bpe, memory = loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                each = [ids_of(t, bpe, memory) for t in b.column(text_col).to_pylist()]
                ids = np.frombuffer(b"".join(each), dtype="<i4")
                off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in each])])
                out = {c: b.column(c) for c in carried} | {"ids": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))}
                if decoded:
                    body = np.concatenate([bpe.decode(ids[i : i + (1 << 18)]) for i in range(0, len(ids), 1 << 18)] or [np.zeros(0, np.uint8)])
                    size = np.concatenate([[0], np.cumsum(bpe.offset[ids + 1] - bpe.offset[ids])])
                    out["decoded"] = _text_array(body, size[off])
                yield pa.RecordBatch.from_pydict(out)

    return run


def _decode(path: str, ids_col: str, carried: list[str]):
    def run(batches):
        bpe, _ = loaded(path)
        for b in batches:
            lists = b.column(ids_col)
            lists = lists.fill_null([]) if lists.null_count else lists
            ids, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            size = np.concatenate([[0], np.cumsum(bpe.offset[ids + 1] - bpe.offset[ids])])
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in carried} | {"decoded": _text_array(bpe.decode(ids), size[off])})

    return run


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """docs without text_col, and ids (array<int>) of each whole text; with decoded also the text that the ids give.

    vocabulary: path of a byte-level BPE in the JSON of the tokenizers library, at the same place on each executor. Ids are those of that
    library without added special tokens; its special strings in a text become their ids. Null and empty texts have no ids (and give ""). Repeated
    rows each get their row. An empty table gives an empty table; texts may be of any length. Input columns named ids or decoded are replaced; other names don't matter.
    """
    carried = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]
    out = fields(docs, carried).add("ids", ArrayType(IntegerType()))
    out = out.add("decoded", "string") if decoded else out
    return docs.select(*[F.col(f"`{c}`") for c in [*carried, text_col]]).mapInArrow(_encode(vocabulary, text_col, carried, decoded), out)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """rows without ids_col, and decoded: the text of the ids, special tokens included; null gives "". An input column named decoded is replaced."""
    carried = [c for c in rows.columns if c not in (ids_col, "decoded")]
    return rows.select(*[F.col(f"`{c}`") for c in [*carried, ids_col]]).mapInArrow(_decode(vocabulary, ids_col, carried), fields(rows, carried).add("decoded", "string"))


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
