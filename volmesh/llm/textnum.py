"""Words of many texts at once, as arrays: Arrow's text buffer is cut, hashed and rejoined without a Python string for each word.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. All white space is ASCII, so bytes of UTF-8 serve as well as code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one at a time.
LONG_WORD = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, and 8 zero bytes
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # index of each text's first word; one more entry than texts


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    off = off - off[0]
    if lower:
        body = _LOWER[body]
    gap = _SPACE[body]
    size = len(body)
    starts = np.ones(size, dtype=bool)
    starts[1:] = gap[:-1]
    starts[off[:-1][off[:-1] < size]] = True
    ends = np.ones(size, dtype=bool)
    ends[:-1] = gap[1:]
    ends[off[1:][off[1:] > 0] - 1] = True
    start = np.flatnonzero(starts & ~gap)
    end = np.flatnonzero(ends & ~gap) + 1
    return Words(np.concatenate([body, np.zeros(8, dtype=np.uint8)]), start, end, np.searchsorted(start, off))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = w.end - w.start
    h = size.astype(U64) * BASE
    eight = np.ndarray(len(w.data) - 7, dtype="<u8", buffer=w.data, strides=(1,))
    at, left, live = w.start, size, None
    for k in range(0, LONG_WORD, 8):
        if k:
            live = np.flatnonzero(size > k)
            if not len(live):
                break
            at, left = w.start[live] + k, size[live] - k
        chunk = eight[at] & _KEEP[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ chunk)
        else:
            h[live] = mix((h[live] * BASE) ^ chunk)
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(w.data[w.start[i] : w.end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every n consecutive values: sum of x[i + j] * BASE**(n - 1 - j)."""
    if len(x) < n:
        return np.zeros(0, dtype=U64)
    out, have, part, width, power = None, 0, x, 1, BASE
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, have = part, width
            else:  # what is built so far, then the next width values
                m = len(x) - have - width + 1
                out, have = out[:m] * power + part[have : have + m], have + width
        rest >>= 1
        if rest:
            part = part[:-width] * power + part[width:]
            power = U64(int(power) * int(power) % 2**64)
            width *= 2
    return out


def runs(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of n words that lies in one text, and how many each text has."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    total = int(count.sum())
    skip = np.cumsum(count) - count
    return np.arange(total) + np.repeat(first[:-1] - skip, count), count


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """For each text its kept words joined by one space."""
    kept = np.flatnonzero(keep)
    per = np.diff(np.searchsorted(kept, w.first))
    size = w.end[kept] - w.start[kept] + 1
    to = np.cumsum(size) - size
    body = w.data[np.arange(int(size.sum())) + np.repeat(w.start[kept] - to, size)]
    body[to + size - 1] = 0x20
    bounds = np.concatenate([[0], np.cumsum(size)])
    last = np.cumsum(per)
    end = bounds[last]
    drop = np.zeros(len(body), dtype=bool)  # the space after each text's last word
    drop[end[per > 0] - 1] = True
    body = body[~drop]
    off = np.concatenate([[0], end - np.cumsum(per > 0)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(per), pa.py_buffer(off.tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
