"""Quality classifier: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Numbers are taken from each whole text with array operations on Arrow's buffer. The model is fitted on a bounded sample of labelled rows:
round after round, every feature in turn gets a tree of at most four leaves over its bins, and what the trees add is kept in one
lookup table a feature; then the pairs with the largest remaining gain get tables of their own. A score is the sum of table
entries that a text's bins select.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import fields, one_chunk, table

#: Labelled rows that a model is fitted on, at most; the ones whose ids' hashes are smallest.
TRAINING_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIRS, RATE, SMOOTH = 32, 8, 150, 6, 0.2, 5.0
THRESHOLD = 0.3
FEATURES = ("words", "word_bytes", "symbols", "symbol_words", "bars", "shouts", "capitals", "capital_words", "digits", "stops", "lines", "line_words", "beyond_ascii", "distinct_words", "distinct_triples", "longest_word")
_CLASS = {"symbols": b"#*$%&|<>", "bars": b"|", "shouts": b"!?", "digits": b"0123456789", "stops": b".,;:", "lines": b"\n"}


def _lookup(chars: bytes) -> np.ndarray:
    got = np.zeros(256, dtype=np.uint8)
    got[list(chars)] = 1
    return got


_TABLES = {k: _lookup(v) for k, v in _CLASS.items()} | {"capitals": _lookup(bytes(range(65, 91))), "letters": _lookup(bytes([*range(65, 91), *range(97, 123)])), "beyond_ascii": _lookup(bytes(range(128, 256)))}


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the slices that begin at first[:-1]; an empty slice gives 0."""
    out = np.zeros(len(first) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], dtype=np.int64)
    return out


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    key = np.sort((h >> np.uint64(20)) | (doc.astype(np.uint64) << np.uint64(44)))
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty."""
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    w = tn.split(texts)
    n = len(texts)
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]) if n else np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    body = w.data[:-8]
    count = {k: _sum(t[body], edge) for k, t in _TABLES.items()}
    words, length = np.diff(w.first), w.end - w.start
    doc = np.repeat(np.arange(n), words)
    h = tn.word_hashes(w)
    at, triples = tn.runs(w.first, 3)
    triple = tn.mix(tn.rolling(h, 3)[at]) if len(at) else h[:0]
    last = w.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    marked = _TABLES["symbols"][last]
    second = w.data[w.start + 1] if len(h) else last
    shout = _TABLES["capitals"][second] & (length > 1)
    longest = np.zeros(n)
    full = np.flatnonzero(words > 0)
    if len(full):
        longest[full] = np.maximum.reduceat(length, w.first[full])
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    cols = {
        "words": np.log1p(words), "word_bytes": _sum(length, w.first) / per_word, "symbols": count["symbols"] / per_byte, "symbol_words": _sum(marked, w.first) / per_word,
        "bars": count["bars"] / per_word, "shouts": count["shouts"] / per_word, "capitals": count["capitals"] / np.maximum(count["letters"], 1), "capital_words": _sum(shout.astype(np.uint8), w.first) / per_word,
        "digits": count["digits"] / per_byte, "stops": count["stops"] / per_word, "lines": np.log1p(count["lines"]), "line_words": words / (count["lines"] + 1), "beyond_ascii": count["beyond_ascii"] / per_byte,
        "distinct_words": _distinct(h, doc, n) / per_word, "distinct_triples": _distinct(triple, np.repeat(np.arange(n), triples), n) / np.maximum(triples, 1), "longest_word": np.log1p(longest),
    }
    return np.stack([cols[f].astype(float) for f in FEATURES], axis=1)


@dataclass
class Model:
    start: float
    edges: list[np.ndarray]  # of each feature's bins
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    coarse: list[np.ndarray]  # for each feature, the pair bin of each bin

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row."""
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        total = np.full(len(x), self.start)
        for b, t in zip(bins, self.tables):
            total += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-total))


def _leaf(g, h):
    return -g / (h + SMOOTH)


def _gain(g, h):
    return g * g / (h + SMOOTH)


def _split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """The best cut of bins lo to hi: its gain, and the first bin of the right side."""
    if hi - lo < 2:
        return 0.0, lo
    cg, ch = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
    gains = _gain(cg, ch) + _gain(all_g - cg, all_h - ch) - _gain(all_g, all_h)
    k = int(np.argmax(gains))
    return float(gains[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a tree of depth two adds to each bin."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        cuts = [(lo, hi, *_split(g, h, lo, hi)) for lo, hi in parts]
        parts = [p for lo, hi, gain, cut in cuts for p in ([(lo, cut), (cut, hi)] if gain > 1e-9 else [(lo, hi)])]
    for lo, hi in parts:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four quadrants of a grid: their gain, and what they add to each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = 0.0, None
    whole = _gain(cg[-1, -1], ch[-1, -1])
    for i in range(g.shape[0] - 1):
        a, ah = cg[i, :-1], ch[i, :-1]
        b, bh = cg[i, -1] - a, ch[i, -1] - ah
        c, ch_ = cg[-1, :-1] - a, ch[-1, :-1] - ah
        d, dh = cg[-1, -1] - a - b - c, ch[-1, -1] - ah - bh - ch_
        gains = _gain(a, ah) + _gain(b, bh) + _gain(c, ch_) + _gain(d, dh) - whole
        j = int(np.argmax(gains))
        if gains[j] > best:
            best, at = float(gains[j]), (i + 1, j + 1)
    out = np.zeros_like(g)
    if at:
        i, j = at
        for rows in (slice(0, i), slice(i, None)):
            for cols in (slice(0, j), slice(j, None)):
                out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x with labels y (0 or 1). Without rows every score is 0.5; with one label only, the share of it (smoothed)."""
    count = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for f in range(count)]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [], [(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1)) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    total = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        for f in range(count):
            p = 1 / (1 + np.exp(-total))
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], p - y, n), np.bincount(bins[f], p * (1 - p), n))
            model.tables[f] += step
            total += step[bins[f]]
    p = 1 / (1 + np.exp(-total))
    coarse = [model.coarse[f][bins[f]] for f in range(count)]
    grid = lambda v, i, j: np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    ranked = sorted(((_pair_tree(grid(p - y, i, j), grid(p * (1 - p), i, j))[0], i, j) for i in range(count) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(ROUNDS // 3):
        for k, (i, j) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _pair_tree(grid(p - y, i, j), grid(p * (1 - p), i, j))[1]
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def fold(id_col: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Model:
    """The model of at most `rows` labelled texts whose fold is not 0. Of several labels of an id the largest counts; null labels and ids don't. Null and
    empty texts count as empty, rows that share an id as one (the smallest features), and without any row the model scores 0.5. Other columns are not read."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null").where(fold("_id") != 0)
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # at most `rows` ids and labels, 12 bytes each, go to the executors
    found = slim.join(F.broadcast(known), "_id")

    def numbers(batches):
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            x = features(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # back come as many rows of 16 numbers, and more only where rows repeat: of those one stays
    got = found.select("_id", "_y", "_text").mapInArrow(numbers, "id long, y int, x array<double>").groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow().sort_by("id")
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("y").to_pylist(), dtype=float))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, and score (0 to 1, for every text, null and empty ones too) and predicted (1 if score >= threshold). Input columns of these names are replaced; other
    names don't matter. Repeated rows get equal scores, an empty table gives an empty table, and texts may be of any length."""
    carried = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                s = model.score(features(one_chunk(b.column(text_col))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*carried, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in carried]).mapInArrow(run, fields(docs, carried).add("score", "double").add("predicted", "integer"))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
