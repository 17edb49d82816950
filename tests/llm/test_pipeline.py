"""The stages of the corpus pipeline against plain Python, each on what the stage before it kept."""

import random
import zlib
from bisect import bisect_right
from collections import Counter
from math import exp, log1p

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_corpus import VOCABULARY, WORD, log_ratios
from volmesh.llm import quality_gam


def documents() -> tuple[list, list]:
    r = random.Random(8)
    good, bad = [f"g{i}é" for i in range(400)] + ["The", "of"], [f"B{i}#|" for i in range(400)] + ["!!", "$1"]
    passage, rows = " ".join(r.choice(good) for _ in range(30)), []
    for i in range(160):
        t = [r.choice(good if r.random() < (0.95, 0.95, 0.5, 0.03)[i % 4] else bad) for _ in range(r.randint(30, 160))]
        rows.append((i, " ".join(t[:20]) + "\n" + " ".join(t[20:]) + ("\n" + passage) * (i % 9 == 0)))
    rows += [(200 + i, rows[4 * i][1].replace(" ", "  ", 2) + " end") for i in range(12)] + [(220, rows[1][1]), (221, None), (222, ""), (223, "x y x y " * 40)]
    return rows, [(i, int(i % 4 < 2), 0) for i in range(150)] + [(200 + i, 1, 0) for i in range(21)] + [(None, 1, 0), (999, 1, 0)]


def score(model, text: str) -> float:
    b = (text or "").encode()
    w, n, lines = [x.encode() for x in WORD.findall(text or "")], max(len(WORD.findall(text or "")), 1), b.count(b"\n")
    count = lambda chars: sum(c in chars for c in b)
    upper = bytes(range(65, 91))
    triples = list(zip(w, w[1:], w[2:]))
    f = {
        "words": log1p(len(w)), "word_bytes": sum(map(len, w)) / n, "symbols": count(b"#*$%&|<>") / max(len(b), 1), "symbol_words": sum(x[-1] in b"#*$%&|<>" for x in w) / n, "bars": count(b"|") / n,
        "shouts": count(b"!?") / n, "capitals": count(upper) / max(count(upper + upper.lower()), 1), "capital_words": sum(len(x) > 1 and x[1] in upper for x in w) / n, "digits": count(b"0123456789") / max(len(b), 1),
        "stops": count(b".,;:") / n, "lines": log1p(lines), "line_words": len(w) / (lines + 1), "beyond_ascii": sum(c > 127 for c in b) / max(len(b), 1), "distinct_words": len(set(w)) / n,
        "distinct_triples": len(set(triples)) / max(len(triples), 1), "longest_word": log1p(max(map(len, w), default=0)),
    }
    at = [bisect_right(list(e), f[name]) for e, name in zip(model.edges, quality_gam.FEATURES)]
    total = model.start + sum(t[k] for t, k in zip(model.tables, at)) + sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
    return 1 / (1 + exp(-total))


def rules(spark, rows, labels):
    def failed(ws):
        c = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {j for k in range(len(ws) - 2) if c[tuple(ws[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        return len(ws) < 50 or 100 * len(covered) > 50 * len(ws)

    ratio = log_ratios(spark, rows, {i for i, y, _ in labels if y == 1})
    return [x for x, v in zip(rows, ratio) if v >= -0.12 and not failed(WORD.findall(x[1] or ""))]


def one_of_each(rows):
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in [WORD.findall("".join(c.lower() if c.isascii() else c for c in t)) for _, t in rows]]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(grams[a] & grams[b])
            if both and 100 * both >= 80 * len(grams[a] | grams[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min(x for x, g in zip(rows, group) if g == k) for k in set(group)]


def without_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        ws, gone = WORD.findall(t), set()
        for k in range(len(ws) - 19):
            if tuple(ws[k : k + 20]) in seen:
                gone.update(range(k, k + 20))
            seen.add(tuple(ws[k : k + 20]))
        out.append((i, " ".join(x for k, x in enumerate(ws) if k not in gone) if gone else t))
    return out


def pieces(rows):
    t = Tokenizer.from_file(VOCABULARY)
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 1024):
            yield i, k, len(ids[k : k + 1024]), zlib.crc32(np.array(ids[k : k + 1024], "<u4"))


def test_stages(spark, tmp_path):
    rows, labels = documents()
    folder = f"{tmp_path}/data"
    first = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    first.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r.doc_id: r.score for r in quality_gam.score(docs, model).collect()} == pytest.approx({i: score(model, t) for i, t in rows}, abs=1e-9)
    plain = {
        "quality_classifier": lambda x: [d for d in x if score(model, d[1]) >= 0.3], "quality_rules": lambda x: rules(spark, x, labels),
        "ngram_jaccard_join": one_of_each, "substring_dedup": without_repeats,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain[name](rows)
        assert want and sorted(want, key=str) != sorted(rows, key=str), name  # each stage has something to do
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(tuple, docs.select("doc_id", "text", "n_chars").collect()), key=str) == sorted([(i, t, len(t or "")) for i, t in want], key=str), name
        rows = want
    for out in (corpus_pipeline.STAGES[-1][1](spark, docs, folder), corpus_pipeline.run(spark, folder)):
        assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out.collect()) == sorted(pieces(rows))
