"""The registered queries of op1, op4, op6 and op10 over a whole small table, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_corpus import log_ratios
from tokenizers import Tokenizer

from volmesh.llm import bpe, packing, quality_rules, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def ids(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t, {i: t.encode(x or "", add_special_tokens=False).ids for i, x in docs}


def test_op1(spark, docs):
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    ratios = log_ratios(spark, docs, trusted)
    want = {}
    for (i, text), ratio in zip(docs, ratios):
        text = text or ""
        words = WORD.findall(text)
        seen = Counter(zip(words, words[1:], words[2:]))
        repeated = {j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        want[i] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed), ratio
    got = quality_rules.op1_quality_rules(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base, ratio = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        if abs(ratio - quality_rules.THRESHOLD) > 1e-9:
            assert r.kept == (not base[-1] and ratio >= quality_rules.THRESHOLD)
    assert 0 < sum(r.kept for r in got) < len(got)


def test_op4(spark, docs, ids):
    rows = packing.op4_packing(spark, SF).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    whole = {i: [*x, 0] for i, x in ids[1].items()}
    assert set(pieces) == set(whole)
    for i, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            part = whole[i][r.start : r.start + r.length]
            assert r.start == at and r.length > 0 and r.doc_tokens == len(whole[i]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(whole[i])
    filled = {q: sum(n for _, n in some) for q, some in places.items()}
    assert all(r.padded == (filled[r.sequence_id] if filled[r.sequence_id].bit_count() == 1 else 1024) for r in rows)
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.05 * sum(map(len, whole.values())) / 1024 + 2


def test_op6(spark, docs):
    rows = sharding.op6_sharding(spark, SF).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op10(spark, docs, ids):
    t, known = ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(x), digest(",".join(map(str, x))), digest(t.decode(x, skip_special_tokens=False))) for i, x in known.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_bpe(spark, SF).collect()} == want
