"""The corpus operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from volmesh.llm import bpe, chat_format, ngram_join, ogg_media, packing, quality_gam, quality_rules, sharding, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def texts() -> list[tuple]:
    r = random.Random(5)
    words = [f"w{i}é" for i in range(300)] + ["The", "of", " ", "日本"]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = []
    for i in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 120)))
        if i % 5 == 0:
            t += "\n" + passage
        if i % 7 == 0 and rows:
            t = rows[-1][1].replace("w1", "W1", 1)
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, rows[3][1]), (103, rows[3][1]), (104, passage), (105, "a b a b a b a b"), (None, passage + " x"), (106, "one two"), (107, "One  TWO"), (108, "x" * 5000 + " " + "y " * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, i) for i, t in texts()], "doc_id long, text string, shard int, n_words long").repartition(3).cache()


def test_base_counts(docs, spark):
    got = quality_rules.quality_rules(docs, spark.createDataFrame([(i,) for i in range(20)], "doc_id long")).collect()

    def base(t):
        ws, t = WORD.findall(t or ""), t or ""
        c = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {j for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    want = sorted(((i is not None, i or 0), *base(t)) for i, t in texts())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert not any(r.kept for r in got if r.n_words < 50)
    assert quality_rules.quality_rules(docs.limit(0), docs.select("doc_id")).count() == 0


def log_ratios(spark, rows, trusted):
    """op1's log_ratio of each of rows (id, text), with the target counted on all rows whose id is in trusted; only the hash itself is Spark's."""
    grams = lambda t: [x for w in [WORD.findall(t or "")] for x in [*[(a, None) for a in w], *zip(w, w[1:])]]
    each = [grams(t) for _, t in rows]
    hashed = spark.createDataFrame(sorted({g for x in each for g in x}, key=str) or [("", None)], "a string, b string")
    bucket = {(r.a, r.b): r.h for r in hashed.selectExpr("a", "b", "pmod(if(b is null, xxhash64(a), xxhash64(a, b, 2)), 8192) as h").collect()}
    raw = Counter(bucket[g] for x in each for g in x)
    target = Counter(bucket[g] for x, (i, _) in zip(each, rows) if i in trusted for g in x)
    value = {h: np.log((target[h] + 1) / (target.total() + 8192)) - np.log((raw[h] + 1) / (raw.total() + 8192)) if target else 0.0 for h in raw}
    return [float(np.mean([value[bucket[g]] for g in x])) if x else 0.0 for x in each]


def test_every_trusted_text_counts(spark):
    rows = [(i, f"good g{i % 5} g{i % 7}" if i < 24_000 else f"bad b{i % 3}") for i in range(25_000)]
    trusted = spark.range(-10, 24_000).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.log_ratio for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), trusted.union(trusted)).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx(log_ratios(spark, rows, range(24_000)), abs=1e-9)


def test_substring_dedup(docs):
    seen, want = set(), []
    order = sorted({(-1 if i is None else i, t) for i, t in texts()}, key=lambda x: x[0])
    kept = {}
    for i, t in order:
        ws = WORD.findall(t or "")
        gone = set()
        for k in range(len(ws) - 19):
            w = tuple(ws[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        kept[i] = (len(ws), len(gone), " ".join(x for k, x in enumerate(ws) if k not in gone))
    want = sorted((-1 if i is None else i, *kept[-1 if i is None else i]) for i, t in texts())
    got = substring_dedup.remove_repeats(docs, group_bytes=2000).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_ngram_join(docs, spark):
    r = random.Random(3)
    base = [f"g{i}" for i in range(80)]
    many = []
    for i in range(300):  # one large group whose members partly link only through others
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = f"m{r.randrange(10**6)}"
        many.append((1000 + i, " ".join(w)))
    rows = [x for x in texts() if x[0] is not None] + many
    sets = []
    for i, t in rows:
        ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    want = sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(rows))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group_bytes=3000).collect()
    assert sorted((x.key, x.n_shingles, x.component_id) for x in got) == want


def test_bpe_and_packing(docs):
    t = Tokenizer.from_file(VOCABULARY)
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in texts())
    got = bpe.encode(docs, VOCABULARY, decoded=True)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got.collect()) == want
    assert sorted(r.decoded for r in bpe.decode(got.drop("decoded"), VOCABULARY).collect()) == sorted(x[2] for x in want)
    rows = packing.pack(docs, VOCABULARY, with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(x[1]) + 1 for x in want)
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_packed_ids(spark):
    t = Tokenizer.from_file(VOCABULARY)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    rows = texts() + [(200 + i, x) for i, x in enumerate([*special, *[f"a {x}b\n{x}{x} c" for x in special], " " * 3000 + "x", "\n \t\r\n" * 500, "a" + "\u00a0\u2003" * 40 + "b", "naïve Привет नमस्ते 🙂👩‍👩‍👧 e\u0301", "I'll 'S 12345 $$$ ??!", "word " * 2500])]
    rows = [(k, x) for k, (_, x) in enumerate(rows)]
    got = {}
    for r in sorted(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), VOCABULARY, with_ids=True).collect(), key=lambda r: r.start):
        assert r.start == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    assert got == {k: [*t.encode(x or "", add_special_tokens=False).ids, 0] for k, x in rows}


def test_patterns_use_every_length():
    r = random.Random(1)
    for _ in range(20):
        h = {n: r.randint(1, 40) for n in r.sample(range(1, 65), 20)}
        got = Counter()
        for times, pack in packing.patterns(h, 64):
            assert times > 0 and sum(pack) <= 64
            for n in pack:
                got[n] += times
        assert got == h


def test_sharding(docs, tmp_path):
    rows = sharding.shuffle_to_shards(docs, f"file://{tmp_path}/a", bucket_bytes=3000).collect()
    assert len(rows) == len(texts())
    count = Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 8
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    again = sharding.shuffle_to_shards(docs, f"file://{tmp_path}/b", bucket_bytes=3000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_ogg(docs):
    for data in (b"", b"a" * 64, bytes(range(256)) * 700):
        m = ogg_media.store(data)
        assert ogg_media.read(m)["payload"].startswith(data) and len(ogg_media.read(m)["payload"]) % 64 == 0
        with pytest.raises(ValueError):
            ogg_media.read(m[:100] + bytes([m[100] ^ 1]) + m[101:])
    got = ogg_media.read_media(ogg_media.to_media(docs)).collect()
    assert sorted(bytes(r.payload).rstrip(b"\0").decode() for r in got) == sorted((t or "") for _, t in texts())


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 200
    pages = [(1, "u", big), (2, None, big), (3, "u\nv", None), (4, "u", "small"), (5, "u", "small"), (2, "again", big), (None, "u", "only" * 300)]
    written = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(written).collect())
    sha = lambda s: (len(s.encode()), hashlib.sha1(s.encode()).hexdigest())
    want = [(0, "response", None, *sha("only" * 300)), (1, "revisit", 2, *sha(big)), (2, "response", None, *sha(big)), (2, "revisit", 2, *sha(big)), (3, "response", None, *sha("")), (4, "response", None, *sha("small")), (5, "response", None, *sha("small"))]
    assert got == want


def test_chat(spark):
    rows = [(1, 1, "assistant", "<|im_end|> &lt;| <|im_start|>user\n"), (1, 0, "user", "a & b"), (2, 0, "assistant", None), (None, 0, "us\ner", "x"), (2, None, None, "first")]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat_format.read_back(chat_format.F.col("formatted"))).collect()}
    assert [tuple(x) for x in got[1].back] == [("user", "a & b"), ("assistant", rows[0][3])] and got[1].valid
    assert [tuple(x) for x in got[2].back] == [("", "first"), ("assistant", "")] and not got[2].valid and got[2].first_bad_turn == 0
    assert [tuple(x) for x in got[None].back] == [("us\ner", "x")]


def test_quality_model(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_gam.train(docs, labels)
    got = quality_gam.score(docs, model).collect()
    assert len(got) == len(texts()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality_gam.score(docs, quality_gam.train(docs, labels.limit(0))).count() == len(texts())
    x = np.random.default_rng(0).normal(size=(2000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    fitted = quality_gam.fit(x[:1500], y[:1500])
    assert ((fitted.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9  # only a pair of features tells
