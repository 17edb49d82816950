"""Every operator and pipeline stage on clashing column names, an empty table and very long texts, and the queries that SQL cannot express."""

import hashlib
import re
import struct
import uuid
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_corpus import VOCABULARY, WORD, texts
from volmesh.llm import bpe, chat_format, ngram_join, ogg_media, packing, quality_gam, quality_rules, sharding, shared, substring_dedup, warc
from volmesh.llm.shared import by_key

CLASHING = ["_g", "_key", "_th", "_b", "_id", "_once", "_place", "_t", "_n", "_y", "_row", "_text", "_words", "_doc", "_at", "_all", "_shard", "_rank", "_salt", "row", "key", "th", "id", "once", "size", "shard", "slot", "own", "a b"]
CARRIED = [c for c in CLASHING if c not in ("size", "shard", "slot")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, *[k * 1000 + n for n in range(len(CLASHING))]) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="module")
def trusted(spark):
    return spark.range(0, 30).select(F.col("id").alias("doc_id"))


@pytest.fixture(scope="module")
def model(odd, spark):
    return quality_gam.train(odd, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int"))


def operators(spark, tmp_path, trusted, model):
    fresh = lambda: f"file://{tmp_path}/{uuid.uuid4().hex}"
    return {
        "quality_rules": lambda d: quality_rules.quality_rules(d, trusted), "keep_good": lambda d: quality_rules.keep_good(d, trusted),
        "warc": lambda d: warc.read_archives(warc.write_archives(d.withColumns({"page_id": F.col("doc_id"), "url": F.lit("u"), "html": F.col("text")}), fresh())).drop("archive"),
        "chat": lambda d: chat_format.format_chats(d.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(0), "role": F.lit("user")})),
        "packing": lambda d: packing.pack(d, VOCABULARY).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
        "gam": lambda d: quality_gam.score(d, model), "sharding": lambda d: sharding.shuffle_to_shards(d, fresh(), bucket_bytes=3000),
        "join": lambda d: ngram_join.near_duplicates(d, group_bytes=3000).drop("root"), "one_of_each": lambda d: ngram_join.one_of_each(d, group_bytes=3000),
        "media": lambda d: ogg_media.read_media(ogg_media.to_media(d)), "passages": lambda d: substring_dedup.remove_repeats(d, group_bytes=2000), "bpe": lambda d: bpe.encode(d, VOCABULARY, decoded=True),
    }


NAMES = ["quality_rules", "keep_good", "warc", "chat", "packing", "gam", "sharding", "join", "one_of_each", "media", "passages", "bpe"]


@pytest.mark.parametrize("name", NAMES)
def test_clashing_names_and_empty_table(name, odd, spark, tmp_path, trusted, model):
    run = operators(spark, tmp_path, trusted, model)[name]
    plain = odd.select("doc_id", "text")
    want = run(plain)
    kept = [c for c in want.columns if c not in CLASHING] if name != "sharding" else want.columns
    got = run(odd).collect()
    assert sorted(str(tuple(r[c] for c in kept)) for r in got) == sorted(str(tuple(r)) for r in want.select(kept).collect())
    if got and "_g" in got[0].asDict():  # carried columns are those of their row
        source = {r["_g"]: r for r in odd.collect()}
        for r in got:
            assert all(r[c] == source[r["_g"]][c] for c in CARRIED) and r["doc_id"] == source[r["_g"]]["doc_id"]
    assert run(odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_clashing_names(name, odd, spark, tmp_path):
    folder = f"{tmp_path}/data"
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.withColumns({c: F.lit(9) for c in ("score", "predicted", "n_words", "n_removed", "removed", "kept_text", "n_chars")})
    got, plain = stage(spark, docs, folder), stage(spark, docs.select("doc_id", "text", "n_chars"), folder)
    assert sorted(map(str, got.select("doc_id", *(["text"] if name != "packing" else ["start"])).collect())) == sorted(map(str, plain.select("doc_id", *(["text"] if name != "packing" else ["start"])).collect()))
    if name != "packing":
        assert got.columns == docs.columns
        source = {r["_g"]: r for r in docs.collect()}
        same = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert all(r[c] == source[r["_g"]][c] for r in got.collect() for c in same)
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_very_long_texts(spark, tmp_path, trusted, model):
    long = [" " * 1_000_000 + "x", "y" * 1_500_000, "ab cd " * 100_000, "\n" * 600_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    run = operators(spark, tmp_path, trusted, model)
    t = Tokenizer.from_file(VOCABULARY)
    ids = [t.encode(x, add_special_tokens=False).ids for x in long]
    assert {r.doc_id: list(r.ids) for r in run["bpe"](docs).select("doc_id", "ids").collect()} == dict(enumerate(ids))
    got = {}
    for r in sorted(packing.pack(docs, VOCABULARY, with_ids=True).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {k: [*x, 0] for k, x in enumerate(ids)}
    words = [len(WORD.findall(x)) for x in long]
    assert {r.doc_id: r.n_words for r in run["quality_rules"](docs).collect()} == dict(enumerate(words))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in run["passages"](docs).collect()} == {k: (n, n - 2 if n > 20 else 0) for k, n in enumerate(words)}
    assert [r.n_shingles for r in sorted(run["join"](docs).collect())] == [1, 1, 2, 0]
    assert {r.doc_id: bytes(r.payload).rstrip(b"\0").decode() for r in run["media"](docs).collect()} == dict(enumerate(long))
    assert all(0 <= r.score <= 1 for r in run["gam"](docs).collect())
    assert run["sharding"](docs).count() == 4 and run["warc"](docs).count() == 4 and run["chat"](docs).count() == 4


def test_repeated_rows_in_one_bucket(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same", 5)] * 3000 + [(i, f"t{i}", i) for i in range(2, 50)], "doc_id long, text string, x int").repartition(3)
    rows = sharding.shuffle_to_shards(docs, f"file://{tmp_path}/r", bucket_bytes=4000).collect()
    assert sorted((r.doc_id, r.text, r.x) for r in rows) == sorted(map(tuple, docs.collect()))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s in range(8) for k in range(381))


def test_several_buckets_in_a_partition(odd, monkeypatch):
    want = sorted(map(str, substring_dedup.remove_repeats(odd.select("doc_id", "text"), group_bytes=500).collect()))
    link = sorted(map(str, ngram_join.near_duplicates(odd.select("doc_id", "text"), group_bytes=500).drop("root").collect()))
    monkeypatch.setattr(shared, "MOST_PARTITIONS", 2)
    assert sorted(map(str, substring_dedup.remove_repeats(odd.select("doc_id", "text"), group_bytes=500).collect())) == want
    assert sorted(map(str, ngram_join.near_duplicates(odd.select("doc_id", "text"), group_bytes=500).drop("root").collect())) == link


def test_by_key_joins_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1], [1, 2]), ([1, 2], [3, 4]), ([], []), ([2, 3], [5, 6]))]
    batches[2] = batches[0].slice(0, 0)
    assert [(k, t.column("v").to_pylist()) for k, t in by_key(batches, ["k"])] == [((1,), [1, 2, 3]), ((2,), [4, 5]), ((3,), [6])]


def test_small_archives_have_a_dictionary():
    for records in ([b"one record"], [b"abc" * 10, b"abd" * 9]):
        data = warc.archive(records)
        assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC and list(warc.records(data)) == records


def test_archive_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    written = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=5000)
    (tmp_path / "out").mkdir()
    warc.files(written, str(tmp_path / "out"))
    got = [warc.parse(r)["page_id"] for f in (tmp_path / "out").iterdir() for r in warc.records(f.read_bytes())]
    assert sorted(got) == list(range(40)) and len(list((tmp_path / "out").iterdir())) > 1


def test_chat_machine(spark):
    turns = {1: "system user assistant user assistant", 2: "user user assistant", 3: "assistant user", 4: "user assistant user", 5: "system assistant", 6: "other"}
    rows = [(c, k, role, f"t{k}") for c, x in turns.items() for k, role in enumerate(x.split())]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_chats(docs).collect()}
    assert {c: (r.valid, r.first_bad_turn) for c, r in got.items()} == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, None), 5: (False, 1), 6: (False, 0)}
    assert [s.in_order for s in got[2].segments] == [True] * 3 + [False] * 6
    strict = {r.conv_id: r for r in chat_format.format_chats(docs, chat_format.Template(loss_out_of_order=False)).collect()}
    assert [sum(s.loss for s in strict[c].segments) for c in sorted(turns)] == [2, 0, 0, 1, 0, 0]


def test_media_query(spark, tmp_path):
    rows = [(i, t) for i, t in texts()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ogg_media.op8_ogg_media(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        x = np.frombuffer(padded, np.uint8).astype(int) - 128
        power = [int((x[k : k + 4000] ** 2).sum()) for k in range(0, len(x), 4000)]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x[1:], x))
        want.append((str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), int(x.sum()) * 1000 // len(x), sum(power) * 1000 // len(x), crossings, power.index(max(power))))
    number = lambda r, k: int(re.search(rf"{k}=(-?\d+)", r.feature)[1])
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, *[number(r, k) for k in ("mean", "power", "crossings", "loudest")]) for r in got) == sorted(want)


def test_pages_by_a_reader_of_its_own():
    """Ogg by its definition, bit by bit: what store() writes holds the samples in order in stream 1."""

    def crc(page):
        r = 0
        for byte in page:
            r ^= byte << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r >> 31 else r << 1) & 0xFFFFFFFF
        return r

    data = bytes(range(256)) * 40 + b"tail"
    media, at, packets, part = ogg_media.store(data), 0, {}, {}
    while at < len(media):
        serial, _, check, n = struct.unpack_from("<IIIB", media, at + 14)
        lacing, start = media[at + 27 : at + 27 + n], at + 27 + n
        end = start + sum(lacing)
        assert media[at : at + 4] == b"OggS" and crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == check
        for v in lacing:
            part[serial] = part.get(serial, b"") + media[start : start + v]
            start += v
            if v < 255:
                packets.setdefault(serial, []).append(part.pop(serial))
        at = end
    assert not part and b"".join(packets[1][1:]) == data + b"\0" * (-len(data) % 64)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_gam.op5_quality_gam(spark, sf).join(shared.table(spark, sf, "labels"), "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in quality_gam.op5_quality_gam(spark, sf).select("doc_id", "held_out").limit(50).collect())
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 10 and len(bad) > 10 and auc > 0.95
