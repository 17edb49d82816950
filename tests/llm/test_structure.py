"""Conversation repair, the trie of conversations and repeated bytes against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.llm import chat_repair, prefix_trie, suffix_repeats

SF = "/root/testdata/sf0.01"


def repeats(texts, length):
    """(bytes, removed, runs, hash of the rest) of each text."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def odd_texts():
    r = random.Random(1)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(10, 80))) for _ in range(6)]
    texts = []
    for i in range(200):
        t = "".join(r.choice("abcdefghé ") for _ in range(r.randint(0, 150)))
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, len(t))
            t = t[:k] + r.choice(passages)[r.randint(0, 8) :] + t[k:]
        if i % 11 == 0 and texts:
            t = texts[-1]
        if i % 13 == 0 and texts and texts[-1]:
            t = texts[-1][:20] + "Z" + texts[-1][20:]
        texts.append(t)
    return [*texts, None, "", "y " * 400, "ab" * 100, "x" * 19, "q" * 1000, "日本語" * 50]


@pytest.mark.parametrize("hot", [1 << 15, 1])
def test_repeated_bytes(spark, hot):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, -1, "k") for i, t in enumerate(texts)] + [(None, texts[3], -1, "k")], "doc_id long, text string, n_bytes int, k1 string").repartition(3)
    got = suffix_repeats.remove_repeated_bytes(docs, length=20, gram=6, hot=hot)
    assert set(got.columns) == {"doc_id", "k1", "n_bytes", "n_removed", "removed", "kept"}
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got.collect())
    assert rows == sorted((i, *x) for i, x in zip([*range(len(texts)), -1], repeats([*texts, texts[3]], 20)))
    assert suffix_repeats.remove_repeated_bytes(docs.limit(0)).count() == 0


def test_repeated_bytes_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in suffix_repeats.op12_suffix_repeats(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == sorted((d.doc_id, *x) for d, x in zip(docs, repeats([d.text for d in docs], 200)))


def test_stretches_across_slices(monkeypatch):
    r = np.random.default_rng(0)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 700, 700, 4000, 5000])
    for slice_bytes in (1 << 20, 333):
        monkeypatch.setattr(suffix_repeats, "SLICE", slice_bytes)
        text, g, x, start, size = suffix_repeats.stretches(data, bounds, 40, 8)
        starts = sorted((t, s + k) for t, s, n in zip(text.tolist(), start.tolist(), size.tolist()) for k in range(n - 39))
        assert starts == [(t, i) for t in range(4) for i in range(int(bounds[t + 1] - bounds[t]) - 39)]  # each string of 40 bytes in one stretch


def test_maximal_repeats():
    r = random.Random(2)
    contexts = list({"".join(r.choice("ab") for _ in range(r.randint(0, 40))).encode() for _ in range(30)})
    got = {}
    for size, ctx, start in suffix_repeats.maximal_repeats(contexts, length=6):
        s = contexts[ctx[0]][start[0] : start[0] + size]
        assert s not in got
        got[s] = sorted(zip(ctx.tolist(), start.tolist()))
    places = {}
    for c, b in enumerate(contexts):
        for n in range(6, len(b) + 1):
            for i in range(len(b) - n + 1):
                places.setdefault(b[i : i + n], []).append((c, i))

    def extends(s, at):
        before = {contexts[c][i - 1] if i else (c, i) for c, i in at}
        after = {contexts[c][i + len(s)] if i + len(s) < len(contexts[c]) else (c, i) for c, i in at}
        return len(before) == 1 or len(after) == 1

    assert got == {s: at for s, at in places.items() if len(at) > 1 and not extends(s, at)}


def cheapest(rows):
    """(cost, audit) by relaxing until nothing changes."""
    label, changed = {(0, ""): (0, "")}, True
    while changed:
        changed = False
        for (i, last), (cost, audit) in list(label.items()):
            after = [(i, x, cost + 2, audit + "I") for x in "ua"]
            if i < len(rows):
                after.append((i + 1, last, cost + 3, audit + "D"))
                if rows[i] != "-":
                    late = int(rows[i].isupper())
                    after += [(i + 1, rows[i].lower(), cost + late, audit + "K")] + [(i + 1, x, cost + 2 + late, audit + "R") for x in "ua"]
            for j, x, c, a in after:
                if a[-1] != "D" and not (last + x in ("su", "ua", "au") or not last and x in "su"):
                    continue
                if (c, a) < label.get((j, x), (10**9, "")):
                    label[j, x], changed = (c, a), True
    return min(v for k, v in label.items() if k[0] == len(rows) and k[1] in ("", "a"))


def test_search(monkeypatch):
    r = random.Random(3)
    some = ["".join(r.choice("sua-SUAxX") for _ in range(r.randint(0, 10))) for _ in range(800)]
    assert [chat_repair.repair(x) for x in some] == [cheapest(x) for x in some]
    monkeypatch.setattr(chat_repair, "BLOCK", 3)
    assert [chat_repair.repair(x) for x in some] == [cheapest(x) for x in some]


def repaired(rows):
    chats = {}
    for c, t, role, text in rows:
        held = chats.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for c, rs in chats.items():
        rs.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, codes, n = set(), "", Counter()
        for i, (_, role, text) in enumerate(rs):
            word = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            n["illegal"] += bool(i) and rs[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = cheapest(codes)
        turns, left, made = [t for t, _, _ in rs if t is not None], iter(rs), []
        for letter in audit:
            new = "assistant" if made and made[-1][0][0] == "u" else "user"
            _, role, text = next(left) if letter != "I" else (0, new, "")
            made += [] if letter == "D" else [(new if letter == "R" else role, text)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()))
    return sorted(out, key=repr)


CHATS = "conv_id long, turn long, role string, text string"


def odd_chats():
    r = random.Random(1)
    role, text = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Hi.", "ok", "what?  \n", "", " \t", None, "é!", "end. ", "日本。", "x.y", "z" * 5000 + "."]
    rows = [(r.choice([None, *range(-3, 60)]), r.choice([None, *range(12)]), r.choice(role), r.choice(text)) for _ in range(600)]
    return rows + rows[:9] + [(99, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(150)]


def test_chat_repair(spark):
    rows = odd_chats()
    chats = spark.createDataFrame([(*x, 1) for x in rows], CHATS + ", cost int").repartition(3)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in chat_repair.repair_chats(chat_repair.damage(chats)).select(names).collect()), key=repr) == repaired(rows)
    given = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(x) for x in chat_repair.op11_chat_repair(spark, SF).select(names).collect()), key=repr) == repaired(given)
    assert chat_repair.repair_chats(chats.limit(0)).count() == 0


def nodes(chats):
    """The trie of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(chats[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(w), len(p), min(members[p[:-1]]) if p else None, len(w), children[p], leaves[p], saved[p], ends(p)) for p, w in members.items())


def shared_chats(rows):
    own = {}
    for c, t, role, text in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    first = lambda c: c - int(np.fmod(c, 5))
    return {c: own.get(first(c), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie(spark):
    rows = odd_chats()
    chats = spark.createDataFrame([(*x, 1) for x in rows], CHATS + ", depth int").repartition(3)
    assert sorted((tuple(x) for x in prefix_trie.trie(prefix_trie.rebuilt(chats)).select(NODE).collect()), key=repr) == sorted(nodes(shared_chats(rows)), key=repr)
    assert prefix_trie.trie(prefix_trie.rebuilt(chats.limit(0))).count() == 0


def test_trie_over_many_ranges(spark):
    r = random.Random(4)
    for fan, longest, ranges in ((2, 9, 40), (120, 3, 25), (3, 30, 60)):
        chats = {c: [("user", f"{r.randrange(fan)}") for _ in range(r.randint(0, longest))] for c in range(400)}
        chats |= {c: chats[7] for c in range(400, 600)}
        ids = {x: hashlib.md5(x.encode()).digest() + len(x).to_bytes(4, "big") for x in map(str, range(fan))}
        keys = spark.createDataFrame([(c, b"".join(ids[x] for _, x in t)) for c, t in chats.items()], "conv_id long, key binary")
        total = sum(20 * len(t) + 16 for t in chats.values())
        got = sorted((tuple(x) for x in prefix_trie.trie(keys, range_bytes=total // ranges).select(NODE).collect()), key=repr)
        assert got == sorted(nodes(chats), key=repr)


def test_radix_tree_layouts():
    r = random.Random(5)
    keys = list({bytes(r.randrange(n) for _ in range(r.choice((0, 2, 4, 6)))) for n in (3, 12, 40, 256) for _ in range(600)})
    tree = prefix_trie.RadixTree()
    for k in keys:
        tree.add(k, k)
    found, layouts, todo = [], set(), [(tree.root, b"")]
    while todo:
        node, above = todo.pop()
        layouts.add(node.layout)
        if node.ends is not None:
            assert node.ends == above + node.path
            found.append(node.ends)
        todo += [(c, above + node.path) for c in reversed(node.in_order())]
    assert found == sorted(keys) and layouts == {4, 16, 48, 256}


def test_first_rows_decide_nothing(spark):
    """Neither the order of rows nor their partitions matter."""
    chats = spark.createDataFrame(odd_chats(), CHATS)
    for f in (lambda d: chat_repair.repair_chats(chat_repair.damage(d)), lambda d: prefix_trie.trie(prefix_trie.rebuilt(d))):
        assert sorted(map(str, f(chats.repartition(1)).collect())) == sorted(map(str, f(chats.orderBy(F.rand(1)).repartition(7)).collect()))
