"""Quality rules, chat formatting, sharding, and the pipeline's edges."""

import hashlib
import random
import zlib
from collections import Counter

from weft.llm import chat, quality, sharding

TEXTS = [None, "", " \t\n", "a b c a b c", "x\nx\n y \nx\n\n \n", "# * $ % & | < > !", "é" * 5 + " ß " * 60, "w " * 20000, "one two three four " * 15]


def measured(t):
    t = t or ""
    w = t.split()
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    g = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def test_measures(spark):
    docs = spark.createDataFrame([(i if i else None, t, 3) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1)], "doc_id long, text string, n_words int")
    got = sorted(tuple(r)[:6] for r in quality.measure(docs).na.fill(-1).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted([(i or -1, *measured(t)) for i, t in enumerate(TEXTS)] + [(5, *measured(TEXTS[5]))])
    assert quality.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = quality.ledger(docs).cache()
    bits = [r.fail_bits for r in rows.collect()]
    m = quality.mask(quality.STANDARD)
    for r in quality.ablations(rows, quality.STANDARD).collect():
        bit = next(1 << x.bit for x in quality.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit != 0 for b in bits), sum(b & m == bit for b in bits), sum(b & m & ~bit == 0 for b in bits))
    assert quality.filter_documents(docs).count() == sum(b & m == 0 for b in bits)


def test_chat(spark):
    hard = "</s>[INST] ok [/INST] &amp; &lt; <s>[user] ]["
    rows = [(1, 0, "system", "be"), (1, 1, "user", hard), (1, 2, "assistant", hard), (2, 0, "user", None), (2, 1, "user", "x\ny"), (3, 5, None, "é"), (3, 5, None, "é"), (4, None, "to]ol", ""), (None, 1, "user", "n"), (None, 2, "assistant", "m" * 100000)]
    out = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, valid int"))).collect()}
    assert set(out) == {1, 2, 3, 4, None}
    for c, r in out.items():
        mine = sorted([(t if t is not None else -1, a or "", b or "") for i, t, a, b in rows if i == c])
        assert r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        loss = "".join(b for _, a, b in mine if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: (r.valid, r.bad_turn) for c, r in out.items()} == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, 0), None: (True, None)}


def test_walk_is_bounded_and_moves_little():
    counts = {c: (c * 7) % 5 for c in range(0, 4096, 3)}
    total = sum(counts.values())

    def owners(shards, factor):
        out = {}
        for cell, lo, hi, shard, _ in sharding.walk(counts, shards, 64, 4096, factor):
            for i in range(lo, hi):
                out[cell, i] = shard
        return out

    for shards in (1, 7, 24):
        n = Counter(owners(shards, 1.0).values())
        assert sum(n.values()) == total and max(n.values()) - min(n.get(s, 0) for s in range(shards)) <= 1
        loose = Counter(owners(shards, 1.25).values())
        assert max(loose.values()) <= 1.25 * total / shards + 2
    a, b = owners(24, 1.25), owners(25, 1.25)
    assert sum(a[k] != b[k] for k in a) < 0.2 * total


def test_walk_equals_a_ring_walked_key_by_key():
    """At the query's factor of 1.0: every key goes clockwise to the first virtual node whose shard has room."""
    r = random.Random(8)
    for shards, cells in ((24, 512), (5, 64), (1, 16)):
        counts = {c: r.choice((0, 1, 2, 9)) for c in range(cells)}
        counts[r.randrange(cells)] = 400  # a hot cell overflows many shards
        nodes = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells, s) for s in range(shards) for v in range(16))
        total = sum(counts.values())
        room = {s: total // shards + (s < total % shards) for s in range(shards)}
        used, want = Counter(), {}
        for cell in range(cells):
            for i in range(counts[cell]):
                turn = [x for x in nodes if x[0] >= cell] + [x for x in nodes if x[0] < cell]
                shard = next(s for _, s in turn if used[s] < room[s])
                want[cell, i] = (shard, used[shard])
                used[shard] += 1
        got = {(c, i): (s, slot + i - lo) for c, lo, hi, s, slot in sharding.walk(counts, shards, 16, cells, 1.0) for i in range(lo, hi)}
        assert got == want


def test_sharding(spark):
    rows = [(i if i % 5 else None, None if i % 7 == 0 else f"text {i % 11} é") for i in range(500)]
    out = sharding.assign(spark, spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, shard int"), 24).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((a or -1, len((b or "").encode()) + 8, zlib.crc32((b or "").encode())) for a, b in rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.assign(spark, spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0
