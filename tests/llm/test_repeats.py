import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import repeats


def brute(texts, n, words):
    toks = [(t or "").encode().split() if words else [bytes([x]) for x in (t or "").encode()] for t in texts]
    seen = Counter(tuple(t[i : i + n]) for t in toks for i in range(len(t) - n + 1))
    out = []
    for t in toks:
        m = [False] * len(t)
        for i in range(len(t) - n + 1):
            if seen[tuple(t[i : i + n])] > 1:
                m[i : i + n] = [True] * n
        spans = sum(1 for i, x in enumerate(m) if x and not (i and m[i - 1]))
        out.append((len(t), sum(m), spans, (b" " if words else b"").join(x for x, y in zip(t, m) if not y)))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "ß x", "日本"]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [say(r.randint(5, 30)) for _ in range(6)]
    out = [None, "", " \t\n", "one", say(500)]
    for _ in range(n):
        parts = [say(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages).split(" ")
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "edit"
            parts += [" ".join(p), say(r.randint(0, 12))]
        out.append((r.choice([" ", "\n", "  "])).join(parts))
    return out + r.sample(out, 10) + ["a b " * 60, "x" * 300]


@pytest.mark.parametrize("seed,n,k", [(1, 8, 3), (2, 12, 2), (3, 5, 5)])
def test_words(spark, seed, n, k):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: (r.n, r.removed, len(r.spans), bytes(r.kept)) for r in repeats.repeated_words(spark, docs, n, k, shard_words=200).collect()}
    assert got == dict(enumerate(brute(texts, n, True)))


@pytest.mark.parametrize("seed,n,k,windows,group", [(1, 40, 6, 400000, 1000), (2, 25, 8, 100, 2), (3, 60, 3, 50, 1)])
def test_bytes(spark, monkeypatch, seed, n, k, windows, group):
    monkeypatch.setattr(repeats, "SORT_WINDOWS", windows)
    monkeypatch.setattr(repeats, "GROUP_RUNS", group)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h int").repartition(3)
    got = {r.doc_id: (r.n, r.removed, len(r.spans), bytes(r.kept)) for r in repeats.repeated_bytes(spark, docs, n, k).collect()}
    assert got == dict(enumerate(brute(texts, n, False)))


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats.tk, "CHUNK", 64)
    texts = corpus(5, 20)
    data = "\n".join(x or "" for x in texts).encode()
    t, b, _, _ = repeats.Unit("bytes", 30, 4).tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    r = repeats.tk.windows_by_anchor(t, b, 30, 4)
    assert r["count"].sum() == len(data) - 29
    whole = repeats.tk.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert [data[s:e] for s, e in zip(whole[0], whole[1])] == data.split()
    assert len(set(whole[2].tolist())) == len(set(data.split()))


def test_suffixes_in_order():
    r = random.Random(8)
    for n in (5, 8, 13, 40, 100):
        data = bytes(r.choice(b"ab") for _ in range(300)) + b"abc" * 100 + bytes(r.choice(b"ab") for _ in range(50)) + b"abc" * 60
        pos = np.array(r.sample(range(len(data) - n), 300))
        order, same = repeats.multikey_sort(np.frombuffer(data, np.uint8), pos, n)
        got = [data[p : p + n] for p in pos[order]]
        assert got == sorted(got)
        assert same.tolist() == [False] + [x == y for x, y in zip(got, got[1:])]


def test_only_what_the_automata_find_is_removed(spark, monkeypatch):
    words = " ".join(f"u{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a " + words), (2, "b " + words)], "doc_id long, text string")
    assert {r.removed for r in repeats.repeated_words(spark, docs, 8, 3).collect()} == {30}
    monkeypatch.setattr(repeats, "_automata", lambda shard_words: lambda batches: (x for b in batches for x in ()))
    assert {r.removed for r in repeats.repeated_words(spark, docs, 8, 3).collect()} == {0}


def test_words_with_equal_polynomial_hashes(spark):
    a = "".join("xy"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("xy", "yx"))
    texts = [f"p q {x} r s {y} t u v w" for x, y in ((a, b), (b, a), (a, a))] + [a + "!" + b, b + "?" + a]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for f, n, k, words in ((repeats.repeated_words, 6, 3, True), (repeats.repeated_bytes, 1500, 16, False)):
        got = {r.doc_id: (r.n, r.removed, len(r.spans), bytes(r.kept)) for r in f(spark, docs, n, k).collect()}
        assert got == dict(enumerate(brute(texts, n, words)))


def test_nulls_repeats_and_empty(spark):
    long = " ".join(f"u{i}" for i in range(20))
    docs = spark.createDataFrame([(None, long), (None, long), (7, long + " tail"), (8, None)], "doc_id long, text string")
    rows = sorted((r.doc_id is not None, r.n, r.removed) for r in repeats.repeated_words(spark, docs, 8, 3).collect())
    assert rows == [(False, 20, 20), (False, 20, 20), (True, 0, 0), (True, 21, 20)]
    for f in (repeats.repeated_words, repeats.repeated_bytes):
        assert f(spark, docs.limit(0), 8, 3).count() == 0


def test_query_1_is_whole(spark):
    out = repeats.op1(spark, "/root/testdata/sf0.001")
    want = {}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    for r, x in zip(rows, brute([r.text for r in rows], 35, True)):
        want[r.doc_id] = (x[0], x[1], hashlib.sha256(x[3]).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == want


def test_query_4_is_whole(spark):
    out = repeats.op4(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    raw = [r.text.encode() for r in rows]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    for r, t in zip(out.orderBy("doc_id").collect(), raw):
        m = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                m[i : i + 400] = b"\1" * 400
        assert (r.n_bytes, r.n_removed) == (len(t), sum(m)), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(bytes(x for x, y in zip(t, m) if not y)).hexdigest()
