import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weft.llm import huffman, tokenids, warc
from weft.llm.common import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(6, 9))
def test_code_lengths(counts, limit):
    c = np.array(counts)
    n = huffman.lengths(c, limit)
    assert n.max() <= limit and ((n > 0) == (c > 0)).all()
    if (c > 0).sum() > 1:
        assert sum(2.0 ** -float(x) for x in n if x) == 1.0
    import heapq

    h = [int(x) for x in c if x]
    heapq.heapify(h)
    best = 0
    while len(h) > 1:
        s = heapq.heappop(h) + heapq.heappop(h)
        best += s
        heapq.heappush(h, s)
    got = int((n.astype(int) * c).sum())
    assert got >= best
    if huffman.lengths(c, 40).max() <= limit and len([x for x in c if x]) > 1:
        assert got == best


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000, 200_000])
def test_pack(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.02, n), 3000).astype(np.uint32)
    length = huffman.lengths(np.bincount(ids, minlength=5), 12)
    words, marks = huffman.pack(ids, huffman.codes(length), length)
    assert (huffman.unpack(words, marks, n, huffman.table(length)) == ids).all()


def expected(rows):
    t = Tokenizer.from_file(PATH)
    at, out = 0, []
    for d, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark):
    rows = [(-5, None), (0, ""), (1, "  \n "), (2, "Hello, wörld's <|endoftext|>x é ́a b ΑΣ Σ 東京 12 a's"), (3, "lorem ipsum " * 3000), (9, "x" * 5000), (11, "İstanbul ﬁ\x85​")]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, start string").repartition(3)
    assert sorted(tuple(r) for r in tokenids.round_trip(spark, docs).collect()) == expected(rows)
    folder = scratch_path(spark, "small")
    tokenids.write(spark, docs, folder, PATH, by_parts=False, file_ids=50)
    assert sorted(tuple(r) for r in tokenids.read(spark, folder).collect()) == expected(rows)
    assert tokenids.round_trip(spark, docs.limit(0)).count() == 0


def test_parts_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE", 20)
    t = Tokenizer.from_file(PATH)
    texts = ["a <|startoftext|> b<|startoftext|>c <|startoftext|>", "", "x y z " * 9, "don't we'll É́ ﬁ ΑΣ Σ'S", "q1 q2 q3 q4 q5 q6 q7 q8 q9", "<|endoftext|>", "z <|startoftext|>"]
    enc = tokenids.Encoder(PATH, True)
    for x in texts + texts[::-1]:
        raw = x.encode()
        assert enc(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_query_3_is_whole(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in tokenids.op3(spark, "/root/testdata/sf0.001").collect()) == expected(rows)


def test_warc(spark):
    rows = [(3, "http://a/ b\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (4, "v", "é" * 70000), (None, "w", "same"), (1, "again", "same"), (None, "n", "only null")] + [(100 + i, f"http://h/{i}", f"<p>{i % 7}</p>" * 50) for i in range(60)]
    pages = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, payload int").repartition(3)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write(spark, pages, folder, roll_bytes=2000)
    assert manifest.count() > 5
    warc.check(spark, folder)
    got = sorted([tuple(r)[:1] + tuple(r)[2:6] for r in warc.read(spark, folder).collect()], key=str)
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw, f = (h or "").encode(), least.get(h or "")
        resp = f is None or f == i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if resp else "revisit", None if resp else f))
    assert got == sorted(want, key=str)
    again = scratch_path(spark, "warc-test")
    key = lambda d: sorted((r.name, r.sha1) for r in d.collect())
    assert key(warc.write(spark, pages.repartition(5), again, roll_bytes=2000)) == key(manifest)
    assert [bytes(r.payload).decode() for r in warc.read(spark, folder).where("page_id = 4").collect()] == ["é" * 70000]


def test_warc_files_depend_on_rows_only(spark):
    """Ids with gaps, a heavy range, one id with very many rows, and null ids: two writes from other partitions give one manifest, and names sort by id."""
    ids = [*range(0, 400), *range(10**12, 10**12 + 300), *[7 * 10**11] * 300, *[None] * 50, -(2**62), 2**62]
    pages = spark.createDataFrame([(i, f"u{k}", f"<p>{k % 290}</p>") for k, i in enumerate(ids)], "page_id long, url string, html string")
    made = []
    for parts in (3, 7):
        folder = scratch_path(spark, "warc-ranges")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = sorted(tuple(r) for r in warc.write(spark, pages.repartition(parts), folder, roll_bytes=4000, range_rows=16).select("name", "sha1", "records", F.coalesce("first_id", F.lit(2**62)), F.coalesce("last_id", F.lit(2**62))).collect())
        made.append(rows)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert made[0] == made[1] and sum(r[2] for r in made[0]) == len(ids)
    assert max(r[2] for r in made[0]) <= 64 and [x for r in made[0] for x in r[3:]] == sorted(x for r in made[0] for x in r[3:])
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content").collect()
    names = [h["WARC-Record-ID"] for r in raw for h, _, _ in warc.records(bytes(r.content))]
    assert len(names) == len(set(names)) == len(ids)
    empty = warc.write(spark, pages.limit(0), scratch_path(spark, "warc-empty"))
    assert empty.count() == 0


def test_warc_files_reach_their_size(spark):
    """Files end by compressed size over the ends of ranges: small ranges share a file, a large one is cut. A record longer than a file stays whole."""
    text = lambda k: "".join(hashlib.sha256(f"{k}-{i}".encode()).hexdigest() for i in range(4))
    ids = [*range(0, 3000, 7), *range(10**9, 10**9 + 300), *[10**15] * 200, *[None] * 60]
    pages = spark.createDataFrame([(i, None, text(k)) for k, i in enumerate(ids)], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-sizes")
    made = sorted(tuple(r) for r in warc.write(spark, pages, folder, roll_bytes=64000, range_rows=8).select("name", "bytes", "records", "first_id").collect())
    assert len(made) > 6 and sum(r[2] for r in made) == len(ids)
    assert all(abs(r[1] - 64000) <= 64000 // warc.SEGMENTS + 1000 for r in made[:-1]), made
    assert [r[0] for r in made] == [f"part-{i:012d}.warc.gz" for i in range(len(made))]
    assert warc.read(spark, folder).count() == len(ids)
    big = scratch_path(spark, "warc-big")
    long = spark.createDataFrame([(1, None, text(1)), (2, None, "".join(text(i) for i in range(400))), (3, None, text(3))], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.write(spark, long, big, roll_bytes=20000).select("records", "bytes").collect())
    assert [r[0] for r in got] == [1, 2] and got[1][1] > 20000
    warc.check(spark, big)


def test_ids_of_words_with_equal_polynomial_hashes(monkeypatch):
    a = "".join("xy"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("xy", "yx"))
    t, enc = Tokenizer.from_file(PATH), tokenids.Encoder(PATH, True)
    plain = tokenids.tk.words
    for forged in (plain, lambda d, o: (lambda s, e, h, f: (s, e, h % np.uint64(2), f))(*plain(d, o))):  # hashes that collide all the time
        monkeypatch.setattr(tokenids.tk, "words", forged)
        for x in (f"{a} {b} word {a}", f"{b} one two three one four", "one two"):
            raw = x.encode()
            assert enc(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() == t.encode(x, add_special_tokens=False).ids


def test_query_10_is_whole(spark):
    out = warc.op10(spark, "/root/testdata/sf0.001")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in out.collect()) == sorted((r.page_id, len((r.html or "").encode())) for r in pages)


def test_parts_of_random_texts():
    letters = [*"abJKIſ|~ \n\t.,'Σςs=<é1", "<|endoftext|>", "<|ENDOFTEXT|>", "'S", "'ll", "́", "̸", "̌", " ", " ", "ﬀ", "İ", "K", "日", "​", "\x00"]
    draw, whole, parts = random.Random(3), tokenids.Encoder(PATH, False), tokenids.Encoder(PATH, True)
    assert parts.fine
    for _ in range(200):
        column = pa.array(["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(20)])
        for _, _, data, offs in tokenids.tk.texts(column):
            assert [x.tolist() for x in parts(data, offs)] == [x.tolist() for x in whole(data, offs)]


def test_counts_of_ids():
    rows = [np.array(x, dtype="<u4").tobytes() for x in ([1, 5, 5], [], [1])]
    (out,) = tokenids._count([pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])])
    assert out.to_pylist() == [{"id": 1, "n": 2}, {"id": 5, "n": 2}]
