"""Exact dedup of deliveries, and its filters."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from weft.llm import exact, fuse


def test_filters_miss_nothing():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 64, 1000, 60_000):
        keys = r.integers(0, 2**63, n, dtype=np.uint64)
        f = fuse.build(np.concatenate((keys, keys[: n // 2])))
        assert fuse.probe(f, keys).all()
        assert fuse.probe(f, r.integers(0, 2**63, 100_000, dtype=np.uint64)).sum() <= 12
        if n > 1000:
            assert len(f) * 8 < 21 * n


def brute(rows):
    best, size = {}, {}
    low = lambda i: (i is not None, i or 0)
    for i, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = i if t not in best or low(i) > low(best[t]) else best[t]
    return [(i, best[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


def check(rows, got):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_deliveries(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)] + [(i, "hot") for i in range(1000, 1300)]
    rows += [(None, None), (None, ""), (7, ""), (None, "null id"), (None, "null id"), (8, "tie"), (8, "tie"), (9, "é\n" * 50_000), (10, "é\n" * 50_000), (11, " "), (12, "A"), (13, "a")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long").repartition(3, "text").persist()
    for deliveries in (1, 2, 4):
        check(rows, exact.dedup(spark, docs, exact.deal(deliveries), deliveries).collect())
    assert exact.dedup(spark, docs.limit(0), exact.deal(), 3).count() == 0


def test_only_positives_are_compared(spark):
    docs = spark.createDataFrame([(i, f"old {i}") for i in range(500)] + [(1000 + i, f"old {i}" if i % 10 == 0 else f"new {i}") for i in range(500)], "doc_id long, text string")
    shop = exact.Snapshots(spark, 4)
    group = lambda x: x.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text").groupBy("digest").agg(F.count("*").alias("n"), F.max("text").alias("text"))
    old = shop.freeze(group(docs.where("doc_id < 1000")))
    shop.index(old.select("digest"))
    new = shop.freeze(group(docs.where("doc_id >= 1000")))
    hits = shop.screen(new.select("digest"))
    assert 50 <= hits.count() <= 55
    assert shop.confirm(new, hits).count() == 50
    forged = new.withColumn("text", F.concat("text", F.lit("!")))  # same digests, other bytes
    assert shop.confirm(forged, hits).count() == 0
    shop.close()
