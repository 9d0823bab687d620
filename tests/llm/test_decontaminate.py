import random
from collections import Counter

import numpy as np

from weft.llm import decontaminate as dc


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, items, k=5, least=0.8):
    """For every window of an item's own size: exact weighted similarity."""
    out = {}
    for d, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        have = {}
        for i, x in items:
            v = "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").split()
            kk = min(k, len(v))
            if not v or len(w) < kk:
                continue
            own = grams(v, kk)
            if not any(g in have.setdefault(kk, set(grams(w, kk))) for g in own):
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                g = grams(w[s : s + len(v)], kk)
                both = sum(min(c, own[x]) for x, c in g.items())
                sim = both / (sum(g.values()) + sum(own.values()) - both)
                if sim >= least:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(3)
    prints = r.integers(0, 2**63, 50, dtype=np.uint64)
    for radius in (3, 11, 20):
        f = prints[r.integers(0, 50, 400)]
        for _ in range(radius):
            f = f ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))
        row, item = dc.Index(prints, radius).within(f)
        got = set(zip(row.tolist(), item.tolist()))
        assert got == {(i, j) for i in range(400) for j in range(50) if int(f[i] ^ prints[j]).bit_count() <= radius}


def test_against_all_windows(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS", 7)
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([2, 12, 25, 40])))) for i in range(20)] + [(90, None), (91, ""), (92, "w1 w2 w3 w1 w2 w3 w1 w2 w3 w1 w2 w3"), (93, "w1 w2 w3 w1 w2 w3 w1 w2 w3 w1 w2 w3")]
    docs = [(0, None), (1, ""), (2, "w1"), (3, "w1 W2 w3 " * 9), (None, items[0][1])]
    for d in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        p = items[r.randrange(20)][1].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            p[r.randrange(len(p))] = r.choice(vocab)
        at = r.randint(0, len(w))
        docs.append((10 + d, " ".join(w[:at] + p + w[at:]).upper() if d % 9 == 0 else "\n".join(w[:at] + p + w[at:])))
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, doc_id string")
    got = {(x.doc_id, x.item_id): x.similarity for x in dc.contaminated(spark, frame, bench).collect()}
    want = brute(docs, items)
    assert set(got) <= set(want)
    missed = [x for x in want if x not in got]
    assert len(missed) <= 0.02 * len(want), missed  # beyond the radius in spite of the similarity
    assert all(want[x] > 0.99 or x not in missed for x in want) and not [x for x in missed if want[x] > 0.9]
    assert all(abs(got[x] - want[x]) < 0.15 for x in got)
    assert dc.contaminated(spark, frame, bench.limit(0)).count() == 0 == dc.contaminated(spark, frame.limit(0), bench).count()
    kept = {x.doc_id for x in dc.remove_contaminated(spark, frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_windows_that_are_fingerprinted_are_a_superset(spark):
    """Windows that reach no shared shingle have similarity 0; of windows of 0.8 or more the radius loses few."""
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    lost = close = 0
    for _ in range(300):
        item = [r.choice(vocab) for _ in range(r.choice([20, 40, 80]))]
        own, w = grams(item, 5), list(item)
        for _ in range(r.choice([1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        text = [r.choice(vocab) for _ in range(30)] + w + [r.choice(vocab) for _ in range(30)]
        for s in range(len(text) - len(item) + 1):
            g = grams(text[s : s + len(item)], 5)
            both = sum(min(c, own[x]) for x, c in g.items())
            if both / (sum(g.values()) + sum(own.values()) - both) >= 0.8:
                assert any(x in own for x in g)
                raw = [" ".join(x).encode() for x in (text[s : s + len(item)], item)]
                f = []
                for x in raw:
                    h = dc.tk.words(np.frombuffer(x, np.uint8), np.array([0, len(x)]), lower=True)[2]
                    at = np.arange(len(h) - 4)
                    f.append(int(dc.fingerprints(dc.signs(dc.tk.Hasher(h)(at, at + 5)).sum(axis=0, dtype=np.int32)[None, :])[0]))
                close += 1
                lost += (f[0] ^ f[1]).bit_count() > 20
    assert close > 100 and lost <= 0.01 * close


def test_large_benchmark_stays_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS", 300)
    texts = [f"item {i} " + " ".join(f"w{(i * 7 + j) % 997}" for j in range(8)) for i in range(1000)]
    bench = spark.createDataFrame([(i, texts[i % 1000]) for i in range(3000)], "item_id long, text string").repartition(4)
    docs = spark.createDataFrame([(d, "x " + texts[d * 9]) for d in range(20)], "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(spark, docs, bench).where("similarity = 1").collect()}
    assert {(d, d * 9 + k) for d in range(20) for k in (0, 1000, 2000)} <= got


def test_query_is_whole(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(x) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert {(x.doc_id, x.item_id) for x in dc.op9(spark, d).collect()} == set(brute(docs, items))


def test_clean_rows_stay_whatever_shares_their_id(spark):
    item = " ".join(f"question{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, " ".join(f"other{i}" for i in range(9)))], "item_id long, text string")
    rows = [(1, f"before {item} after"), (1, "a clean text with words of its own in it"), (None, item), (None, "another clean text that has nothing"), (None, None), (2, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    left = dc.remove_contaminated(spark, docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, (rows[1], *rows[3:])))
    assert dc.remove_contaminated(spark, docs, bench.limit(0)).count() == len(rows)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(str, dc.contaminated(spark, docs, bench).collect()))
    monkeypatch.setattr(dc, "ITEMS", 7)
    texts = bench.where("text is not null").select("text").distinct().count()
    assert texts > 21
    assert sorted(map(str, dc.contaminated(spark, docs, bench).collect())) == whole
