import random
from collections import defaultdict

import numpy as np
import pytest

from weft.llm import jaccard


def shingles(text, n):
    w = [x.lower() if x.isascii() else x for x in (text or "").encode().decode().split()]
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in (text or "").split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j > i}:
            both = len(s & sets[j])
            if den * both >= num * (len(s) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, families=8):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    rows, base = [], []
    for _ in range(families):
        b = [r.choice(vocab) for _ in range(r.choice([3, 8, 20, 60, 200]))]
        base.append(b)
        for _ in range(r.randint(1, 12)):
            w = list(b)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                p = r.randrange(len(w))
                r.choice([lambda: w.insert(p, r.choice(vocab)), lambda: w.__setitem__(p, r.choice(vocab).upper())])()
            rows.append(" ".join(w))
            b = w if r.random() < 0.4 else b
    rows += [None, "", "  \n", "one", "one", "ONE", "two words", "é É"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, "only a null id here"), (4, rows[1])]


@pytest.mark.parametrize("seed,n,num,den", [(1, 4, 85, 100), (2, 5, 80, 100), (3, 2, 50, 100), (4, 1, 30, 100)])
def test_classes(spark, seed, n, num, den):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, v int").repartition(3)
    got = sorted([tuple(r) for r in jaccard.join_classes(spark, docs, n, num, den).select("doc_id", "n_shingles", "component_id").collect()], key=str)
    assert got == brute(rows, n, num, den)


def reaches(s, a, b):
    """Whether two sets meet after both have skipped as many of their common plain signatures as they may."""
    (pa, na), (pb, nb) = s.signatures(a), s.signatures(b)
    return len(np.intersect1d(na, nb)) or len(np.intersect1d(pa, pb)) > min(s.slack(len(a)), s.slack(len(b)))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_classes(spark, docs, 4, 85, 100).count() == 0


def test_query_is_whole(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in jaccard.op7(spark, "/root/testdata/sf0.001").collect()], key=str)
    assert got == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("num", [85, 80, 60, 30])
def test_slack_is_covered_in_every_layout(num):
    r = np.random.default_rng(num)
    s = jaccard.Scheme(num, 100)
    for size in [*range(1, 30), 60, 150, 400]:
        for _ in range(400 if size < 30 else 40):
            both = r.integers(0, 2**64, size, dtype=np.uint64)
            apart = int(size * (100 - num) / num)
            x = r.integers(0, 2**64, int(r.integers(0, apart + 1)), dtype=np.uint64)
            y = r.integers(0, 2**64, int(r.integers(0, apart - len(x) + 1)), dtype=np.uint64)
            a, b = np.unique(np.concatenate((both, x))), np.unique(np.concatenate((both, y)))
            assert reaches(s, a, b), (len(a), len(b))


def test_neighbourhoods_are_allocated_wherever_sets_may_differ():
    for num in (85, 80, 60):
        s = jaccard.Scheme(num, 100)
        for size in (13, 60, 300, 2000, 20000):
            m, d, e, _ = s.layout(s.band(size))
            assert d >= 1 and m + d == s.most_apart(s.tops[s.band(size)] + s.tops[s.band(size)] * 100 // num) + 1 + e


def test_words_with_equal_polynomial_hashes(spark):
    """Thue-Morse words and their complements, whose polynomial hashes modulo 2^64 are equal whatever the base."""
    a = "".join("xy"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("xy", "yx"))
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 4):
        got = sorted((tuple(r) for r in jaccard.join_classes(spark, docs, n, 85, 100).collect()), key=str)
        assert got == brute(rows, n, 85, 100)


def test_one_large_cluster_of_near_copies(spark, monkeypatch):
    """Copies of one text with other edits each: many are close to the text but not to each other."""
    for name, x in (("HELD", 64), ("PASSING", 256), ("TEXTS", 32)):
        monkeypatch.setattr(jaccard, name, x)
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(160)]
    rows = []
    for i in range(1000):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(x) for x in jaccard.join_classes(spark, docs, 4, 85, 100).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)


def test_one_row_of_each_class_stays(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, 1), (None, long, 2), (None, "other words here and there", 3), (None, "other words here and there", 3), (5, long + " x", 4), (5, long + " x", 0), (6, "", 5), (6, None, 6), (7, " ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int")
    got = sorted((tuple(r) for r in jaccard.one_per_class(spark, docs).collect()), key=str)
    assert got == sorted([(5, long + " x", 0), (None, "other words here and there", 3), (6, "", 5), (6, None, 6), (7, " ", 7)], key=str)


def test_profiles_never_show_more_differences_than_there_are():
    r = np.random.default_rng(1)
    for _ in range(500):
        u = np.unique(r.integers(0, 2**63, int(r.integers(1, 3000))).astype(np.uint64))
        kept = u[r.permutation(len(u))[: int(r.integers(1, len(u) + 1))]]
        v = np.unique(np.concatenate((kept, r.integers(0, 2**63, int(r.integers(0, len(u) + 1))).astype(np.uint64))))
        p, q = jaccard.profile(u), jaccard.profile(v)
        size = min(len(p), len(q))
        assert jaccard.least_apart(jaccard.folded(p, size), jaccard.folded(q, size)) <= len(np.setxor1d(u, v))


def test_vertices_that_clash_are_named_anew(spark):
    from weft.llm.common import Scratch

    rows = [("a", 1, 10), ("b", 1, 10), ("c", 1, 11), ("d", 1, 12), ("e", 2, 10), ("f", 3, 5)]
    index = spark.createDataFrame(rows, "key string, v long, other long")
    got = {r.key: r.v for r in jaccard.renamed(index, Scratch(spark).keep).collect()}
    assert got["a"] == got["b"] == 1 and got["e"] == 2 and got["f"] == 3
    assert len(set(got.values())) == 5
