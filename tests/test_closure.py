"""Closures without caps, shared children and cycles; T15 from its whole pool."""

from collections import Counter

from pyspark.sql import functions as F

from weft.operators import closure, splits


def ways(edges, root):
    """Ends of all walks down from root, no node twice in a walk."""
    down = {}
    for a, b in edges:
        down.setdefault(a, []).append(b)
    out, todo = Counter(), [(root,)]
    while todo:
        w = todo.pop()
        for b in down.get(w[-1], []):
            if b not in w:
                todo.append((*w, b))
        if w[-1] not in down:
            out[w[-1]] += 1
    return out


def longest(edges, node):
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(b, []).append(a)
    best, todo = 0, [(node,)]
    while todo:
        w = todo.pop()
        best = max(best, len(w) - 1)
        todo += [(*w, a) for a in up.get(w[-1], []) if a not in w]
    return best


def test_long_chains(spark):
    n = 104
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)], "parent string, child string")
    assert closure.depths(chain).agg(F.max("depth")).first()[0] == n


def test_ladder_of_many_ways(spark):
    """Two nodes on each of 14 levels, each leading to both below: 2^13 ways to either end."""
    rows = [(f"{i}{a}", f"{i + 1}{b}") for i in range(14) for a in "xy" for b in "xy"]
    m = spark.createDataFrame(rows, "parent string, child string")
    got = {(r.root, r.leaf): r.n for r in closure.leaf_counts(m).where("root in ('0x', '12y')").collect()}
    assert got == {("0x", "14x"): 2**13, ("0x", "14y"): 2**13, ("12y", "14x"): 2, ("12y", "14y"): 2}


def test_copies_and_cycles(spark):
    rows = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "c"), ("x", "y"), ("y", "x"), ("y", "d"), ("w", "x"), ("w", "a"), ("d", "e"), ("d", "e")]
    m = spark.createDataFrame(rows, "parent string, child string")
    got = {(r.root, r.leaf): r.n for r in closure.leaf_counts(m).collect()}
    assert got == {(p, x): n for p in {a for a, _ in rows} for x, n in ways(rows, p).items()}
    nodes = {x for r in rows for x in r}
    assert {r.node: r.depth for r in closure.depths(m).collect()} == {x: longest(rows, x) for x in nodes}


def test_replay_negatives_take_the_whole_pool(spark):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id long, label string")
    events = spark.createDataFrame([(1, "n0", "n5"), (2, "n3", "n3"), (3, "out", "n2"), (4, "n4", "out"), (5, "out", "off")], "edge long, src string, dst string")
    for k in (2, 4, 9):
        got = {}
        for r in splits.replay_negatives(events, nodes, 6, k, 7).collect():
            got.setdefault((r.edge, r.side), []).append(r.negative)
        free = {(1, "dst"): 4, (2, "dst"): 5, (3, "dst"): 5, (4, "src"): 5}
        assert {x: len(v) for x, v in got.items()} == {x: min(k, n) for x, n in free.items()}
        assert all(len(set(v)) == len(v) for v in got.values())
        assert not set(got[1, "dst"]) & {"n0", "n5"} and "n3" not in got[2, "dst"] and "n4" not in got[4, "src"]
