"""Nested pooling and appended term vectors, held against a walk by hand."""

import random

from weft.operators import features

NODES = "label string, type string, ord long, feature array<float>"


def walk(root, members, label, nodes, width):
    seen, out = set(), []

    def go(x):
        if x in seen:
            return
        seen.add(x)
        n = nodes.get(label.get(x))
        if n is None:
            return
        if n[0] != "complex":
            if n[1] is not None and len(n[1]) == width:
                out.append(n[1])
            return
        for c in members.get(x, ()):
            go(c)

    go(root)
    return [sum(c) / len(out) for c in zip(*out)] if out else [0.0] * width


def test_nested_pooling(spark):
    r = random.Random(4)
    ids = [f"i{k}" for k in range(40)]
    label = {x: f"L{k // 2 if k < 6 else k}" for k, x in enumerate(ids)}  # three pairs share a label
    nodes = {}
    for x in ids[:36]:  # the last four are no nodes
        k = int(label[x][1:])
        nodes[label[x]] = ("complex", None) if k % 2 == 0 else (None if k == 9 else "protein", None if k % 5 == 0 else [r.random() for _ in range(2 if k % 11 == 0 else 3)])
    members = {x: r.sample(ids, 3) for x in ids if r.random() < 0.8}  # with cycles, shared children and leaves that have members
    rows = [(n, t, i, f) for i, (n, (t, f)) in enumerate(nodes.items())]
    m = spark.createDataFrame([(a, b, 1) for a in members for b in members[a]] * 2, "parent string, child string, ord int")
    t = spark.createDataFrame([(x, label[x], i) for i, x in enumerate(ids)], "id string, label string, ord long")
    got = {a.label: a.feature for a in features.nested_pooled(m, t, spark.createDataFrame(rows, NODES)).collect()}
    first = next(len(f) for _, kind, _, f in rows if kind != "complex" and f is not None)
    assert set(got) == {n for n, (kind, _) in nodes.items() if kind == "complex"} and len(got) > 8
    for n, f in got.items():
        root = next(x for x in ids if label[x] == n)
        assert all(abs(a - b) < 1e-6 for a, b in zip(f, walk(root, members, label, nodes, first), strict=True)), n
    bare = spark.createDataFrame([(n, kind, i, None) for n, kind, i, _ in rows], NODES)
    assert {a.feature for a in features.nested_pooled(m, t, bare).collect()} == {None}


def test_nested_pooling_of_a_deep_chain(spark):
    m = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c12", "p")], "parent string, child string")
    t = spark.createDataFrame([*[(f"c{k}", f"c{k}", k) for k in range(13)], ("p", "p", 99)], "id string, label string, ord long")
    n = spark.createDataFrame([*[(f"c{k}", "complex", k, None) for k in range(13)], ("p", "protein", 99, [1.0, 2.0])], NODES)
    assert {tuple(a.feature) for a in features.nested_pooled(m, t, n).collect()} == {(1.0, 2.0)}


def test_terms_appended(spark):
    n = spark.createDataFrame([("a", "GO:3", [1.0]), ("b", "X:3", [2.0]), ("c", None, []), ("d", "GO:1", None), ("e", "GO:9", [5.0])], "label string, location string, feature array<float>")
    t = spark.createDataFrame([("a", "GO:1"), ("a", "GO:1"), ("a", "GO:7"), ("b", None), ("c", "GO:3")], "label string, term string")
    v = spark.createDataFrame([("GO:1", [1.0, 0.0]), ("GO:3", [4.0, 3.0])], "term string, vec array<float>")
    got = {r.label: r.feature for r in features.terms_appended(n, t, v).collect()}
    assert got == {"a": [1.0, 2.0, 1.0], "b": [2.0, 0.0, 0.0], "c": [4.0, 3.0], "d": None, "e": [5.0, 0.0, 0.0]}
    assert features.terms_appended(n, t, v.limit(0)).where("label = 'a'").first().feature == [1.0]
