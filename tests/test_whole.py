"""Operators and queries that take every row, held against brute force."""

from collections import Counter

import numpy as np

from weft.operators import analytics, splits
from weft.plans import analytics_queries as aq
from weft.plans import ml_queries as mq
from weft.plans import text_queries as tq

SMALL = "/root/testdata/sf0.001"


def bands(edges, last):
    steps = {}
    for pathway, step in edges:
        steps.setdefault(pathway, Counter())[step] += 1
    curves = np.array([np.cumsum([c[i] for i in range(last + 1)]) for c in steps.values()])
    return [(i, *(round(float(x), 4) for x in np.percentile(curves[:, i], [25, 50, 75]))) for i in range(last + 1)]


def test_growth_bands_reach_the_last_step(spark):
    rows = [("a", i) for i in range(70)] + [("b", 3), ("b", 3), ("c", 55)]
    e = spark.createDataFrame(rows, "pathway string, local_order long")
    assert sorted(tuple(r) for r in analytics.growth_bands(e).collect()) == bands(rows, 69)
    assert sorted(tuple(r) for r in analytics.growth_bands(e, 60).collect()) == bands(rows, 60)


def test_growth_bands_query(spark):
    rows = [tuple(r) for r in aq.graph(spark, SMALL).select("pathway", "local_order").collect()]
    last = max(x for _, x in rows)
    assert last > 40
    assert sorted(tuple(r) for r in aq.a07(spark, SMALL).collect()) == bands(rows, last)


def unions(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components_of_all_orders(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    e = aq.sparse(spark, SMALL).collect()
    assert len(e) == orders
    want = unions([(r.src, r.dst) for r in e])
    assert {r.label: r.component for r in aq.a09(spark, SMALL).collect()} == want
    size = Counter(want.values())
    assert len(size) > orders / 10 and max(size.values()) > 20
    b = aq.a19(spark, SMALL).first()
    share = lambda lo, hi: round(sum(n for n in size.values() if lo <= n <= hi) / len(want), 6)
    assert (b.giant, b.over_20, b.from_6, b.from_2) == (round(max(size.values()) / len(want), 6), share(21, 10**9), share(6, 20), share(2, 5))
    rest = sorted((-n, c) for c, n in size.items())[1:21]
    assert sorted((-r["size"], r.component) for r in aq.a20(spark, SMALL).collect()) == rest
    first = {}
    for r in e:
        for x in (r.src, r.dst):
            first[x] = min(r.time, first.get(x, r.time))
    got = {r.time: r.components for r in aq.a09t(spark, SMALL).collect()}
    for at in (min(got), 50, max(got)):
        assert got[at] == len(set(unions([(r.src, r.dst) for r in e if r.time <= at]).values()))


def test_overlay_of_all_orders(spark):
    orders = {r.o_orderkey: r for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()}
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").collect()
    of = lambda numbers, mark, k: {o: {mark + str(x[k]) for x in lines if x.l_orderkey == o and x.l_linenumber in numbers} for o in orders}
    b, v, p = of((1, 2), "s", "l_suppkey"), of((2, 3), "[MUT] ", "l_partkey"), of((4,), "p", "l_partkey")
    d = lambda o: "[DISEASE] " + orders[o].o_orderpriority
    loss, gain = Counter(), Counter()
    for o in orders:
        if o % 2 == 0:
            loss.update([(x, y, "disease_branch", None, 3 * o, o) for x in b[o] for y in v[o]])
            loss.update([(y, d(o), "loss_of_function", None, 3 * o + 1, o) for y in v[o] if b[o]])
        elif b[o]:
            gain.update([(x, y, "reaction", "disease", 3 * o, o) for x in b[o] for y in p[o]])
            gain.update([(y, x, "catalysis", "disease_aberrant", 3 * o, o) for x in b[o] for y in v[o]])
            gain.update([(y, d(o), "aberrant_product", None, 3 * o + 1, o) for y in v[o]])
            gain.update([(y, d(o), "disease_progression", None, 3 * o + 2, o) for y in p[o]])
    take = lambda x: Counter((r.src, r.dst, r.type, r.subtype, r.time, r.reaction) for r in x.collect())
    assert take(tq.d13(spark, SMALL)) == loss
    assert take(tq.d14(spark, SMALL)) == gain
    assert {r.reaction for r in tq.d10(spark, SMALL).collect()} == {o for o in orders if not b[o]}


def test_causal_of_all_edges(spark):
    e = mq.timed(spark, SMALL).collect()
    at = {}
    for r in e:
        at.setdefault(r.dst, []).append((r.time, r.src, r.type))
    for f, before, after in ((mq.t13, 10, None), (mq.t13b, None, 3)):
        near = {}  # line items that share a number are one query
        for r in e:
            found = [x for x in sorted(at[r.dst], reverse=True)[:before] if x[0] < r.time]
            near.setdefault(r.edge, []).extend((*x, r.time) for x in found)
        want = {q: [(x[0], x[3]) for x in sorted(n, reverse=True)[:after]] for q, n in near.items() if n}
        got = {x.query: (x.n, x.nearest) for x in f(spark, SMALL).collect()}
        assert len(got) == len(want)
        assert {q: n for q, (n, _) in got.items()} == {q: len(n) for q, n in want.items()}
        once = {q for q, c in Counter(r.edge for r in e).items() if c == 1}
        assert {q: d for q, (_, d) in got.items() if q in once} == {q: min(t - s for s, t in n) for q, n in want.items() if q in once}


def test_negatives_fill_up_from_the_pool(spark):
    n = 200
    nodes = spark.createDataFrame([(f"p{i}", "a", i) for i in range(n)] + [("q0", "b", 0)], "label string, type string, id long")
    taken = {"two": set(range(n)) - {17, 18, 150}, "one": set(range(n)) - {0}, "none": set(range(n)), "test": set(range(n)) - {5, 6, 199}, "few": {1}}
    train = [(s, f"p{i}") for s, ids in taken.items() for i in ids]
    rows = [(j * 10 + i, s, "p5" if s == "test" else "p1") for i, s in enumerate(taken) for j in range(40)]
    e = spark.createDataFrame(rows, "edge long, src string, dst string")
    got = {}
    for r in splits.partner_free_negatives(e, spark.createDataFrame(train, "src string, dst string"), nodes, 2, 6).collect():
        got.setdefault(r.edge, []).append(r.negative)
    assert {edge: len(x) for edge, x in got.items()} == {edge: 2 for edge, _, _ in rows}
    of = {s: [got[edge] for edge, x, _ in rows if x == s] for s in taken}
    assert all(len(set(x)) == 2 for s in ("two", "test", "few") for x in of[s])
    assert {y for x in of["two"] for y in x} == {"p17", "p18", "p150"}
    assert {y for x in of["test"] for y in x} == {"p6", "p199"}
    assert {y for x in of["one"] for y in x} == {"p0"}
    assert len({y for x in of["none"] for y in x}) > 30
    assert all("p1" not in x for x in of["few"])
