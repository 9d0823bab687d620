"""Choice and rate models, held against brute force over all alternatives of every event."""

import math
import random

import numpy as np

from weft.operators import choice, replay

SCHEMA = "event long, src long, dst long, type string, time long"
N = 9


def some(n, seed):
    r = random.Random(seed)
    hub = lambda: 0 if r.random() < 0.35 else r.randrange(N)
    rows = [(k, hub(), hub(), r.choice("xxy"), r.randrange(n // 3)) for k in range(n)]
    return sorted(rows, key=lambda r: (r[4], r[0]))


KINDS = {k: None if k == 4 else "ab"[k % 2] for k in range(N)}
SCORES = {k: None if k == 3 else (k * 7 % 5) / 2 for k in range(N)}


def choice_sets(rows, kind):
    """For each event of the type: the statistics of all alternatives, and which was chosen."""
    n, out = np.zeros((N, N)), []
    for _, i, j, t, _ in rows:
        if t != kind or i == j:
            continue
        alts = [k for k in range(N) if k != i]
        out.append((np.array([[n[i, k], n[k, i], n[i] @ n[:, k], float((KINDS[i] or "unk") == (KINDS[k] or "unk"))] for k in alts]), alts.index(j)))
        n[i, j] += 1
    return out


def rate_sets(rows, kind):
    deg, out = np.zeros((N, 2)), []
    for _, i, j, t, _ in rows:
        if t != kind or i == j:
            continue
        out.append((np.array([[*deg[k], SCORES[k] or 0.0] for k in range(N)]), i))
        deg[i, 1] += 1
        deg[j, 0] += 1
    return out


def newton(sets, cols):
    beta = np.zeros(len(cols))
    for _ in range(60):
        value, g, h = 0.0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
        for x, c in sets:
            x = x[:, cols]
            u = x @ beta
            p = np.exp(u - u.max())
            value += u[c] - u.max() - math.log(p.sum())
            p /= p.sum()
            m = p @ x
            g += x[c] - m
            h += (x * p[:, None]).T @ x - np.outer(m, m)
        beta = beta + np.linalg.solve(h, g)
    return beta, value


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) < 1e-6 * max(1, abs(want[k])), (k, got[k], want[k])


def nodes(spark):
    return spark.createDataFrame([(k, KINDS[k], SCORES[k]) for k in range(N)], "label long, kind string, s double")


def test_choice_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(choice, "BUCKET", 37)
    rows = some(300, 1)
    assert any(i == j for _, i, j, _, _ in rows)
    e = replay.positions(spark.createDataFrame(rows, SCHEMA).repartition(3))
    names = ["inertia", "reciprocity", "transitivity", "same"]
    for transitive, cols in ((True, [0, 1, 2, 3]), (False, [0, 1, 3])):
        got = choice.fit(choice.choice_tables(e, nodes(spark), transitive), choice.CHOICE).collect()
        for kind in "xy":
            sets = choice_sets(rows, kind)
            beta, value = newton(sets, cols)
            mine = [r for r in got if r.model == kind]
            assert {(r.spec, r.events) for r in mine} == {(" + ".join(names[c] for c in cols), len(sets))}
            close({r.term: r.beta for r in mine} | {"ll": mine[0].log_likelihood}, {names[c]: b for c, b in zip(cols, beta)} | {"ll": value})


def test_rate_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(choice, "BUCKET", 29)
    rows = some(300, 2)
    e = replay.positions(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = choice.fit(choice.rate_tables(e, nodes(spark), ["s"]), choice.rates(["s"])).collect()
    for kind in "xy":
        beta, value = newton(rate_sets(rows, kind), [0, 1, 2])
        mine = [r for r in got if r.model == kind]
        close({r.term: r.beta for r in mine} | {"ll": mine[0].log_likelihood}, dict(zip(("in_degree", "out_degree", "s"), beta)) | {"ll": value})


def test_falls_back_where_statistics_do_not_vary(spark):
    """Sellers never sell back and all nodes are of one kind, so only inertia is left; where nobody chooses twice, nothing is."""
    r = random.Random(3)
    rows = [(k, r.randrange(3), 3 + min(r.randrange(6), r.randrange(6)), "x", k) for k in range(80)] + [(100, 1, 5, "once", 0)]
    n = spark.createDataFrame([(k, "a") for k in range(N)], "label long, kind string")
    got = choice.fit(choice.choice_tables(replay.positions(spark.createDataFrame(rows, SCHEMA)), n), choice.CHOICE).collect()
    assert {(r.model, r.spec, r.term, r.events) for r in got} == {("x", "inertia", "inertia", 80), ("once", None, None, 1)}
    beta, _ = newton(choice_sets(rows, "x"), [0])
    assert abs(next(r.beta for r in got if r.spec) - beta[0]) < 1e-6


def test_fit_of_nothing(spark):
    e = replay.positions(spark.createDataFrame([(1, 1, 1, "x", 0), (2, 1, 99, "x", 0), (3, None, 2, "x", 0)], SCHEMA))
    assert choice.fit(choice.choice_tables(e, nodes(spark)), choice.CHOICE).count() == 0
    assert choice.fit(choice.rate_tables(e, nodes(spark), ["s"]), choice.rates(["s"])).count() == 0


def test_steps_shuffle_totals_only(spark):
    e = replay.positions(spark.createDataFrame(some(60, 4), SCHEMA))
    rows, _, names = choice.choice_tables(e, nodes(spark))
    assert names and rows.count() > 60
    plan = rows.groupBy("model", "grp", "bucket").agg({"n_same": "sum"})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # each group's bucket lies in one file that Spark knows of


def test_choice_query_has_transitivity(spark, monkeypatch):
    """Of all specifications the query tries the full one first: its terms are brute force's over all customers."""
    from weft.plans import ml_queries

    monkeypatch.setattr(ml_queries, "history", lambda *_: spark.createDataFrame(some(300, 1), SCHEMA).repartition(3))
    monkeypatch.setattr(ml_queries, "actors", lambda *_: nodes(spark))
    got = ml_queries.l07_choice(spark, None).collect()
    for kind in "xy":
        sets = choice_sets(some(300, 1), kind)
        beta, value = newton(sets, [0, 1, 2, 3])
        mine = [r for r in got if r.model == kind]
        assert {(r.spec, r.events) for r in mine} == {("inertia + reciprocity + transitivity + same", len(sets))}
        close({r.term: r.beta for r in mine} | {"ll": mine[0].log_likelihood}, dict(zip(("inertia", "reciprocity", "transitivity", "same"), beta)) | {"ll": value})


def test_replay_equals_rows(spark, monkeypatch):
    """Blocks, chunks, nodes without events, and too many nodes for a replay."""
    rows = [(k, i, j, t, w) for k, i, j, t, w in some(240, 6) if 7 not in (i, j)] + [(1000, 2, 99, "x", 5)]
    e = replay.positions(spark.createDataFrame(rows, SCHEMA).repartition(3))
    monkeypatch.setattr(choice, "BLOCK", 31)
    monkeypatch.setattr(choice, "CELLS", 70)
    n = spark.createDataFrame([(k, KINDS.get(k, "a")) for k in [*range(N), 20, 21]], "label long, kind string")
    want = {(r.model, r.term): (r.beta, r.log_likelihood, r.events) for r in choice.fit(choice.choice_tables(e, n, True), choice.CHOICE).collect()}
    found = choice.choice_replay(e, n)
    assert found.rows.select("model", "block").distinct().count() > 8
    assert "Exchange" not in found.rows.groupBy("model", "block").agg({"n": "sum"})._jdf.queryExecution().executedPlan().toString()
    for dense in (8, 7):
        monkeypatch.setattr(choice, "DENSE", dense)
        assert (choice.choice_replay(e, n) is None) == (dense == 7)
        got = {(r.model, r.term): (r.beta, r.log_likelihood, r.events) for r in choice.fit_choice(e, n).collect()}
        assert len(got) == 8 and got.keys() == want.keys()
        for k, v in want.items():
            assert got[k][2] == v[2] and np.allclose(got[k], v, rtol=1e-6)
