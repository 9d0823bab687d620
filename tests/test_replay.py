"""Statistics of event histories and two-level sums, held against brute force."""

import random

from pyspark.sql import functions as F

from weft.operators import replay
from weft.operators.rank import mid_rank, running_sums
from weft.operators.splits import order_targets


def brute(rows):
    """event -> transitivity; rows in order."""
    out, n = {}, {}
    for event, i, j, kind, _ in rows:
        out[event] = sum(n.get((kind, i, k), 0) * n.get((kind, k, j), 0) for k in range(12))
        n[kind, i, j] = n.get((kind, i, j), 0) + 1
    return out


def some(n, seed):
    r = random.Random(seed)
    hub = lambda: 0 if r.random() < 0.35 else r.randrange(12)  # noqa: E731  one node has a third of all ends
    return [(k, hub(), hub(), r.choice("xy"), r.randrange(n // 3)) for k in range(n)]


SCHEMA = "event long, src long, dst long, type string, time long"


def test_transitivity(spark):
    rows = some(400, 1)
    assert any(a == b for _, a, b, _, _ in rows)
    got = replay.transitivity(replay.positions(spark.createDataFrame([*rows, (900, None, 1, "x", 3), (901, 1, 2, None, 3)], SCHEMA).repartition(3)))
    assert {r.event: r.transitivity for r in got.collect()} == brute(sorted(rows, key=lambda r: (r[4], r[0])))


def test_transitivity_starts_from_training_totals(spark):
    rows = sorted(some(200, 2), key=lambda r: (r[4], r[0]))
    train, scored = rows[100:], rows[:100]  # training events count first even where their times are later
    e = replay.replayed(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(scored, SCHEMA))
    assert e.where("own").count() == 100
    assert {r.event: r.transitivity for r in replay.transitivity(e).collect()} == brute(train + scored)


def test_transitivity_in_blocks(spark):
    rng = random.Random(3)
    rows = [(2**60 + i, rng.randrange(5), rng.randrange(5), rng.choice("xy"), i) for i in range(120)]
    e = replay.positions(spark.createDataFrame(rows, "event long, src int, dst int, type string, time long"))
    want = {}
    for event, i, j, kind, at in rows:
        n = lambda x, y: sum(r[1] == x and r[2] == y and r[3] == kind and r[4] < at for r in rows)  # noqa: E731, B023
        want[event] = sum(n(i, k) * n(k, j) for k in range(5))
    for block in (1, 7, 1000):
        got = replay.transitivity(e, block)
        assert {r.event: r.transitivity for r in got.collect()} == want


def test_transitivity_of_nothing(spark):
    assert replay.transitivity(replay.positions(spark.createDataFrame([], SCHEMA))).count() == 0


def test_likeness(spark):
    e = spark.createDataFrame([(1, 1, 2, "x", 0), (2, 1, 3, "x", 0), (3, 1, 9, "x", 0)], SCHEMA)
    n = spark.createDataFrame([(1, 0.5, "a"), (2, 2.0, "a"), (3, None, "b")], "label long, s double, kind string")
    assert sorted(tuple(r) for r in replay.likeness(e, n, ["s"], "kind").collect()) == [(1, -1.5, 1), (2, None, 0), (3, None, None)]


def test_running_sums(spark):
    r = random.Random(3)
    rows = [(g, t, r.randrange(9)) for g in ("a", None) for t in [*r.sample(range(1000), 150), None]] + [("b", 5, 2)]
    x = spark.createDataFrame(rows, "g string, t long, v long").repartition(3)
    for inclusive in (True, False):
        got = running_sums(x, ["g"], "t", {"up": F.col("v")}, inclusive, buckets=7)
        late = lambda t: (t is None, t or 0)  # noqa: E731  a null comes last
        want = {(g, t): sum(v2 for g2, t2, v2 in rows if g2 == g and (late(t2) < late(t) or inclusive and t2 == t)) for g, t, _ in rows}
        assert {(a.g, a.t): a.up for a in got.collect()} == want
    assert running_sums(x.where("false"), [], "t", {"up": F.col("v")}).count() == 0


def test_sums_have_no_window_without_partitions(spark):
    x = spark.range(100).select((F.col("id") % 10).alias("s"))
    plan = mid_rank(x, "s", "r")._jdf.queryExecution().toString()
    assert plan.count("SinglePartition") <= 1  # the totals of the buckets


def test_order_targets(spark):
    e = spark.createDataFrame([(1, 10), (2, 12), (3, 10), (4, 11)], "edge long, time long")
    got = {r.edge: (r.min_max, round(r.log_min_max, 6), round(r["rank"], 6)) for r in order_targets(e).collect()}
    assert got == {1: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.333333), 4: (0.5, 0.63093, 0.666667), 2: (1.0, 1.0, 1.0)}
    one = order_targets(spark.createDataFrame([(1, 7)], "edge long, time long")).first()
    assert (one.min_max, one.log_min_max, one["rank"]) == (0.0, 0.0, 0.0)
    near = order_targets(spark.createDataFrame([(1, 7), (2, 8)], "edge long, time long")).where("edge = 2").first()
    assert round(near.log_min_max, 6) == 0.693147  # the span of logarithms is under 1
