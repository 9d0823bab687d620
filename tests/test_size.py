"""Queries that grew faster than their input: each step that was changed, held against the plain way."""

import random
from collections import Counter

from pyspark.sql import functions as F

from weft.operators import edges, features, splits
from weft.plans import adapter, analytics_queries, graph_queries

SMALL = "/root/testdata/sf0.001"


def test_draws_beside_the_source_are_those_of_the_joins(spark, monkeypatch):
    r = random.Random(5)
    nodes = spark.createDataFrame([(f"p{i}", "a" if i % 2 else "b", i // 2) for i in range(60)] + [("s1", "a", 30)], "label string, type string, id long")
    train = [(f"s{s}", f"p{i}") for s in range(6) for i in range(60) if r.random() < s / 5.5] + [("s9", "x")]
    rows = [(j, f"s{r.randrange(7)}", f"p{r.randrange(62)}") for j in range(150)] + [(7, "s2", "p4"), (7, "s2", "p5"), (7, "s2", "p6"), (8, "s3", "p1"), (8, "s3", "p1")]
    e, t = spark.createDataFrame(rows, "edge long, src string, dst string"), spark.createDataFrame(train, "src string, dst string")
    take = lambda x, own: Counter((r.edge, r.negative) for r in splits.partner_free_negatives(x, t, own, 2, 6, tries=2).collect())
    here = take(e, nodes)
    monkeypatch.setattr(splits, "INLINE", -1)  # all by joins
    assert here == take(e, nodes) and len(here) > 200

    def no(*_):
        raise AssertionError("a row for each draw")

    monkeypatch.setattr(splits, "INLINE", 1024)
    monkeypatch.setattr(splits, "_by_joins", no)
    one = e.where("edge > 8")
    assert take(one, nodes) == Counter({x: n for x, n in here.items() if x[0] > 8})


def test_add_if_absent_in_one_pass(spark):
    r, left = adapter.reactions(spark, SMALL), adapter.side(spark, SMALL, "left")
    x = r.join(adapter.sides(spark, SMALL, 4), "reaction").select("time", "lefts")
    for a, b in ((10, 3), (3, 5), (2, 997)):
        offered = edges.partner_writes(r.where(f"time % {a} = 0"), left, "k").select("src", "dst", "time")
        there = edges.partner_writes(r.where(f"time % {b} = 0"), left, "k")
        want = edges.first_only(there, offered, "time").collect()
        got = edges.first_offered(edges.partners(x, 4), "time", F.col("time") % a == 0, F.col("time") % b == 0).collect()
        assert sorted(map(tuple, got)) == sorted((w.src, w.dst, w.time) for w in want)
    assert want


def test_pooling_pairs_only_what_holds_a_vector(spark, monkeypatch):
    m = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c12", "q"), ("c12", "r"), ("d", "p"), ("d", "q"), ("p", "d")], "parent string, child string")
    things = [*[(f"c{k}", "complex", k, None) for k in range(13)], ("d", "complex", 20, None), ("p", "protein", 30, [1.0, 3.0]), ("q", "protein", 31, None), ("r", "protein", 32, [1.0])]
    n = spark.createDataFrame(things, "label string, type string, ord long, feature array<float>")
    t = n.select(F.col("label").alias("id"), "label", "ord")
    plain, pairs = features.reachable, []

    def counted(*a):
        found = plain(*a)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(features, "reachable", counted)
    got = {r.label: r.feature for r in features.nested_pooled(m, t, n).collect()}
    assert got == {**{f"c{k}": [0.0, 0.0] for k in range(13)}, "d": [1.0, 3.0]}
    assert pairs == [2]  # p with itself and with d


def test_base_time_without_a_fold(spark, monkeypatch):
    want = graph_queries.graph(spark, SMALL).where("time <> 0").agg(F.max("time")).first()[0]

    def no(*_):
        raise AssertionError("folded")

    monkeypatch.setattr(edges, "folded", no)
    assert graph_queries.o08(spark, SMALL).collect() == [(want,)]


def test_degrees_and_first_times_fold_once(spark):
    for f in (analytics_queries.a13, analytics_queries.a04):
        assert "lineitem" not in f(spark, SMALL)._jdf.queryExecution().toString()  # the fold is behind a staged table, not in each branch


def test_the_fold_in_numbers_is_that_of_the_labels(spark):
    log = graph_queries.log(spark, SMALL)
    want, got = edges.fold(log), graph_queries.graph(spark, SMALL)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    assert "SortAggregate" not in graph_queries.coded_graph(spark, SMALL)._jdf.queryExecution().executedPlan().toString()  # values of fixed width, so nothing is sorted for the fold


def test_codes_keep_labels(spark, tmp_path):
    spark.createDataFrame([(1, None, 7), (1, -3, 7), (1, 2, None), (2, 0, 5)], "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 4, None, 1), (2, -4, "F", 0)], "o_orderkey long, o_custkey long, o_orderstatus string, d int").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "timestamp_seconds(d) o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(4, 1), (-4, 2)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1, "A"), (2, None)], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    got = {tuple(r) for r in graph_queries.graph(spark, str(tmp_path)).collect()}
    one = {(s, p, "reaction", 1, 0, "A", None) for s in ("s-3", "s2", None) for p in ("p7", None)} | {("c4", s, "catalysis", 1, 0, "A", "ACTIVATION") for s in ("s-3", "s2", None)}
    assert got == one | {("c-4", "s0", "catalysis", 0, 0, None, "INHIBITION"), ("s0", "p5", "reaction", 0, 0, None, None)}


def test_partner_edges_are_spelt_out_in_their_part(spark):
    """Equal to the pairs of both sides' joins; nothing is paired, or taken out, by a join of pairs."""
    left = adapter.side(spark, SMALL, "left")
    a, b = left.select("reaction", F.col("label").alias("x")), left.select("reaction", F.col("label").alias("y"))
    same = a.join(b, "reaction").where("x < y and substr(x, -1) = substr(y, -1)")
    want = edges.partner_writes(adapter.reactions(spark, SMALL), left, "left_reactant", same).groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("time").alias("time"))
    got = graph_queries.g06(spark, SMALL)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join") <= 3  # customer, nation and the sides
