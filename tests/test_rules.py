"""Hand-derived cases of single rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weft.functions import text as t
from weft.operators import analytics, closure, edges, metrics, overlay, splits
from weft.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_scalars(spark):
    r = one(
        spark, a=t.normal_id(F.lit("glucose [ChEBI:17234]")), b=t.normal_id(F.lit("UniProt:Q00001 ABC")), c=t.normal_id(F.lit("plain")), d=t.sequence_type(F.lit("ACGTN")), e=t.sequence_type(F.lit("ACGTACGTAN")),
        f=t.kmers(F.lit("acguacgu")), g=t.kmers(F.lit("acg")), h=t.label(F.lit("A"), F.lit("")), i=t.normal_id(F.lit(None).cast("string")), j=t.amino_shares(F.lit("AAC")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.g, r.h, r.i) == ("ChEBI:17234", "UniProt:Q00001", "plain", "protein", "dna", [], "A", None)
    assert sorted(r.f) == ["ACGT", "ACGT", "CGTA", "GTAC", "TACG"]
    assert r.j[0] == pytest.approx(2 / 3) and r.j[1] == pytest.approx(1 / 3)


@pytest.mark.parametrize("name,yes", [("IRAK4 E402*", True), ("MyD88 R196C", True), ("TICAM1 R141*", True), ("UNC93B1 L230Afs*188", True), ("E52del", True), ("p-4Y-MAL", False), ("TLR4", False), ("ATP", False), ("", False)])
def test_variant_names(spark, name, yes):
    assert one(spark, a=t.is_variant_name(F.lit(name))).a == yes


LINKS = [
    (["S1", "S2", "S3", "S4", "S5", "S6"], [("S1", "S2"), ("S1", "S3"), ("S2", "S4"), ("S3", "S4"), ("S5", "S6"), ("S6", "S5")], {"S1": 0, "S2": 1, "S3": 1, "S4": 2, "S5": 3, "S6": 3}),
    (["S5", "S6"], [("S5", "S6"), ("S6", "S5")], {"S5": 1, "S6": 1}),
    (["S1", "S2", "S3"], [("S1", "S2"), ("S2", "S3"), ("S3", "S2")], {"S1": 0, "S2": 1, "S3": 2}),
]


def test_step_depths(spark):
    steps = spark.createDataFrame([(str(i), s) for i, (ss, _, _) in enumerate(LINKS) for s in ss], "pathway string, step string")
    links = spark.createDataFrame([(str(i), a, b) for i, (_, ls, _) in enumerate(LINKS) for a, b in ls], "pathway string, step string, next string")
    got = {(r.pathway, r.step): r.local_order for r in closure.step_depths(spark, steps, links).collect()}
    assert got == {(str(i), s): d for i, (_, _, want) in enumerate(LINKS) for s, d in want.items()}


def test_fold_keeps_what_is_not_written(spark):
    log = spark.createDataFrame([("K", "A", "catalysis", 0, None, "p", "INHIBITION", 1), ("K", "A", "reaction", 1, 4, None, None, 2)], "src string, dst string, type string, time int, local_order int, pathway string, catalysis_type string, seq int")
    for x in (log, log.repartition(3), log.orderBy(F.desc("seq")), log.union(log)):
        r = edges.fold(x).first()
        assert (r.type, r.time, r.local_order, r.pathway, r.catalysis_type) == ("reaction", 1, 4, None, "INHIBITION")


def test_grouped_fold_equals_the_log(spark):
    rng = random.Random(4)
    some = lambda: sorted(rng.sample("abcdef", rng.randrange(0, 5)))
    rows = [(i, rng.choice([None, *"abcdef"]), rng.choice(["ACTIVATION", None]), rng.choice(["p", "q", None]), i, rng.choice([i, None]), some(), some()) for i in rng.sample(range(200), 60)]
    r = spark.createDataFrame(rows, "reaction long, catalyst string, control string, pathway string, time long, local_order long, lefts array<string>, rights array<string>")
    side = lambda c: r.select("reaction", F.posexplode(c).alias("pos", "label")).withColumn("pos", F.col("pos").cast("long"))
    log = edges.catalysis_writes(r, side("lefts")).unionByName(edges.reaction_writes(r, side("lefts"), side("rights")))
    want, got = edges.fold(log), edges.folded(r, 3)
    assert want.count() > 30 and got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # writes are spelt out behind the shuffle


def test_long_chains_are_told_in_few_rounds(spark):
    n = 3000
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.array(F.col("id") + 1, F.col("id") + 5)).alias("dst"))
    back = e.union(spark.createDataFrame([(n + 4, 2)], e.schema))
    began = time.time()
    assert analytics.is_acyclic(e) and not analytics.is_acyclic(back)
    turned = e.select((-F.col("src")).alias("src"), (-F.col("dst")).alias("dst"))
    assert analytics.is_acyclic(turned)
    assert time.time() - began < 120  # trimming takes hundreds of rounds


def test_acyclic_against_brute_force(spark):
    rng = random.Random(7)
    for n in (0, 4, 8, 11):
        pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(8 + n)}
        pairs = {p for p in pairs if p[0] != p[1]}
        left = set(pairs)
        while (kept := {p for p in left if any(q[1] == p[0] for q in left)}) != left:
            left = kept
        assert analytics.is_acyclic(spark.createDataFrame(sorted(pairs), "src int, dst int")) == (not left)


def test_ranks_do_not_send_the_true_ones_to_the_driver(spark):
    c = spark.range(1200).selectExpr("id div 12 query", "id * 31 % 101 score", "id % 12 = 0 is_true")
    r = metrics.ranks_of_true(c)
    assert "Broadcast" not in r._jdf.queryExecution().executedPlan().toString()
    assert r.count() == 100


def test_pathway_table_in_one_pass(spark):
    rows = [("a", "b", "reaction", 3, 1, "p"), ("a", "c", None, 5, 0, "p"), ("b", "a", "catalysis", 2, None, "p"), ("x", None, "reaction", None, 4, "q"), ("x", "y", "reaction", 1, 1, None)]
    e = spark.createDataFrame(rows, "src string, dst string, type string, time long, local_order long, pathway string")
    assert sorted(map(tuple, analytics.pathway_table(e).collect())) == [("p", 3, 5, 2, 0.5, 3), ("q", 1, None, 5, 1.0, 1)]


def test_disease_ranks_need_no_single_task(spark):
    r = spark.createDataFrame([(i, None if i % 9 == 0 else i * 7 % 50) for i in range(100)], "reaction long, step_key long")
    x = overlay.ranked(r, 4)
    assert "SinglePartition" not in x._jdf.queryExecution().executedPlan().toString()
    want = sorted((-1 if r.step_key is None else r.step_key, r.reaction) for r in r.collect())
    assert [y.reaction for y in x.orderBy("time").collect()] == [y for _, y in want]
    assert x.agg(F.min("time"), F.max("time")).first()[:] == (5, 104)


def test_splits_and_targets(spark):
    e = spark.createDataFrame([(i, "a", "b", t_) for i, t_ in enumerate([0, 0, 1, 2, 3])], "edge int, src string, dst string, time int")
    x = splits.temporal_split(e, 0.2)
    assert sorted((r.time, r.split) for r in x.collect()) == [(0, "train"), (0, "train"), (1, "train"), (2, "train"), (3, "test")]
    assert sorted(round(r.min_max, 4) for r in splits.order_targets(e).collect()) == [0, 0, 0.3333, 0.6667, 1]
    b = spark.createDataFrame([(t_, "train") for t_ in range(4)], "time int, split string")
    assert {r.time: r.bin for r in splits.order_bins(b, 4).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    n = spark.createDataFrame([(f"n{i}",) for i in range(50)], "label string")
    parts = {r.part: r["count"] for r in splits.node_parts(n, 3, 7, 9).groupBy("part").count().collect()}
    assert parts == {"test": 9, "val": 7, "train": 34}
    with pytest.raises(ValueError):
        splits.check_assignment(spark.createDataFrame([("x", "val")], "label string, part string"), n)


def test_metrics(spark):
    x = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert metrics.auc(x, "y", "s").first().auc == 0.625
    c = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (1, 0.9, False), (1, 0.1, False)], "query int, score double, is_true boolean")
    assert metrics.ranks_of_true(c).first()["rank"] == 2
    assert metrics.auc(x.where("y = 1"), "y", "s").first().auc is None


def test_components(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("d", "e", 3)], "src string, dst string, time int")
    c = analytics.weak_components(e)
    assert {r.label: r.component for r in c.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    b = analytics.component_buckets(c).first()
    assert (b.giant, b.from_2) == (0.6, 1.0)
    kinds = c.select("label", F.lit("x").alias("type"))
    assert [(r["size"], r.earliest) for r in analytics.inventory(c, e, kinds, 2, 5).collect()] == [(2, 3)]
    assert {r.time: r.components for r in analytics.forest_times(e).collect()} == {1: 1, 2: 1, 3: 2}
    assert analytics.is_acyclic(e) and not analytics.is_acyclic(e.union(spark.createDataFrame([("c", "a", 4)], e.schema)))
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f")], "src string, dst string")
    assert {r.label: r.component for r in analytics.strong_components(ring).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_neighbours_before_a_time(spark):
    e = spark.createDataFrame([("x", "v", 0.1, "t"), ("y", "v", 0.2, "t"), ("z", "v", 0.9, "t")], "src string, dst string, time double, type string")
    q = spark.createDataFrame([(1, "v", 0.5)], "query int, node string, time double")
    assert [r._t for r in splits.causal(q, splits.recent_in(e, 2)).collect()] == [0.2]
    assert sorted(r._t for r in splits.causal(q, e, 2).collect()) == [0.1, 0.2]


def test_loss_and_gain(spark):
    r = spark.createDataFrame([("r1", 0, "[DISEASE] D", 1), ("r2", 1, "[DISEASE] D", 2), ("r3", 0, "[DISEASE] D", 3)], "reaction string, n_products int, disease string, step_key int")
    r = overlay.ranked(r, 4)
    b = spark.createDataFrame([("r1", "TLR4"), ("r2", "TLR4")], "reaction string, branch string")
    v = spark.createDataFrame([("r1", "[MUT] M"), ("r2", "[MUT] M"), ("r3", "[MUT] M")], "reaction string, variant string")
    p = spark.createDataFrame([("r2", "R")], "reaction string, product string")
    assert {(x.src, x.dst, x.type, x.time) for x in overlay.loss_edges(r, b, v).collect()} == {("TLR4", "[MUT] M", "disease_branch", 5), ("[MUT] M", "[DISEASE] D", "loss_of_function", 6)}
    assert {(x.src, x.dst, x.type, x.subtype, x.time) for x in overlay.gain_edges(r, b, v, p).collect()} == {("TLR4", "R", "reaction", "disease", 6), ("[MUT] M", "TLR4", "catalysis", "disease_aberrant", 6), ("[MUT] M", "[DISEASE] D", "aberrant_product", None, 7), ("R", "[DISEASE] D", "disease_progression", None, 8)}
    assert [x.reaction for x in overlay.unanchored(r, b).collect()] == ["r3"]


def test_tables(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("1\tOne\tHomo sapiens\n2\tTwo\tMus musculus\n")
    assert [tuple(r) for r in tables.pathway_list(spark, str(tmp_path / "l.tsv"), "Homo sapiens").collect()] == [("1", "One")]
    (tmp_path / "n.csv").write_text("node,type,pc1,pc2,pc3,pc4\na,,1,,2,3\n")
    assert tuple(tables.nodes(spark, str(tmp_path / "n.csv")).first()) == ("a", "unk", 1, 0, 2, 3)
    (tmp_path / "v.tsv").write_text("k\t1\t2.5\n")
    assert tables.vectors(spark, str(tmp_path / "v.tsv")).first().vector == [1, 2.5]
    (tmp_path / "s.json").write_text('{"7": {"val": ["a"], "test": ["b"]}}')
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    assert {r.label: r.part for r in tables.split_cache(spark, str(tmp_path / "s.json"), 7, n).collect()} == {"a": "val", "b": "test", "c": "train"}
    tables.save_graph(n, n, str(tmp_path / "g"))
    assert tables.load_graph(spark, str(tmp_path / "g"))[0].count() == 3
    assert "a\\_b" in tables.latex([{"a_b": 1}], ["a_b"])
