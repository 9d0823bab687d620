"""Reports of small graphs with results worked out by hand."""

from weft.operators import report

SCHEMA = "src string, dst string, type string, time long, pathway string, local_order long"
EDGES = [
    ("a", "b", "reaction", 0, "P", 0), ("b", "c", "reaction", 10, "P", 1), ("c", "a", "catalysis", 2, "P", 4),  # a cycle
    ("a", "b", "reaction", 5, "Q", 0), ("x", "y", "catalysis", 5, "Q", None),
    ("z", "z", "reaction", 1, "R", 0),  # a loop alone
    ("a", "d", "reaction", 3, None, 2), (None, "d", "reaction", 3, "P", 9),
]
TYPES = [("a", "protein"), ("b", "complex"), ("c", "small_molecule"), ("x", "protein")]


def test_profile(spark):
    got = {(r.item, r.key): r.value for r in report.profile(spark.createDataFrame(EDGES, SCHEMA), spark.createDataFrame(TYPES, "label string, type string"), 2).collect()}
    assert got == {
        ("node_type", "protein"): 2, ("node_type", "complex"): 1, ("node_type", "small_molecule"): 1, ("node_type", "unknown"): 3, ("edge_type", "reaction"): 5, ("edge_type", "catalysis"): 2,
        ("hub", "a"): 4, ("hub", "b"): 3, ("orphan_edges", ""): 2, ("chain", "pathways"): 3, ("chain", "min"): 1, ("chain", "median"): 1, ("chain", "max"): 5,
        ("components", "weak"): 3, ("components", "strong"): 5, ("dag", ""): 0,
    }


def test_table(spark):
    got = {r.pathway: r.asDict() for r in report.table(spark.createDataFrame(EDGES, SCHEMA), spark.createDataFrame(TYPES, "label string, type string")).collect()}
    assert set(got) == {"P", "Q", "R", ""}
    assert got["P"] == {
        "pathway": "P", "nodes": 3, "edges": 3, "density": 0.5, "degree_avg": 2.0, "degree_max": 2, "is_dag": False, "wccs": 1, "largest_wcc_pct": 100.0, "isolated": 0, "ranks": 3,
        "tail_pct": 33.333333, "pct_protein": 33.333333, "pct_complex": 33.333333, "pct_small_molecule": 33.333333, "pct_reaction": 66.666667,
    }
    q, r = got["Q"], got["R"]
    assert (q["is_dag"], q["wccs"], q["largest_wcc_pct"], q["tail_pct"], q["pct_protein"], q["ranks"]) == (True, 2, 50.0, 100.0, 50.0, 1)
    assert (r["is_dag"], r["nodes"], r["density"], r["isolated"], r["degree_max"]) == (False, 1, 0.0, 1, 2)


def test_reports_of_nothing(spark):
    e, t = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "label string, type string")
    got = {(r.item, r.key): r.value for r in report.profile(e, t).collect()}
    assert got[("dag", "")] == 1 and got[("components", "weak")] == 0 and got[("chain", "median")] == 0 and got[("orphan_edges", "")] == 0
    assert report.table(e, t).count() == report.chain_histogram(e).count() == 0


def test_chain_histogram(spark):
    rows = [("a", "b", "reaction", 0, p, n - 1) for p, n in (("P", 1), ("Q", 99), ("R", 10), ("S", 10))]
    got = report.chain_histogram(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 24 and sum(r.pathways for r in got) == 4 and {r.median for r in got} == {10.0}
    assert all(r.low <= 10 < r.high for r in got if r.pathways == 2)
    one = sorted(tuple(r) for r in report.chain_histogram(spark.createDataFrame(rows[:1], SCHEMA)).collect())
    assert one == [(0, 0.5, 1.5, 1, 1.0), (1, 1.5, 2.5, 0, 1.0)]


def test_growth_bands_read_the_edges_once(spark):
    from weft.operators import analytics

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = spark.createDataFrame([("p", i) for i in range(5)] + [("q", 2)], "pathway string, local_order long").coalesce(1)
    x = analytics.growth_bands(e.mapInArrow(count, e.schema))
    assert x.count() == 5 and seen.value == 6


def test_forests_join_what_the_edges_join(spark, monkeypatch):
    """Chunks, forests that are let go, and several parts; loops and a null end too."""
    import random

    from weft.operators import analytics, forest

    for name, n in (("CHUNK", 7), ("MOST", 9), ("PART", 20)):
        monkeypatch.setattr(forest, name, n)
    r = random.Random(1)
    rows = [(r.randrange(-40, 40) * 9 + k, r.randrange(-40, 40) * 9 + k) for k in (0, 1) for _ in range(45)] + [(7000 + k, 7001 + k) for k in range(30)] + [(5, 5), (None, 8000), (8000, None)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows:
        a, b = sorted((top(b if a is None else a), top(a if b is None else b)))
        up[b] = a
    want = {x: top(x) for x in up}
    for kind in ("long", "int"):
        e = spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(3)
        found = analytics.weak_components(e)
        assert {x.label: x.component for x in found.collect()} == want and found.count() == len(want) and found.dtypes == [("label", e.dtypes[0][1]), ("component", e.dtypes[0][1])]
        assert {x.component: x.size for x in analytics.component_sizes(e).collect()} == {c: sum(v == c for v in want.values()) for c in want.values()}
    monkeypatch.undo()
    at, links = forest.hung(spark.createDataFrame([(j, i) for j in range(60) for i in range(j)], "u long, v long").repartition(3))
    assert at.count() == 60 and links.count() <= 8  # of 1770: what is left for the loop does not grow with the edges


def test_queries_of_reports_write_numbers(spark, monkeypatch):
    """The graph is written once, in numbers: its labels are spelt out where hubs are shown, and nowhere else."""
    from weft.operators import report
    from weft.plans import analytics_queries

    written, plain = [], report.staged

    def kept(df):
        written.append(df.dtypes)
        return plain(df)

    monkeypatch.setattr(report, "staged", kept)
    assert analytics_queries.a01_profile(spark, "/root/testdata/sf0.001").count() == 23
    whole = [dict(x) for x in written if {"src", "dst"} <= set(dict(x))]
    assert len(whole) == 1 and (whole[0]["src"], whole[0]["dst"]) == ("bigint", "bigint")


def test_fold_by_target_is_that_by_source(spark):
    from weft.plans import graph_queries

    a, b = (graph_queries.coded_graph(spark, "/root/testdata/sf0.001", by) for by in ("src", "dst"))
    assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    from weft.operators import edges

    lefts = [(["c", "a", "b"], "b"), (["a", "b"], "c"), (["a", "c"], None), ([], "a")]  # a catalyst that stands on the left
    rows = [(t, t, "p", "k", l, ["b", "d"], c) for t, (l, c) in enumerate(lefts * 2)]
    r = spark.createDataFrame(rows, "time long, local_order long, pathway string, control string, lefts array<string>, rights array<string>, catalyst string")
    a, b = (edges.folded(r, 3, by) for by in ("src", "dst"))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() > 6


def test_query_of_the_table_writes_numbers(spark, monkeypatch):
    """Ends and their graphs are one number each; the graph is written once, and a graph's name comes from its number."""
    from weft.operators import report
    from weft.plans import analytics_queries

    written, plain = [], report.staged

    def kept(df):
        written.append(dict(df.dtypes))
        return plain(df)

    monkeypatch.setattr(report, "staged", kept)
    got = analytics_queries.a02_full(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({r.pathway for r in got}) == 25 and all(isinstance(r.pathway, str) for r in got)
    whole = [x for x in written if {"src", "dst"} <= set(x)]
    assert whole == [{"src": "bigint", "dst": "bigint", "type": "string", "time": "bigint"}]
    assert all(x["node"] == "bigint" for x in written if "node" in x)
