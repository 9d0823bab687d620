"""The overlay in one call against a plain replay, and substring matching against all pairs."""

import random


from weft.operators import disease, overlay


def entity(id_, source, store, name=None, members=(), components=(), db=None, omim=(), mod=False):
    return (id_, source, store, name, f"{name}!" if name else None, db, f"U{id_}", list(omim), [], [], list(members), list(components), store == 5, mod)


ENTITIES = [
    entity("s1", 0, 0, "Alpha", db="11"), entity("s2", 0, 1, "Beta"), entity("cx", 0, 5, "Weird complex", components=["s2", "in", "cx"]), entity("in", 0, 5, "Inner", members=["s1", "gone"]),
    entity("grp", 0, 4, "Kinase variants", members=["v1", "v2", "grp"]), entity("v1", 0, 0, "KIN E402*", omim=["9"]), entity("v2", 0, 0, "KIN R1C", mod=True), entity("v2", 1, 0, "healthy twin"),
    entity("hg", 0, 4, "outer set", members=["h1", "h2"]), entity("h1", 1, 0, "Only healthy"), entity("h2", 1, 4, "more", members=["h3"]), entity("h3", 1, 0, "Third"), entity("mv", 0, 0, "plain", mod=True),
    entity("pr", 0, 0, "Product"), entity("pg", 1, 4, "ps", members=["pa", "pb"]), entity("pa", 1, 0, "PA"), entity("pb", 1, 0, "PB"), entity("nolabel", 0, 0),
]
REACTIONS = [
    ("r1", "First", ["see MIM:77 mim:5"], "Dis", ["1"], 3), ("r2", "Second", None, "", [], 1), ("r3", "Third", ["x MIM:8", "MIM:8 MIM:4"], "Dis", ["2"], 2),
    ("r4", "Fourth", [], None, ["3"], 4), ("r5", "Fifth", None, "Other", ["3"], 5),
]
LEFTS = [("r1", "s1"), ("r1", "grp"), ("r2", "cx"), ("r3", "grp"), ("r3", "s2"), ("r4", "nothing"), ("r5", "mv"), ("r5", "hg")]
RIGHTS = [("r1", "pr"), ("r2", "nolabel"), ("r3", "pg"), ("r5", "pg")]
CATALYSTS = [("r1", "grp"), ("r2", "gone")]
NODES = [("N1", "alpha!x", "11", None), ("N2", "BETA!", None, ["second name"]), ("N3", "only healthy!", None, None), ("N4", "only healthy!", None, ["third!"]), ("PA!", None, None, None)]


def frames(spark):
    make = spark.createDataFrame
    ids = "reaction string, id string"
    return (
        make(REACTIONS, "reaction string, name string, comments array<string>, disease string, pathway_omim array<string>, step_key int"), make(LEFTS, ids), make(RIGHTS, ids), make(CATALYSTS, ids),
        make(ENTITIES, disease.ENTITY), make(NODES, "label string, name string, db_id string, aliases array<string>"),
    )


def test_two_stores(spark):
    *_, entities, _ = frames(spark)
    roots = spark.createDataFrame([("grp",), ("hg",), ("cx",), ("gone",), ("pg",)], "id string")
    pairs = lambda df: sorted((r.root, r.node) for r in df.collect())
    assert pairs(disease.variants(roots, entities)) == [("cx", "cx"), ("grp", "v1"), ("grp", "v2"), ("hg", "h1"), ("hg", "h3"), ("pg", "pa"), ("pg", "pb")]
    assert pairs(disease.end_labels(roots, entities)) == [("cx", "cx"), ("grp", "v1"), ("grp", "v2"), ("pg", "pa"), ("pg", "pb")]  # hg is in the disease file, its members are not
    assert pairs(disease.decomposed(roots.union(spark.createDataFrame([("s1",)], "id string")), entities)) == [("cx", "s1"), ("cx", "s2"), ("grp", "grp"), ("hg", "hg"), ("s1", "s1")]
    got = {r.id for r in disease.first_store(entities.where("source = 0")).where(disease.is_variant()).collect()}
    assert got == {"grp", "v1", "v2", "mv"}


def test_apply(spark):
    out = disease.apply(*frames(spark), base=10)
    assert {r.reaction: r.time for r in out.anchored.collect()} == {"r2": 11, "r3": 12, "r1": 13}
    assert {r.reaction for r in out.unanchored.collect()} == {"r4", "r5"}
    edges = sorted((r.src, r.dst, r.type, r.subtype, r.time, r.reaction) for r in out.edges.collect())
    d1, d2, d3 = "[DISEASE] Dis (OMIM:1)", "[DISEASE] Second", "[DISEASE] Dis (OMIM:2)"
    got = {(e[1]) for e in edges if e[1].startswith("[DISEASE]")}
    assert got == {d1, d2, d3}
    want = [("N1", "[MUT] Second", "disease_branch", None, 11, "r2"), ("N2", "[MUT] Second", "disease_branch", None, 11, "r2"), ("[MUT] Second", d2, "loss_of_function", None, 12, "r2")]
    for v in ("[MUT] KIN E402*", "[MUT] KIN R1C"):
        want += [(v, "N2", "catalysis", "disease_aberrant", 12, "r3"), (v, d3, "aberrant_product", None, 13, "r3"), (v, "N1", "catalysis", "disease_aberrant", 13, "r1"), (v, d1, "aberrant_product", None, 14, "r1")]
    for p in ("PA!", "PB!"):
        want += [("N2", p, "reaction", "disease", 12, "r3"), (p, d3, "disease_progression", None, 14, "r3")]
    want += [("N1", "Product!", "reaction", "disease", 13, "r1"), ("Product!", d1, "disease_progression", None, 15, "r1")]
    key = lambda e: tuple(str(x) for x in e)
    assert sorted(edges, key=key) == sorted(want, key=key)
    kinds = {r.node: r.type for r in out.nodes.collect()}
    assert kinds == {d1: "disease_phenotype", d2: "disease_phenotype", d3: "disease_phenotype", "[MUT] Second": "mutant_variant", "[MUT] KIN E402*": "mutant_variant", "[MUT] KIN R1C": "mutant_variant", "Product!": "disease_product", "PB!": "disease_product"}
    report = out.report().first()
    assert (report.n_anchored, report.n_unanchored, report.n_disease_nodes, report.n_edges) == (3, 2, 3, len(want))


def test_apply_with_roots_and_one_variant_each(spark):
    roots = spark.createDataFrame([("N1",), ("N2",)], "label string")
    out = disease.apply(*frames(spark), base=0, expand_variants=False, roots=roots)
    assert out.unanchored.count() == 0 and out.anchored.count() == 5
    assert {r.node for r in out.nodes.where("type = 'mutant_variant'").collect()} == {f"[MUT] {n}" for n in ("First", "Second", "Third", "Fourth", "Fifth")}


def test_mined(spark):
    rows = [
        ("a", "Shown", ["x causes SCID often (Name One; MIM:7)", "(Other; MIM:8) mim:7"], None, None, [("OMIM", "5"), ("ChEBI", "6"), ("mondo", "7")]), ("b", "Shown", ["nothing", "causes AB-1 so"], None, ["3"], None),
        ("c", "Shown", None, "Vocabulary", ["3", "3"], []), ("d", "Shown", [], None, None, None),
    ]
    df = spark.createDataFrame(rows, "pathway string, display string, comments array<string>, vocabulary string, vocabulary_omim array<string>, xrefs array<struct<db:string,id:string>>")
    assert {r.pathway: (r.disease, r.omim) for r in disease.mined(df).collect()} == {"a": ("Name One", ["7", "8", "5"]), "b": ("AB-1", ["3"]), "c": ("Vocabulary", ["3"]), "d": ("Shown", [])}


def test_substrings(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab%c") for _ in range(r.randrange(n)))
    a, b = {word(6) for _ in range(60)} | {"ß", "a"}, {word(14) for _ in range(90)} | {"ßab", "a"}
    got = overlay.containing(spark.createDataFrame([(x,) for x in a], "short string"), spark.createDataFrame([(x,) for x in b], "long string"))
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in a for y in b if x and x in y)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
