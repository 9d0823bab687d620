"""A file to its hypergraph: results derived by hand."""

from tests.test_builder import m1, pathway, protein, rec, reaction, step, write  # noqa: F401
from weft.operators import builder, hypergraph


def edges(h):
    return {r.edge: r for r in h.edges.collect()}


def short(nodes):
    return [n.split(" [")[0] for n in nodes]


def test_catalysed_assembly(spark, m1):  # noqa: F811
    h = builder.build_hypergraph(spark, m1)
    e = edges(h)
    want = {
        "BiochemicalReaction1::reactants": ("reactants", "tail", 0, ["A", "B"]), "BiochemicalReaction1::products": ("products", "head", 0, ["A", "B"]),
        "BiochemicalReaction1::reaction": ("reaction", "event", 0, ["A", "B"]), "BiochemicalReaction1::catalysis_tail": ("catalysis", "tail", 0, ["E1", "E2"]),
        "BiochemicalReaction1::catalysis_head": ("catalysis", "head", 0, ["A", "B"]), "BiochemicalReaction2::reactants": ("reactants", "tail", 1, ["A", "B"]),
        "BiochemicalReaction2::products": ("products", "head", 1, ["C"]), "BiochemicalReaction2::reaction": ("reaction", "event", 1, ["A", "B", "C"]),
        "AB::complex": ("complex", None, 0, ["A", "B"]),
    }
    assert {k: (r.type, r.direction, r.time, short(r.nodes)) for k, r in e.items()} == want
    assert (e["AB::complex"].orphan, e["AB::complex"].is_hierarchical, e["AB::complex"].pathway) == (False, False, "One")
    assert e["BiochemicalReaction1::catalysis_tail"].control_type == "ACTIVATION" and e["BiochemicalReaction2::products"].pathway == "One"
    assert {n.label.split(" [")[0]: n.type for n in h.nodes.collect()} == dict.fromkeys(["A", "B", "C", "E1", "E2"], "protein")


def test_translocation_and_nested_complexes(spark, tmp_path):
    """A translocation has no event and no catalysis; complexes inside complexes are seen with them, others are orphans.
    Leaves of one complex come in the order of the ids on the way to them: OUT/B before OUT/IN/A."""
    body = protein("T1", "T") + protein("T2", "T", "L2") + protein("A", "A") + protein("B", "B") + protein("K", "K") + protein("D", "D")
    body += protein("IN", "IN", "L1", ("component", "#A"), tag="Complex") + protein("OUT", "OUT", "L1", ("component", "#IN"), ("component", "#B"), tag="Complex")
    body += protein("LONE", "LONE", "L1", ("component", "#D"), tag="Complex")
    body += reaction("BiochemicalReaction1", ["T1", "OUT"], ["T2"]) + reaction("BiochemicalReaction2", [], ["A"])
    body += rec("Catalysis", "K1", ("controller", "#K"), ("controlled", "#BiochemicalReaction1")) + rec("Catalysis", "K2", ("controller", "#K"), ("controlled", "#BiochemicalReaction2"))
    e = edges(builder.build_hypergraph(spark, write(tmp_path, body)))
    assert {k: (r.time, short(r.nodes)) for k, r in e.items()} == {
        "BiochemicalReaction1::translocation_tail": (0, ["T", "B", "A"]), "BiochemicalReaction1::translocation_head": (0, ["T"]),
        "BiochemicalReaction2::products": (1, ["A"]), "BiochemicalReaction2::reaction": (1, ["A"]),
        "OUT::complex": (0, ["B", "A"]), "IN::complex": (0, ["A"]), "LONE::complex": (None, ["D"]),
    }
    assert (e["OUT::complex"].is_hierarchical, e["IN::complex"].is_hierarchical, e["LONE::complex"].orphan) == (True, False, True)


def test_last_emission_counts(spark):
    em = spark.createDataFrame([(1, 0, 3, "p", "reaction"), (1, 7, 4, "p", "reaction"), (2, 1, None, None, "translocation")], "reaction long, time long, local_order long, pathway string, kind string")
    side = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, "a"), (2, 0, None)], "reaction long, pos int, node string")
    cat = spark.createDataFrame([], "reaction long, control string, pos int, node string")
    got = {r.edge: (r.time, r.local_order, r.nodes) for r in hypergraph.emitted(em, side, side.where("reaction = 2"), cat).collect()}
    assert got == {"1::reactants": (7, 4, ["a", "b"]), "1::reaction": (7, 4, ["a", "b"]), "2::translocation_tail": (1, None, [None]), "2::translocation_head": (1, None, [None])}
