import pytest

from weft.operators.builder import build_graph
from weft.sources import xml

HEAD = '<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:bp="http://www.biopax.org/release/biopax-level3.owl#">\n'
S = 'rdf:datatype="http://www.w3.org/2001/XMLSchema#string"'


def rec(tag, id_, *fields):
    out = [f'<bp:{tag} rdf:ID="{id_}">']
    for k, v in fields:
        out.append(f'<bp:{k} rdf:resource="#{v[1:]}" />' if v.startswith("#") else f"<bp:{k} {S}>{v}</bp:{k}>")
    return "\n".join(out) + f"\n</bp:{tag}>\n"


def base():
    out = ""
    for n, name in (("1", "cytosol"), ("2", "nucleus")):
        out += rec("UnificationXref", f"UX{n}", ("id", f"GO:{n}"), ("db", "GO")) + rec("CellularLocationVocabulary", f"L{n}", ("term", name), ("xref", f"#UX{n}"))
    return out


def protein(i, name, loc="L1", *more, tag="Protein"):
    return rec(tag, i, ("displayName", name), ("comment", "c"), ("cellularLocation", f"#{loc}"), *more)


def reaction(i, left, right):
    return rec("BiochemicalReaction", i, ("conversionDirection", "LEFT-TO-RIGHT"), *[("left", f"#{x}") for x in left], *[("right", f"#{x}") for x in right])


def step(i, reaction_, *after):
    return rec("PathwayStep", i, ("stepProcess", f"#{reaction_}"), *[("nextStep", f"#{x}") for x in after])


def pathway(i, name, parts, steps):
    return rec("Pathway", i, ("displayName", name), *[("pathwayComponent", f"#{x}") for x in parts], *[("pathwayOrder", f"#{x}") for x in steps])


def write(tmp_path, body):
    f = tmp_path / "p.xml"
    f.write_text(HEAD + base() + body + "</rdf:RDF>\n")
    return str(f)


@pytest.fixture
def m1(tmp_path):
    body = protein("A", "A") + protein("B", "B") + protein("C", "C", "L2") + protein("E1", "E1") + protein("E2", "E2")
    body += protein("ES", "E set", "L1", ("memberPhysicalEntity", "#E1"), ("memberPhysicalEntity", "#E2"), tag="PhysicalEntity")
    body += protein("AB", "AB", "L1", ("component", "#A"), ("component", "#B"), tag="Complex")
    body += reaction("BiochemicalReaction1", ["A", "B"], ["AB"]) + reaction("BiochemicalReaction2", ["AB"], ["C"])
    body += rec("Catalysis", "K1", ("controller", "#ES"), ("controlled", "#BiochemicalReaction1"))
    body += step("S1", "BiochemicalReaction1", "S2") + step("S2", "BiochemicalReaction2") + pathway("P1", "One", ["BiochemicalReaction1", "BiochemicalReaction2"], ["S1", "S2"])
    return write(tmp_path, body)


@pytest.mark.parametrize("partners,complexes,n_nodes,n_edges", [(False, True, 6, 7), (True, True, 6, 9), (False, False, 5, 8)])
def test_catalysed_assembly(spark, m1, partners, complexes, n_nodes, n_edges):
    g = build_graph(spark, m1, partners, complexes)
    e = [tuple(r) for r in g.edges.select("src", "dst", "type", "time", "catalysis_type").collect()]
    assert (g.nodes.count(), len(e)) == (n_nodes, n_edges), e
    assert {x[2:] for x in e if x[0].startswith("E1")} == {("catalysis", 0, "ACTIVATION")}
    assert all(r.type != "other" for r in g.nodes.collect())
    if complexes:
        assert ("AB [cytosol]", "C [nucleus]", "reaction", 1, None) in e
        assert {r.pathway for r in g.edges.select("pathway").collect()} == {"One"}


def test_group_as_substrate(spark, tmp_path):
    body = protein("E1", "E1") + protein("E2", "E2") + protein("X", "X") + protein("ES", "E set", "L1", ("memberPhysicalEntity", "#E1"), ("memberPhysicalEntity", "#E2"), tag="PhysicalEntity")
    body += reaction("BiochemicalReaction1", ["ES"], ["X"]) + step("S1", "BiochemicalReaction1") + pathway("P1", "One", ["BiochemicalReaction1"], ["S1"])
    g = build_graph(spark, write(tmp_path, body))
    assert sorted((r.src, r.dst, r.type, r.time) for r in g.edges.collect()) == [("E1 [cytosol]", "X [cytosol]", "reaction", 0), ("E2 [cytosol]", "X [cytosol]", "reaction", 0)]


def test_kinds_of_reactions(spark, tmp_path):
    body = protein("T1", "T") + protein("T2", "T", "L2") + protein("X1", "ATP") + protein("G", "G", "L2", tag="Dna") + "".join(protein(f"Q{i}", f"Q{i}") for i in range(6))
    body += reaction("BiochemicalReaction1", ["T1"], ["T2"]) + reaction("BiochemicalReaction2", ["T1", "X1"], ["T2", "X1"]) + reaction("BiochemicalReaction3", ["G"], [f"Q{i}" for i in range(6)]) + reaction("BiochemicalReaction4", ["G"], [f"Q{i}" for i in range(5)])
    g = build_graph(spark, write(tmp_path, body))
    n = {}
    for r in g.edges.collect():
        n.setdefault((r.type, r.time), []).append((r.src, r.dst))
    # the second reaction writes T -> T again, and the fourth writes five of the expression edges
    assert {k: len(v) for k, v in n.items()} == {("reaction", 1): 3, ("expression", 2): 1, ("reaction", 3): 5}


def test_steps_and_records(spark, m1):
    s = xml.stores(spark, m1)
    assert {r.id: (r.reaction, r.next) for r in s.step.collect()} == {"S1": ("BiochemicalReaction1", ["S2"]), "S2": ("BiochemicalReaction2", [])}
    e = {r.id: r for r in s.entity.collect()}
    assert e["ES"].label == "[OR] E set [cytosol]" and e["AB"].components == ["A", "B"] and e["C"].label == "C [nucleus]"
