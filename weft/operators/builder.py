"""A pathway file to its graph: the operators in their order (survey section 3.1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import closure, edges, hypergraph, reactions
from weft.sources.xml import Stores, stores

_C = closure.staged

#: Stores in the order in which they name a hypergraph's nodes; the last one counts.
HYPER_STORES = ("protein", "small_molecule", "physical_entity", "complex", "dna", "rna")


@dataclass
class PathwayGraph:
    nodes: DataFrame
    edges: DataFrame


def emissions(spark: SparkSession, s: Stores) -> DataFrame:
    """O01 to O05. reaction, time, local_order, pathway: a reaction once for each of its steps, then those without any."""
    p = s.pathway
    tree = p.select(F.col("id").alias("parent"), F.explode("components").alias("child"))
    subtree = tree.join(p.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")
    depth = closure.depths(subtree).unionByName(p.select(F.col("id").alias("node"), F.lit(0).alias("depth"))).groupBy("node").agg(F.max("depth").alias("depth"))
    member = tree.join(p.select(F.col("id").alias("parent"), "name", "doc_order"), "parent").join(s.reaction.select(F.col("reaction").alias("child")), "child")
    home = member.select(F.col("child").alias("reaction"), F.col("parent").alias("node"), "name", "doc_order").join(depth, "node")
    home = home.groupBy("reaction").agg(F.max_by("name", F.struct(F.col("depth"), -F.col("doc_order"))).alias("pathway"))
    inside = p.select(F.col("id").alias("pathway"), F.col("doc_order").alias("p_order"), F.explode("steps").alias("step"))
    links = inside.join(s.step.select(F.col("id").alias("step"), F.explode("next").alias("next")), "step").select("pathway", "step", "next")
    local = closure.step_depths(spark, inside.select("pathway", "step").distinct(), links)
    claim = local.join(inside.select("pathway", "step", "p_order"), ["pathway", "step"]).groupBy("step").agg(F.max_by(F.struct("pathway", "local_order"), "p_order").alias("c"))
    stepped = s.step.select(F.col("id").alias("step"), "reaction", "doc_order").join(s.reaction.select("reaction"), "reaction").join(claim, "step", "left")
    stepped = stepped.select("reaction", F.lit(0).alias("go"), F.coalesce("c.pathway", F.lit("~")).alias("p"), F.coalesce("c.local_order", F.lit(10**9)).alias("o"), "doc_order", F.col("c.local_order").alias("local_order"))
    free = s.reaction.join(stepped.select("reaction"), "reaction", "left_anti").select("reaction", F.lit(1).alias("go"), F.lit("~").alias("p"), F.lit(10**9).alias("o"), "doc_order", F.lit(None).cast("int").alias("local_order"))
    w = Window.orderBy("go", "p", "o", "doc_order")  # the reactions of one file
    return stepped.unionByName(free).withColumn("time", F.row_number().over(w) - 1).join(home, "reaction", "left").select("reaction", "time", "local_order", "pathway")


def build_graph(spark: SparkSession, path: str, reaction_partners: bool = False, include_complexes: bool = True) -> PathwayGraph:
    return from_stores(spark, stores(spark, path), reaction_partners, include_complexes)


def _kinded(spark: SparkSession, s: Stores, e: DataFrame, mem: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """R04. The emissions with their kind."""
    all_dna = mem.join(e.select(F.col("id").alias("child"), (F.col("kind") == "dna").alias("d")), "child", "left").groupBy(F.col("parent").alias("id")).agg(F.min(F.coalesce("d", F.lit(False))).alias("all_dna"))
    moved = reactions.translocations(left, right)
    cast = reactions.broadcasts(left.join(all_dna, "id", "left").withColumn("dna", (F.col("kind") == "dna") | ((F.col("kind") == "physical_entity") & F.coalesce("all_dna", F.lit(False)))), right)
    return _C(reactions.kinds(emissions(spark, s), moved, cast))


def _catalysts(s: Stores, mem: DataFrame, name: DataFrame) -> DataFrame:
    """M06. reaction, control, k, catalyst: one level of the controller expanded, k its position."""
    group = mem.groupBy(F.col("parent").alias("controller")).agg(F.collect_list("child").alias("m"))
    cat = s.catalysis.join(group, "controller", "left").select("reaction", "control", F.posexplode(F.coalesce("m", F.array("controller"))).alias("k", "id"))
    return cat.join(name.select("id", F.col("label").alias("catalyst")), "id").select("reaction", "control", "k", "catalyst")


def from_stores(spark: SparkSession, s: Stores, reaction_partners: bool = False, include_complexes: bool = True) -> PathwayGraph:
    e = _C(s.entity.select("id", "kind", "store_rank", "doc_order", "name", "location", "members", "components", "label"))
    s = Stores(e, _C(s.reaction), s.catalysis, _C(s.step), _C(s.pathway), s.xref)
    mem = e.select(F.col("id").alias("parent"), F.explode("members").alias("child"))
    name = e.select("id", "kind", "name", "location", "label")
    part = lambda side: s.reaction.select("reaction", F.posexplode(side).alias("pos", "id")).join(name, "id")
    left, right = _C(part("left")), _C(part("right"))
    em = _kinded(spark, s, e, mem, left, right)
    cat = _catalysts(s, mem, name).select("reaction", "control", "k", "catalyst")

    plain = em.where("kind = 'reaction'")
    if include_complexes:
        l, r = left, right
    else:
        child = e.where("kind = 'complex'").select(F.col("id").alias("parent"), F.explode(F.when(F.size("members") > 0, F.col("members")).otherwise(F.col("components"))).alias("child"))
        flat = closure.leaves(child)
        leaf = lambda x: x.join(flat.withColumnRenamed("root", "id"), "id", "left").select("reaction", F.coalesce("leaf", "id").alias("id"), F.struct("pos", F.coalesce(F.concat_ws("/", "path"), F.lit(""))).alias("p")).groupBy("reaction", "id").agg(F.min("p").alias("p")).withColumn("pos", F.row_number().over(Window.partitionBy("reaction").orderBy("p")) - 1).join(name, "id")
        l, r = leaf(left), leaf(right)
    null = F.lit(None).cast("string").alias("catalysis_type")
    seq = lambda a, b, c, d: F.struct(F.col("time"), F.lit(a).alias("part") if isinstance(a, int) else a.alias("part"), b.cast("int").alias("i"), c.cast("int").alias("j"), F.lit(d).alias("way") if isinstance(d, int) else d.cast("int").alias("way")).alias("seq")
    zero = F.lit(0)
    src, dst = l.select("reaction", F.col("label").alias("src"), F.col("pos").alias("i")), r.select("reaction", F.col("label").alias("dst"), F.col("pos").alias("j"))
    same = ("time", "local_order", "pathway")
    log = plain.join(src, "reaction").join(dst, "reaction").select("src", "dst", F.lit("reaction").alias("type"), *same, null, seq(0, F.col("i"), F.col("j") + 1, 0))
    log = log.unionByName(plain.join(cat, "reaction").join(l.select("reaction", F.col("label").alias("dst"), F.col("pos").alias("i")), "reaction").select(F.col("catalyst").alias("src"), "dst", F.lit("catalysis").alias("type"), *same, F.col("control").alias("catalysis_type"), seq(0, F.col("i"), zero, F.col("k"))))
    # translocation: paired participants, one level expanded, matched by bare name
    one = lambda x, by: x.join(mem.withColumnRenamed("parent", by), by, "left").select("reaction", "pos", F.coalesce("child", by).alias("id")).join(name.where("kind <> 'complex'"), "id")
    paired = reactions.pairs(left, right)
    a = one(paired.select("reaction", "pos", F.col("left").alias("x")), "x")
    b = one(paired.select("reaction", "pos", F.col("right").alias("x")), "x").groupBy("reaction", "pos", "name").agg(F.max_by("label", "id").alias("dst"))
    way = em.where("kind = 'translocation'").join(a.select("reaction", "pos", "name", F.col("label").alias("src")).join(b, ["reaction", "pos", "name"]).where("src <> dst"), "reaction")
    log = log.unionByName(way.select("src", "dst", F.lit("translocation").alias("type"), *same, null, seq(0, F.col("pos"), zero, 0)))
    log = log.unionByName(way.join(cat, "reaction").select(F.col("catalyst").alias("src"), F.col("src").alias("dst"), F.lit("catalysis").alias("type"), *same, F.col("control").alias("catalysis_type"), seq(0, F.col("pos"), F.lit(1), F.col("k"))))
    # broadcast: to the members of every product, catalysts unused
    flat_right = right.select("reaction", "pos", "id").join(mem.withColumnRenamed("parent", "id"), "id", "left").select("reaction", "pos", F.coalesce("child", "id").alias("id")).join(name, "id")
    log = log.unionByName(em.where("kind = 'broadcast'").join(left.select("reaction", F.col("label").alias("src"), F.col("pos").alias("i")), "reaction").join(flat_right.select("reaction", F.col("label").alias("dst"), F.col("pos").alias("j")), "reaction").select("src", "dst", F.lit("expression").alias("type"), *same, null, seq(0, F.col("i"), F.col("j"), 0)))
    if reaction_partners:
        both = l.unionByName(r)
        forbidden = both.join(mem.withColumnRenamed("parent", "id"), "id").select("reaction", F.col("label").alias("x"), F.col("child").alias("id")).join(name.select("id", F.col("label").alias("y")), "id").select("reaction", "x", "y")
        for n, (x, kind) in enumerate(((l, "left_reactant"), (r, "right_product"))):
            w = edges.partner_writes(plain, x, kind, forbidden)
            log = log.unionByName(w.withColumn("seq", F.struct(F.col("time"), F.lit(1 + n).alias("part"), F.col("seq.a").cast("int").alias("i"), F.col("seq.b").cast("int").alias("j"), F.lit(0).alias("way"))))
    graph = _C(edges.fold(log))
    touched = left.unionByName(right).join(em.select("reaction", "time"), "reaction")
    graph = _with_complexes(graph, e, mem, name, touched, include_complexes)
    graph = _dissolve(graph, e, mem, name)
    graph = _C(edges.without_loops(graph))
    labels = edges.endpoints(graph).select("label").distinct()
    nodes = edges.annotate(labels, e.where(F.size("members") == 0).select("label", F.col("kind").alias("type"), "store_rank", "doc_order").unionByName(e.where(F.size("members") > 0).select("label", F.col("kind").alias("type"), "store_rank", "doc_order")))
    return PathwayGraph(nodes, graph)


@dataclass
class PathwayHypergraph:
    nodes: DataFrame
    edges: DataFrame


def build_hypergraph(spark: SparkSession, path: str) -> PathwayHypergraph:
    return hyper_from_stores(spark, stores(spark, path))


def hyper_from_stores(spark: SparkSession, s: Stores) -> PathwayHypergraph:
    """H01 to H09. Hyperedges over labels, and the nodes in them with their type. Complexes are no nodes: each one's members
    are an edge at the time of the first reaction that holds it at any depth (orphan, and without a time, if none does). Nodes come in the order of the participants; leaves of one
    complex in the order of the ids on the way to them."""
    e = _C(s.entity.select("id", "kind", "store_rank", "doc_order", "name", "location", "members", "components", "label"))
    s = Stores(e, _C(s.reaction), s.catalysis, _C(s.step), _C(s.pathway), s.xref)
    mem = e.select(F.col("id").alias("parent"), F.posexplode("members").alias("k", "child"))
    name = e.select("id", "kind", "name", "location", "label")
    part = lambda side: s.reaction.select("reaction", F.posexplode(side).alias("pos", "id")).join(name, "id")
    left, right = _C(part("left")), _C(part("right"))
    em = _kinded(spark, s, e, mem.select("parent", "child"), left, right)
    inside = e.where("kind = 'complex'").select(F.col("id").alias("parent"), F.explode(F.when(F.size("members") > 0, F.col("members")).otherwise(F.col("components"))).alias("child"))
    flat = _C(closure.leaves(inside).join(e.where("kind = 'complex'").select(F.col("id").alias("leaf")), "leaf", "left_anti").groupBy("root", "leaf").agg(F.min(F.concat_ws("/", "path")).alias("p")))

    def flattened(x: DataFrame) -> DataFrame:
        """H01. reaction, pos, node (a label): complexes become their leaves, then groups their members."""
        x = x.join(flat.withColumnRenamed("root", "id"), "id", "left").where("kind <> 'complex' or leaf is not null").select("reaction", F.coalesce("leaf", "id").alias("id"), "pos", F.coalesce("p", F.lit("")).alias("p"))
        x = x.join(mem.withColumnRenamed("parent", "id"), "id", "left").select("reaction", F.coalesce("child", "id").alias("id"), F.struct("pos", "p", F.coalesce("k", F.lit(0)).alias("k")).alias("o"))
        first = x.join(name.select("id", F.col("label").alias("node")), "id").groupBy("reaction", "node").agg(F.min("o").alias("o"))
        return first.select("reaction", "node", (F.row_number().over(Window.partitionBy("reaction").orderBy("o", "node")) - 1).alias("pos"))

    cat = _catalysts(s, mem.select("parent", "child"), name).select("reaction", "control", F.col("k").alias("pos"), F.col("catalyst").alias("node"))
    found = hypergraph.emitted(em, _C(flattened(left)), _C(flattened(right)), cat)

    is_complex = e.where("kind = 'complex'").select("id", "components")
    comp = is_complex.select(F.col("id").alias("parent"), F.explode("components").alias("child")).join(is_complex.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")
    held = left.unionByName(right).where("kind = 'complex'").select(F.col("id").alias("root"), "reaction").distinct()
    seen = closure.reachable(comp, held.select("root")).join(held, "root").join(em.select("reaction", "time", "local_order", "pathway"), "reaction")
    seen = seen.groupBy(F.col("node").alias("root")).agg(F.min("time").alias("time"), *[F.min_by(c, "time").alias(c) for c in ("local_order", "pathway")])
    nested = comp.select(F.col("parent").alias("root"), F.lit(True).alias("is_hierarchical")).distinct()
    bodies = flat.join(name.select(F.col("id").alias("leaf"), "label"), "leaf").groupBy("root", "label").agg(F.min("p").alias("pos"))
    bodies = bodies.groupBy("root").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("nodes"))
    whole = bodies.join(seen, "root", "left").join(nested, "root", "left").select(
        F.concat("root", F.lit("::complex")).alias("edge"), F.lit("complex").alias("type"), F.lit(None).cast("string").alias("direction"), "time", "local_order", "pathway",
        F.lit(None).cast("string").alias("control_type"), "nodes", F.coalesce("is_hierarchical", F.lit(False)).alias("is_hierarchical"), F.col("time").isNull().alias("orphan"),
    )
    out = _C(found.unionByName(whole, allowMissingColumns=True))
    labels = out.select(F.explode("nodes").alias("label")).distinct()
    order = F.create_map(*[F.lit(x) for i, k in enumerate(HYPER_STORES) for x in (k, i)])
    return PathwayHypergraph(edges.annotate(labels, e.select("label", F.col("kind").alias("type"), order[F.col("kind")].alias("store_rank"), "doc_order")), out)


def _with_complexes(graph, e, mem, name, touched, include: bool):
    """G08, G09."""
    first = touched.where("kind = 'complex'").groupBy("id").agg(F.min("time").alias("first"))
    comp = e.where("kind = 'complex'").select(F.col("id").alias("parent"), F.explode("components").alias("child"))
    is_group = e.where((F.size("members") > 0) & (F.col("kind") != "complex")).select(F.col("id").alias("child"))
    ends = closure.leaves(mem).select(F.col("root").alias("child"), "leaf").distinct()
    real = comp.join(ends.join(is_group, "child", "left_semi"), "child", "left").select("parent", F.coalesce("leaf", "child").alias("child")).distinct()
    nested = comp.join(e.where("kind = 'complex'").select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")
    down = closure.walks(nested).join(first.withColumnRenamed("id", "root"), "root").groupBy(F.col("node").alias("id")).agg(F.min(F.struct("first", "path")).getField("first").alias("given"))
    when = down.join(first, "id", "full").select("id", F.coalesce("first", "given").alias("time"))
    lab = name.select("id", "label")
    none = [F.lit(None).cast("int").alias("local_order"), F.lit(None).cast("string").alias("pathway"), F.lit(None).cast("string").alias("catalysis_type")]
    if include:
        x = when.join(real.withColumnRenamed("parent", "id"), "id").join(lab.withColumnRenamed("label", "dst"), "id")
        x = x.join(lab.select(F.col("id").alias("child"), F.col("label").alias("src")), "child").select("src", "dst", F.lit("complex_component").alias("type"), "time", *none)
    else:
        there = edges.endpoints(graph).select("label").distinct()
        full = closure.leaves(real).select(F.col("root").alias("id"), F.col("leaf").alias("child")).distinct().join(first, "id")
        m = full.join(lab.select(F.col("id").alias("child"), "label"), "child").join(there, "label", "left_semi").select("id", "first", "label").distinct()
        x = m.select("id", "first", F.col("label").alias("src")).join(m.select("id", F.col("label").alias("dst")), "id").where("src <> dst").select("src", "dst", F.lit("complex_component").alias("type"), F.col("first").alias("time"), *none)
    return _C(graph.unionByName(edges.first_only(graph, x, "time").select(*graph.columns)))


def _dissolve(graph, e, mem, name):
    """G10. Groups give their edges to their leaves, but for groups that express something."""
    group = e.where((F.size("members") > 0) & (F.col("kind") != "complex"))
    chosen = group.groupBy("label").agg(F.min_by("id", F.struct("store_rank", "doc_order")).alias("root"))
    keep = graph.where("type = 'expression'").select(F.col("src").alias("label")).distinct()
    leaf = chosen.join(keep, "label", "left_anti").join(closure.leaves(mem).select("root", "leaf", "path"), "root").join(name.select(F.col("id").alias("leaf"), F.col("label").alias("to")), "leaf")
    mapping = leaf.groupBy("label", F.col("to").alias("leaf")).agg(F.min(F.concat_ws("/", "path")).alias("p"))
    mapping = mapping.select("label", "leaf", (F.row_number().over(Window.partitionBy("label").orderBy("p")) - 1).alias("pos"))
    x = edges.map_endpoints(graph, mapping)
    order = F.struct(F.coalesce("time", F.lit(-1)), "out_pos", "in_pos", "type")
    last = lambda c: F.max_by(c, order).alias(c)
    return x.groupBy("src", "dst").agg(last("type"), last("time"), last("local_order"), last("pathway"), F.max_by("catalysis_type", F.struct(F.col("catalysis_type").isNotNull(), "time")).alias("catalysis_type"))
