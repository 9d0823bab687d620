"""Hyperedges as rows with ordered node lists (survey section 2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import hyperedge_name
from weft.operators.rank import global_rank


def _nodes(incidence: DataFrame, *by: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("pos", "label")))
    return incidence.groupBy(*by).agg(F.transform(ordered, lambda x: x["label"]).alias("nodes"))


def reaction_hyperedges(reactions: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """H02. edge, direction, time, nodes: reactants (tail), products (head) and both (event, a node once, reactants first). A side without nodes has no edge."""
    a = left.select("reaction", F.lit("tail").alias("direction"), F.lit("reactants").alias("part"), F.struct(F.lit(0).alias("side"), F.col("pos")).alias("pos"), "label")
    b = right.select("reaction", F.lit("head").alias("direction"), F.lit("products").alias("part"), F.struct(F.lit(1).alias("side"), F.col("pos")).alias("pos"), "label")
    c = a.unionByName(b).groupBy("reaction", "label").agg(F.min("pos").alias("pos")).select("reaction", F.lit("event").alias("direction"), F.lit("reaction").alias("part"), "pos", "label")
    x = _nodes(a.unionByName(b).unionByName(c), "reaction", "direction", "part")
    return x.join(reactions.select("reaction", "time"), "reaction").select(F.concat(F.col("reaction").cast("string"), F.lit("::"), "part").alias("edge"), "direction", "time", "nodes")


def catalysis_hyperedges(reactions: DataFrame, left: DataFrame) -> DataFrame:
    """H04. Two edges for each catalysed reaction with reactants: the catalyst (tail) and the reactants (head)."""
    heads = _nodes(left, "reaction")
    x = reactions.where("catalyst is not null").join(heads, "reaction")
    name = lambda p: hyperedge_name(F.col("reaction").cast("string"), p)
    rows = F.array(
        F.struct(name("catalysis_tail").alias("edge"), F.lit("tail").alias("direction"), F.array("catalyst").alias("nodes")),
        F.struct(name("catalysis_head").alias("edge"), F.lit("head").alias("direction"), F.col("nodes").alias("nodes")),
    )
    return x.select("time", F.col("control").alias("control_type"), F.inline(rows))


def emitted(emissions: DataFrame, left: DataFrame, right: DataFrame, catalysts: DataFrame) -> DataFrame:
    """H02 to H04, H09. edge, type, direction, time, local_order, pathway, control_type, nodes of all reactions, by their kind.

    A translocation has a tail (all on its left) and a head (all on its right), no event and no catalysis, since both sides are
    the same things in two places. Any other reaction has reactants, products and the event of both; where it has reactants,
    each catalysed one has the catalysts (tail) and the reactants (head) besides. A side without nodes has no edge, and a node
    counts once in an edge, at its first position. A reaction that is emitted again has the time of the last emission.

    emissions: reaction, time, local_order, pathway, kind. left, right: reaction, pos, node. catalysts: reaction, control, pos, node.
    """
    last = emissions.groupBy("reaction").agg(F.max("time").alias("time"), *[F.max_by(c, "time").alias(c) for c in ("local_order", "pathway", "kind")])
    at = lambda n: F.struct(F.lit(n).alias("side"), F.col("pos").cast("long").alias("pos")).alias("pos")
    side = lambda x, n, d: x.select("reaction", F.lit(d).alias("direction"), at(n), "node")
    sides = side(left, 0, "tail").unionByName(side(right, 1, "head")).join(last.select("reaction", "kind"), "reaction")
    moves = F.col("kind") == "translocation"
    tail = F.col("direction") == "tail"
    none = F.lit(None).cast("string").alias("control_type")
    part = F.when(moves, F.concat(F.lit("translocation_"), "direction")).when(tail, "reactants").otherwise("products")
    kind = F.when(moves, "translocation").when(tail, "reactants").otherwise("products")
    inc = sides.select("reaction", part.alias("part"), kind.alias("type"), "direction", none, "pos", "node")
    inc = inc.unionByName(sides.where(~moves).select("reaction", F.lit("reaction").alias("part"), F.lit("reaction").alias("type"), F.lit("event").alias("direction"), none, "pos", "node"))
    fixed = lambda x, n, d: x.select("reaction", F.lit(f"catalysis_{d}").alias("part"), F.lit("catalysis").alias("type"), F.lit(d).alias("direction"), F.col("control").alias("control_type"), at(n), "node")
    stays = last.where(~moves).select("reaction")
    cats = catalysts.join(left.select("reaction").distinct(), "reaction", "left_semi").join(stays, "reaction", "left_semi")
    heads = left.join(cats.groupBy("reaction").agg(F.max("control").alias("control")), "reaction")
    inc = inc.unionByName(fixed(cats, 0, "tail")).unionByName(fixed(heads, 0, "head"))
    by = ["reaction", "part", "type", "direction", "control_type"]
    once = inc.groupBy(*by, "node").agg(F.min("pos").alias("pos")).withColumnRenamed("node", "label")
    x = _nodes(once, *by).join(last, "reaction")
    return x.select(F.concat(F.col("reaction").cast("string"), F.lit("::"), "part").alias("edge"), "type", "direction", "time", "local_order", "pathway", "control_type", "nodes")


def first_sight(reactions: DataFrame, participants: DataFrame) -> DataFrame:
    """H05. Each label's earliest rank with that reaction's pathway and local order."""
    x = participants.join(reactions, "reaction")
    return x.groupBy("label").agg(F.min("time").alias("time"), F.min_by("pathway", "time").alias("pathway"), F.min_by("local_order", "time").alias("local_order"))


def relabel(incidence: DataFrame, names: DataFrame) -> DataFrame:
    """H07."""
    return _nodes(incidence.join(names, "node"), "edge")


def last_emission(edges: DataFrame) -> DataFrame:
    """H09. A reaction emitted again replaces what it wrote before."""
    rest = [c for c in edges.columns if c not in ("reaction", "rank")]
    return edges.groupBy("reaction").agg(F.max("rank").alias("rank"), *[F.max_by(c, "rank").alias(c) for c in rest])


def by_time(edges: DataFrame) -> DataFrame:
    """H10. One hyperedge for each distinct time, ids by sorted time: edge_id, node, each pair once."""
    pairs = edges.select("time", F.explode(F.array("src", "dst")).alias("node")).distinct()
    ids = global_rank(pairs.select("time").distinct(), F.col("time"), [F.col("time")], "edge_id")
    return pairs.join(ids, "time").select("edge_id", "node")


def message_round(incidence: DataFrame, h: DataFrame) -> DataFrame:
    """L04. One hypergraph convolution round without weights: mean over nodes of an edge, then over edges of a node."""
    e = incidence.join(h, "node").groupBy("edge_id").agg(F.avg("h").alias("m"))
    return incidence.join(e, "edge_id").groupBy("node").agg(F.avg("m").alias("h"))
