"""Writing edges and folding the writes (survey section 2.6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = ("src", "dst", "type", "time", "local_order", "pathway", "catalysis_type", "seq")


def reaction_writes(reactions: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """G01. Every reactant to every product of its reaction: a product within the key, never across it."""
    x = reactions.join(left.select("reaction", F.col("label").alias("src"), F.col("pos").alias("_l")), "reaction")
    x = x.join(right.select("reaction", F.col("label").alias("dst"), F.col("pos").alias("_r")), "reaction")
    return x.select("src", "dst", F.lit("reaction").alias("type"), "time", "local_order", "pathway", F.lit(None).cast("string").alias("catalysis_type"), F.struct("time", F.col("_l").alias("a"), (F.col("_r") + 1).alias("b")).alias("seq"))


def catalysis_writes(reactions: DataFrame, left: DataFrame) -> DataFrame:
    """G02. The catalyst to every reactant, with its control type; a reaction without one writes nothing."""
    x = reactions.where("catalyst is not null").join(left, "reaction")
    return x.select(F.col("catalyst").alias("src"), F.col("label").alias("dst"), F.lit("catalysis").alias("type"), "time", "local_order", "pathway", F.col("control").alias("catalysis_type"), F.struct("time", F.col("pos").alias("a"), F.lit(0).cast("long").alias("b")).alias("seq"))


def partner_writes(reactions: DataFrame, side: DataFrame, kind: str, forbidden: DataFrame | None = None) -> DataFrame:
    """G06. Both directions between any two participants of one side, but for the forbidden pairs (reaction, x, y in either order)."""
    a, b = side.select("reaction", F.col("label").alias("x"), F.col("pos").alias("i")), side.select("reaction", F.col("label").alias("y"), F.col("pos").alias("j"))
    pairs = a.join(b, "reaction").where("i < j")
    if forbidden is not None:
        both = forbidden.select("reaction", "x", "y").union(forbidden.select("reaction", F.col("y").alias("x"), F.col("x").alias("y")))
        pairs = pairs.join(both.distinct(), ["reaction", "x", "y"], "left_anti")
    turned = pairs.select("reaction", "i", "j", F.inline(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(0).alias("way")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst"), F.lit(1).alias("way")))))
    x = reactions.join(turned, "reaction")
    return x.select("src", "dst", F.lit(kind).alias("type"), "time", "local_order", "pathway", F.lit(None).cast("string").alias("catalysis_type"), F.struct("time", (F.lit(10**6) + F.col("i")).alias("a"), (F.col("j") * 2 + F.col("way")).alias("b")).alias("seq"))


def fold(log: DataFrame) -> DataFrame:
    """G07. One edge per pair; each attribute keeps its last write. catalysis_type is written by catalysis only, so a later
    write of another type leaves it."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    return log.groupBy("src", "dst").agg(last("type"), last("time"), last("local_order"), last("pathway"), F.expr("max_by(catalysis_type, seq) filter (where type = 'catalysis')").alias("catalysis_type"))


def folded(reactions: DataFrame, parts: int | None = None, by: str = "src") -> DataFrame:
    """fold() of the catalysis and reaction writes of `reactions`, whose rows carry their sides: lefts and rights, distinct labels in
    their order. time differs from reaction to reaction.

    A row for each source of a reaction, with all it leads to, goes to the source's part of `parts` (or, `by` dst, one for each target with
    all that leads to it, to the target's); pairs are spelt out and folded there, so
    writes are neither sorted nor shuffled one by one. Within a reaction a pair is written once by each type at most: by catalysis
    last where the target stands behind the catalyst on the left side.
    """
    attributes = ["time", "local_order", "pathway", "control"]
    at = F.array_position("lefts", F.col("catalyst"))
    ends = lambda here, c, at, pos, there: F.struct(here.alias(by), F.lit(c).alias("_c"), at.alias("_at"), pos.alias("_pos"), there.alias("_to"))
    zero, none = F.lit(0).cast("long"), F.lit(0)
    if by == "src":
        own = F.array(ends(F.col("catalyst"), True, at, none, F.col("lefts")))
        each = F.transform("lefts", lambda l: ends(l, False, zero, none, F.col("rights")))
    else:
        own = F.transform("lefts", lambda l, i: ends(l, True, at, i, F.array("catalyst")))
        each = F.transform("rights", lambda r: ends(r, False, zero, none, F.col("lefts")))
    x = reactions.select(*attributes, F.inline(F.concat(F.when(F.col("catalyst").isNotNull(), own).otherwise(F.slice(own, 1, 0)), each)))
    x = x.repartition(parts, by) if parts else x.repartition(by)
    other = "dst" if by == "src" else "src"
    x = x.select(*attributes, by, "_c", "_at", "_pos", F.posexplode("_to").alias("_i", other))
    order = F.when(~F.col("_c"), 1).when(F.col("_pos") + F.col("_i") + 1 > F.col("_at"), 2).otherwise(0)
    x = x.select("src", "dst", *attributes, "_c", (F.col("time") * 4 + order).alias("seq"))
    last = lambda c: F.max_by(c, "seq").alias(c)
    kind = F.when(F.max("seq") % 4 == 1, "reaction").otherwise("catalysis")
    return x.groupBy("src", "dst").agg(kind.alias("type"), F.shiftright(F.max("seq"), 2).alias("time"), last("local_order"), last("pathway"), F.expr("max_by(control, seq) filter (where _c)").alias("catalysis_type"))


def first_only(existing: DataFrame, offered: DataFrame, order: str) -> DataFrame:
    """G08, G09. Of the offered edges, those whose pair is not there yet, the earliest of each pair."""
    new = offered.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    keep = [c for c in offered.columns if c not in ("src", "dst", order)]
    return new.groupBy("src", "dst").agg(*[F.min_by(c, order).alias(c) for c in keep], F.min(order).alias(order))


def partners(reactions: DataFrame, parts: int | None = None) -> DataFrame:
    """The pairs of partner_writes(), without seq: src, dst and the other columns of `reactions`, whose rows carry lefts, distinct labels.
    A row for each source of a reaction, with all its partners, goes to the source's part of `parts`; pairs are spelt out there."""
    rest = [c for c in reactions.columns if c != "lefts"]
    x = reactions.select(*rest, "lefts", F.explode("lefts").alias("src"))
    x = x.repartition(parts, "src") if parts else x.repartition("src")
    return x.select("src", F.explode("lefts").alias("dst"), *rest).where("src <> dst")


def first_offered(writes: DataFrame, order: str, offered: Column, existing: Column) -> DataFrame:
    """G08, G09. first_only() where one table holds both: of the pairs that no `existing` row has, the least `order` of the `offered` rows."""
    x = writes.groupBy("src", "dst").agg(F.min(F.when(offered, F.col(order))).alias(order), F.count_if(offered).alias("_o"), F.count_if(existing).alias("_e"))
    return x.where("_o > 0 and _e = 0").select("src", "dst", order)


def without_loops(edges: DataFrame) -> DataFrame:
    """G11."""
    return edges.where("src <> dst")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("label"), "time")


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G12."""
    return nodes.join(endpoints(edges).select("label"), "label", "left_semi")


def annotate(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """G13. Type of each label: of the entities with that label the last in (store_rank, doc_order), else other."""
    e = entities.groupBy("label").agg(F.max_by("type", F.struct("store_rank", "doc_order")).alias("type"))
    return labels.join(e, "label", "left").select("label", F.coalesce("type", F.lit("other")).alias("type"))


def map_endpoints(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """G10. Both ends through label -> leaf (several rows per label allowed); labels without a row stay."""
    m1, m2 = (mapping.select(F.col("label").alias(a), F.col("leaf").alias(b), F.col("pos").alias(c)) for a, b, c in (("src", "_s", "_i"), ("dst", "_d", "_j")))
    x = edges.join(m1, "src", "left").join(m2, "dst", "left")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return x.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), *rest, F.coalesce("_i", F.lit(0)).alias("out_pos"), F.coalesce("_j", F.lit(0)).alias("in_pos"))
