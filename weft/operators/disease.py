"""A disease file laid over a healthy graph in one call (survey D02, D05-D07, D09, D10, D12, D16 with M10-M12).

Entities of both files are rows: id, source (0 the disease file, 1 the healthy one), store (the order in which stores are
searched), name, label, db_id, uniprot, omim, mutations, clingen, members, components, is_complex, has_mod. Closures over
them run for all reactions at once and give distinct ends, so a cycle ends where it began.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as t
from weft.operators import closure, overlay
from weft.operators.closure import staged
from weft.sources.xml import DISEASE_DBS

ENTITY = (
    "id string, source int, store int, name string, label string, db_id string, uniprot string, omim array<string>, mutations array<string>, clingen array<string>, "
    "members array<string>, components array<string>, is_complex boolean, has_mod boolean"
)
#: Stores whose entities are judged by their names: proteins, molecules, physical entities (of proteins, molecules, DNA, RNA, physical entities, complexes).
NAMED = (0, 1, 4)


def first_store(entities: DataFrame) -> DataFrame:
    """Of the rows of one id that of the first file and store."""
    rest = [c for c in entities.columns if c != "id"]
    return entities.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("source", "store")).alias("_e")).select("id", *(F.col(f"_e.{c}").alias(c) for c in rest))


def _ends(roots: DataFrame, entities: DataFrame, children: Column) -> DataFrame:
    """root, and the columns of every entity without children that is reached; ids without a row lead nowhere."""
    e = entities.withColumn("_children", children)
    down = e.select(F.col("id").alias("parent"), F.explode("_children").alias("child"))
    reached = closure.reachable(down, roots.select(F.col("id").alias("root")))
    return staged(reached.join(e.where(F.coalesce(F.size("_children"), F.lit(0)) <= 0).drop("_children").withColumnRenamed("id", "node"), "node"))


def variants(roots: DataFrame, entities: DataFrame) -> DataFrame:
    """M11, D07. root and its variant ends through members; each id is looked up in the first store that has it."""
    return _ends(roots, first_store(entities), F.col("members"))


def end_labels(roots: DataFrame, entities: DataFrame) -> DataFrame:
    """M12. root, node, label: labelled ends through members in the disease file; for a root that has none there, in the healthy one."""
    out = None
    for source in (0, 1):
        found = _ends(roots, first_store(entities.where(F.col("source") == source)), F.col("members")).where("label <> ''").select("root", "node", "label")
        out = found if out is None else out.unionByName(found.join(out.select("root").distinct(), "root", "left_anti"))
    return out


def decomposed(roots: DataFrame, entities: DataFrame) -> DataFrame:
    """M10. root, node, label: what complexes of the disease file are made of, by members, else components; anything else is its own end."""
    e = first_store(entities.where("source = 0"))
    parts = F.when(F.col("is_complex"), F.when(F.size("members") > 0, F.col("members")).otherwise(F.col("components")))
    return _ends(roots, e, parts).where("not is_complex and label <> ''").select("root", "node", "label")


def is_variant(words: str = t.VARIANT_WORDS) -> Column:
    """D06. A group or entity named as a variant, or one with a changed residue; entities of the stores outside NAMED are judged by the last alone."""
    named = t.is_variant_group(F.col("name"), F.col("members"), words) | t.is_variant_name(F.col("name"))
    return (F.col("store").isin(*NAMED) & named) | F.coalesce("has_mod", F.lit(False))


def mined(pathways: DataFrame) -> DataFrame:
    """D02. pathway, disease, omim. pathways: pathway, display, comments, vocabulary (label), vocabulary_omim, xrefs (db, id).

    The label is the vocabulary's, else the first `(Name; MIM:n)` of the comments, else the first cause, else the display
    name; numbers come from the vocabulary, the comments and the disease databases, distinct in that order.
    """
    texts = F.coalesce("comments", F.array().cast("array<string>"))
    blank = lambda c: F.when(c != "", c)
    named = F.try_element_at(F.filter(F.transform(texts, lambda c: t.disease_label(c)), lambda x: x.isNotNull()), F.lit(1))
    numbers = F.flatten(F.transform(texts, lambda c: t.mim_ids(c, any_case=True)))
    refs = F.transform(F.filter(F.coalesce("xrefs", F.array().cast("array<struct<db:string,id:string>>")), lambda x: F.lower(x["db"]).isin(*DISEASE_DBS) & (x["id"] != "")), lambda x: x["id"])
    omim = F.array_distinct(F.concat(F.coalesce("vocabulary_omim", F.array().cast("array<string>")), numbers, refs))
    return pathways.select("pathway", F.coalesce(blank(F.col("vocabulary")), named, F.col("display"), F.lit("")).alias("disease"), omim.alias("omim"))


def collected(reactions: DataFrame, lefts: DataFrame, catalysts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D05. (reactions with omim, their variants, the left ids that are variants).

    reactions: reaction, name, comments, disease, pathway_omim; lefts: reaction, id; catalysts: reaction, id. Variants come
    from the catalyst; where it gives none, from left ids that are variants. Numbers come from the variants (an end without
    any has the pathway's), else the comments, else the pathway.
    """
    by_catalyst = staged(catalysts.join(variants(catalysts, entities), F.col("id") == F.col("root")).drop("id", "root"))
    open_ = lefts.join(by_catalyst.select("reaction").distinct(), "reaction", "left_anti")
    of_disease = first_store(entities.where("source = 0"))
    marked = staged(open_.join(of_disease.where(is_variant()).select("id"), "id", "left_semi").select("reaction", "id").distinct())
    by_left = marked.join(variants(marked, entities), F.col("id") == F.col("root")).drop("id", "root")
    found = by_catalyst.unionByName(by_left).dropDuplicates(["reaction", "node"])
    found = found.join(reactions.select("reaction", "pathway_omim"), "reaction")
    found = staged(found.select("reaction", F.col("node").alias("entity"), F.coalesce(F.when(F.col("name") != "", F.col("name")), "node").alias("name"), "db_id", "uniprot", "mutations", "clingen", F.when(F.size("omim") > 0, F.col("omim")).otherwise(F.col("pathway_omim")).alias("omim")))
    own = found.groupBy("reaction").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("omim")))).alias("_own"))
    said = F.array_distinct(F.flatten(F.transform(F.coalesce("comments", F.array().cast("array<string>")), lambda c: t.mim_ids(c))))
    filled = lambda c: F.when(F.size(c) > 0, c)
    numbers = F.coalesce(filled(F.col("_own")), filled(said), F.col("pathway_omim"), F.array().cast("array<string>"))
    return staged(reactions.join(own, "reaction", "left").withColumn("omim", numbers).drop("_own")), found, marked


def branches(lefts: DataFrame, marked: DataFrame, entities: DataFrame, nodes: DataFrame, fuzzy: bool = True) -> DataFrame:
    """D09. reaction, branch: nodes of the healthy graph that the left ids stand for, but for variants; a reaction of which
    none is found is tried again with the parts of its complexes. nodes: label, name, db_id, aliases."""
    plain = staged(lefts.join(marked, ["reaction", "id"], "left_anti").select("reaction", "id").distinct())
    names, ids = staged(overlay.name_index(nodes)), nodes.where("db_id is not null").groupBy("db_id").agg(F.max("label").alias("label"))

    def found(pairs: DataFrame) -> DataFrame:
        """pairs: reaction, node, label."""
        asked = pairs.join(first_store(entities).select(F.col("id").alias("node"), "db_id"), "node", "left").select("reaction", F.col("label").alias("name"), "db_id")
        asked = staged(asked)
        distinct = staged(asked.select("name", "db_id").distinct())
        hits = overlay.all_matches(distinct, ids, names, fuzzy)
        return staged(asked.join(hits, asked["name"].eqNullSafe(hits["name"]) & asked["db_id"].eqNullSafe(hits["db_id"])).select("reaction", hits["label"].alias("branch")).distinct())

    ends = end_labels(plain, entities)
    direct = found(plain.join(ends, F.col("id") == F.col("root")).select("reaction", F.col("root").alias("node"), "label"))
    rest = plain.join(direct.select("reaction").distinct(), "reaction", "left_anti")
    parts = decomposed(rest, entities)
    return direct.unionByName(found(rest.join(parts, F.col("id") == F.col("root")).select("reaction", "node", "label")))


@dataclass
class Overlay:
    """What a disease file adds to a graph: nodes, edges; its reactions with branches and those without."""

    nodes: DataFrame
    edges: DataFrame
    anchored: DataFrame
    unanchored: DataFrame

    def report(self) -> DataFrame:
        """D16. One row: how many reactions are anchored and not, disease nodes and edges."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        of_disease = self.nodes.where("type = 'disease_phenotype'")
        parts = (count(self.unanchored, "n_unanchored"), count(of_disease, "n_disease_nodes"), count(self.edges, "n_edges"))
        out = count(self.anchored, "n_anchored")
        for x in parts:
            out = out.join(F.broadcast(x))  # one row each
        return out


def apply(reactions: DataFrame, lefts: DataFrame, rights: DataFrame, catalysts: DataFrame, entities: DataFrame, nodes: DataFrame, base: int, expand_variants: bool = True, fuzzy: bool = True, roots: DataFrame | None = None) -> Overlay:
    """reactions: reaction, name, comments, disease, pathway_omim, step_key; lefts, rights, catalysts: reaction, id; nodes: label,
    name, db_id, aliases of the healthy graph, whose last time is base. roots (label): nodes that unanchored reactions are attached to.

    Ranks count every reaction, also one without a branch. A reaction whose products have no label is a loss of function.
    """
    full, found, marked = collected(reactions, lefts, catalysts, entities)
    at = branches(lefts, marked, entities, nodes, fuzzy)
    if roots is not None:
        lone = reactions.select("reaction").join(at.select("reaction").distinct(), "reaction", "left_anti")
        at = at.unionByName(lone.crossJoin(roots.select(F.col("label").alias("branch"))))  # asked for: every such reaction at every root
    ends = end_labels(rights, entities)
    products = staged(rights.join(ends, F.col("id") == F.col("root")).select("reaction", F.col("label").alias("product")).distinct())
    sizes = products.groupBy("reaction").agg(F.count("*").alias("n_products"))
    label = F.coalesce(F.when(F.col("disease") != "", F.col("disease")), "name")
    timed = overlay.ranked(full, base).join(sizes, "reaction", "left").withColumn("n_products", F.coalesce("n_products", F.lit(0)))
    timed = staged(timed.withColumn("label", label).withColumn("disease", t.disease_node(label, F.col("omim"))))
    anchored, unanchored = timed.join(at.select("reaction").distinct(), "reaction", "left_semi"), overlay.unanchored(timed, at)
    mark = F.concat(F.lit("[MUT] "), "name")
    own = found.select("reaction", mark.alias("variant"), "db_id", "uniprot", "mutations", "clingen", "omim")
    if not expand_variants:
        own = own.limit(0)
    anchored = staged(anchored)
    lone = anchored.join(own.select("reaction").distinct(), "reaction", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    own = own.join(anchored.select("reaction"), "reaction", "left_semi").unionByName(lone.select("reaction", mark.alias("variant"), *(none("string").alias(c) for c in ("db_id", "uniprot")), *(none("array<string>").alias(c) for c in ("mutations", "clingen", "omim"))))
    own = staged(own)
    pairs = own.select("reaction", "variant").distinct()
    edges = overlay.loss_edges(anchored, at, pairs).unionByName(overlay.gain_edges(anchored, at, pairs, products))
    order = anchored.select("reaction", "time")
    phenotype = overlay.by_first(anchored.select(F.col("disease").alias("node"), "reaction", "label", "name", "omim", "time"), "node", "time")
    mutant = overlay.by_first(own.join(order, "reaction").withColumn("time", F.struct("time", "db_id", "uniprot")).withColumnRenamed("variant", "node"), "node", "time")
    known = nodes.select(F.col("label").alias("node"))
    kinds = (
        phenotype.select("node", F.lit("disease_phenotype").alias("type"), "reaction", "omim"), mutant.select("node", F.lit("mutant_variant").alias("type"), "reaction", "omim"),
        overlay.by_first(products.join(order, "reaction").withColumnRenamed("product", "node"), "node", "time").select("node", F.lit("disease_product").alias("type"), "reaction", none("array<string>").alias("omim")),
    )
    added = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).join(known, "node", "left_anti")
    return Overlay(staged(added), staged(edges), anchored, unanchored)
